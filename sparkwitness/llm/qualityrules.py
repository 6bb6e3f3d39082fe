"""Quality rules as weak supervision: rules vote, their accuracies are estimated, a posterior decides.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains
(0).  No rule decides alone: a document is good or has one of the faults that
the rules look for, expectation-maximisation estimates without labels how often
each rule votes bad in each of these states, and a document's votes give the
posterior probability that it is good.  (With one state for all bad documents
their kinds, which share no votes, would have to be one cluster.)  Documents
with equal votes are one pattern with a count, so the estimation reads a table
of patterns (at most 3 to the number of rules) and not the documents.

Everything is built of Spark's own functions.  Counting is one narrow stage; the
only shuffle is that of the patterns' counts.

* A null text is empty: no words, which fails the base rules.
* Rows are judged by their text alone, so equal rows are judged alike and all
  stay; ids may be null or repeated.
* An empty table gives no rows; the accuracies then stay at their start values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

# White space, symbols and the ends of a sentence.
SPACE, SPACES, CLOSING = r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r", r"[.!?:;\x22][\x20\x09-\x0D]*$"
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_lettered_words", "n_distinct_words", "n_capitals", "n_digits")


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts; where neither holds the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "n_words >= 100"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words", "word_chars BETWEEN 4 * n_words AND 7 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("repeated_lines", "n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "n_words >= 50 AND 20 * n_repeat_words <= n_words"),
    Rule("lettered_words", "10 * n_lettered_words < 8 * n_words", "100 * n_lettered_words >= 95 * n_words"),
    Rule("closed_lines", "2 * n_closed_lines < n_lines", "10 * n_closed_lines >= 9 * n_lines"),
    Rule("distinct_words", "n_words >= 50 AND 5 * n_distinct_words < n_words", "2 * n_distinct_words >= n_words"),
    Rule("capitals", "10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    Rule("digits", "5 * n_digits > word_chars", "20 * n_digits <= word_chars"),
)

#: Start values: share of good documents; rate of bad votes on good documents, of a rule on its own fault, of other rules on it.
SHARE, ON_GOOD, ON_FAULT, ON_OTHER = 0.8, 0.01, 0.8, 0.1
#: A rule votes bad on at most so many good documents, and on at least so many with its own fault.
MOST_WRONG, LEAST_RIGHT = 0.05, 0.5
#: All rates stay within these bounds; so many votes at the start value are added to those counted.
LOW, HIGH, WEIGHT = 0.001, 0.999, 10.0
ROUNDS = 12


def _only(text: Column, characters: str) -> Column:
    """Number of the text's characters of a regular expression's class; what lies between them is cut out, as that has long runs."""
    return F.char_length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(h: Column) -> Column:
    """Number of words in runs whose hash occurs again: equal hashes are neighbours once they are sorted."""
    again = lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
    places = _once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), again)
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts (long) of each whole text.

    n_repeat_words counts the words that lie in a run of three words found more
    than once in the text; runs are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    bare = F.btrim("t", F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    has_word = lambda line: F.regexp_like(line, F.lit(SPACE.replace("[", "[^", 1)))
    t = t.select("id", "t", words.alias("w"), F.filter(F.split("t", "\n"), has_word).alias("l"))
    runs = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    solid = F.col("t")
    for c in SPACES:
        solid = F.replace(solid, F.lit(c), F.lit(""))
    t = t.select(
        "id", F.size("w").alias("n_words"), F.char_length(solid).alias("word_chars"), _only(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), F.slice(runs, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))).alias("h"), F.size("l").alias("n_lines"),
        F.size(F.filter("l", lambda x: F.regexp_like(x, F.lit(CLOSING)))).alias("n_closed_lines"), F.size(F.filter("w", lambda x: F.regexp_like(x, F.lit(r"\p{L}")))).alias("n_lettered_words"),
        F.size(F.array_distinct("w")).alias("n_distinct_words"), _only(F.col("t"), r"\p{Lu}").alias("n_capitals"), _only(F.col("t"), "0-9").alias("n_digits"),
    )
    covered = F.when(F.size(F.array_distinct("h")) == F.size("h"), 0).otherwise(_covered(F.col("h")))
    return t.withColumn("n_repeat_words", covered).select("id", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def base_failed() -> Column:
    """Texts of under 50 words, or mostly of repeated runs of words."""
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def vote(rule: Rule) -> Column:
    return F.expr(f"CASE WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END").alias(rule.name)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """Votes of all rules: 1 good, -1 bad, 0 abstained."""
    return F.array(*[F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END") for r in rules])


@dataclass(frozen=True)
class Model:
    """Shares of the states and, for each state and rule, the rate of bad votes among its votes.

    State 0 is good; state j + 1 is the fault that rule j looks for.
    """

    shares: list[float]
    bad_rates: list[list[float]]

    def posterior(self, v: str) -> Column:
        """Probability of each state given the votes; an abstention says nothing."""

        def log_weight(share: float, rates: list[float]) -> Column:
            bad, good = F.lit([math.log(r) for r in rates]), F.lit([math.log(1 - r) for r in rates])
            parts = F.transform(v, lambda x, i: F.when(x < 0, F.get(bad, i)).when(x > 0, F.get(good, i)).otherwise(0.0))
            return F.aggregate(parts, F.lit(math.log(share)), lambda a, x: a + x)

        logs = F.array(*[log_weight(*state) for state in zip(self.shares, self.bad_rates, strict=True)])
        # One-element arrays name a value for the step that follows.
        weights = F.get(F.transform(F.array(logs), lambda w: F.transform(w, lambda x: F.exp(x - F.array_max(w)))), F.lit(0))
        return F.get(F.transform(F.array(weights), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y))), F.lit(0))


def start(n_rules: int) -> Model:
    on_fault = [[ON_FAULT if i == j else ON_OTHER for i in range(n_rules)] for j in range(n_rules)]
    return Model([SHARE] + [(1 - SHARE) / n_rules] * n_rules, [[ON_GOOD] * n_rules, *on_fault])


def estimate(voted: DataFrame, n_rules: int, rounds: int = ROUNDS) -> Model:
    """Rates by expectation-maximisation over the votes ``v`` of all rows.

    A round is one aggregate over the patterns of votes, which returns a number
    for each state, rule and vote.  A rule's bad votes may be wrong for few good
    documents only and stay likely on its own fault, so that states keep their
    meaning without labels.
    """
    first = start(n_rules)
    model, patterns = first, frames.settled(voted.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        weighed = patterns.select("v", "n", F.posexplode(model.posterior("v")).alias("state", "p"))
        cells = weighed.select("state", (F.col("n") * F.col("p")).alias("p"), F.posexplode("v").alias("rule", "vote"))
        s = {(r["state"], r["rule"], r["vote"]): r["p"] for r in cells.groupBy("state", "rule", "vote").agg(F.sum("p").alias("p")).collect()}
        mass = [sum(s.get((k, 0, x), 0.0) for x in (-1, 0, 1)) + WEIGHT * share for k, share in enumerate(first.shares)]
        rates = []
        for k, before in enumerate(first.bad_rates):
            row = []
            for j, r in enumerate(before):
                bad, good = s.get((k, j, -1), 0.0), s.get((k, j, 1), 0.0)
                low, high = (LEAST_RIGHT, HIGH) if k == j + 1 else (LOW, HIGH if k else MOST_WRONG)
                row.append(min(max((bad + WEIGHT * r) / (bad + good + WEIGHT), low), high))
            rates.append(row)
        model = Model([m / sum(mass) for m in mass], rates)
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """The counts, the rules' votes ``v``, base_failed, p_good and kept of each document.

    Kept are documents that pass the base rules and are more likely good than faulty.
    """
    voted = frames.settled(counts(docs, id_col, text_col).withColumn("v", votes(rules)))
    model = estimate(voted, len(rules), rounds)
    p = F.get(model.posterior("v"), F.lit(0))
    return voted.withColumns({"base_failed": base_failed(), "p_good": p}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
