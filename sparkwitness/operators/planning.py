"""Workload planning: criteria, greedy budgets that skip rather than stop, plan states."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import matches
from ..tables import lookup, match, ordered, prefix_sums, settled

# Order of workload types, and default budgets.
TYPE_ORDER = ("pytest", "semgrep", "custom", "k6")
MAX_SELECTED, MAX_COST = 8, 300.0
MAX_FILES, MAX_BYTES, MAX_TOKENS = 8, 16_384, 4_096


def type_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPE_ORDER)), kind).cast("int")


def first_match(criteria: DataFrame, evidence: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """First matching criterion of each workload and run: by criterion order, then by value.

    ``criteria``: workload_id, ord, source, value, match; ``evidence``: run_id, source, value;
    ``pairs`` (run_id, workload_id), if given, are the only ones that are looked for.
    Equal patterns are held against equal evidence once, in a join on the source;
    what they hit is joined by equality.
    """
    e = evidence.where("trim(value) <> ''").distinct().withColumnRenamed("value", "evidence")
    pattern = ["source", "value", "match"]
    found = criteria.select(*pattern).distinct().join(e.select("source", "evidence").distinct(), "source").where(matches(F.col("match"), F.col("value"), F.col("evidence")))
    hits = settled(found.join(e, ["source", "evidence"]).groupBy("run_id", *pattern).agg(F.min("evidence").alias("evidence")))
    if pairs is None:
        j = match(criteria, hits, pattern)
    else:
        j = match(criteria.join(pairs.distinct(), "workload_id"), hits, ["run_id", *pattern])
    best = j.groupBy("run_id", "workload_id").agg(F.min(F.struct("ord", "evidence", "source")).alias("b"))
    return best.select("run_id", "workload_id", "b.source", "b.evidence")


@dataclass(frozen=True)
class Budget:
    """Limits of a greedy choice: sums of costs (column, limit, name), a number of entries, a number of files.

    Names are those that omitted entries list, in this order: files, costs, count.
    """

    costs: tuple[tuple[str, float, str], ...]
    count: tuple[int, str] | None = None
    files: tuple[str, int, str] | None = None


#: Costs are summed as decimals, so that no sum depends on the order of addition.
_COST = "decimal(28,9)"
#: Groups of at most so many entries are folded in one row.
FOLD_ENTRIES = 1024


def greedy(entries: DataFrame, group: str, order: list[str], budget: Budget) -> DataFrame:
    """Adds ``exceeded``: the limits that an entry would pass when its turn comes; it is taken where there are none.

    Entries are considered in ``order`` (ties by the other columns); one that
    passes a limit is skipped, and later ones may still fit.  A null cost is 0.
    Small groups are folds of one row, large ones are chosen in rounds of
    distributed prefix sums; both give the same rows.
    """
    rest = [c for c in entries.columns if c != group and c not in order]
    sizes = settled(entries.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most <= FOLD_ENTRIES:
        return _folded(entries, group, order + rest, budget)
    large = sizes.where(F.col("_n") > FOLD_ENTRIES)
    many = lookup(entries, large.withColumn("_w", F.col("_n")), [group], "_w", total).drop("_n")
    few = match(entries, sizes.where(F.col("_n") <= FOLD_ENTRIES).select(group), [group], "left_semi")
    return _folded(few, group, order + rest, budget).unionByName(_in_rounds(many, large, group, order + rest, budget, total))


def _cost(name: str, of: Column | None = None) -> Column:
    return F.coalesce((F.col(name) if of is None else of[name]).cast(_COST), F.lit(0).cast(_COST))


def _folded(entries: DataFrame, group: str, order: list[str], budget: Budget) -> DataFrame:
    """One row a group: its entries sorted, and a fold that notes each entry's exceeded limits."""
    zero = F.lit(0).cast(_COST)
    strings = F.array().cast("array<string>")
    start = F.struct(*[zero.alias(c) for c, *_ in budget.costs], F.lit(0).alias("n"), strings.alias("files"), F.array().cast("array<array<string>>").alias("notes"))

    def step(s, x):
        files = F.array_union(s["files"], F.array(x[budget.files[0]])) if budget.files else s["files"]
        sums = {c: (s[c] + _cost(c, x)).cast(_COST) for c, *_ in budget.costs}
        found = [F.when(F.size(files) > budget.files[1], F.lit(budget.files[2]))] if budget.files else []
        found += [F.when(sums[c] > limit, F.lit(name)) for c, limit, name in budget.costs]
        found += [F.when(s["n"] >= budget.count[0], F.lit(budget.count[1]))] if budget.count else []
        note = F.array_compact(F.array(*found)).cast("array<string>")
        out = F.size(note) > 0
        moved = [F.when(out, s[c]).otherwise(v).alias(c) for c, v in sums.items()]
        return F.struct(*moved, F.when(out, s["n"]).otherwise(s["n"] + 1).alias("n"), F.when(out, s["files"]).otherwise(files).alias("files"), F.concat(s["notes"], F.array(note)).alias("notes"))

    sorted_ = entries.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_e"))
    noted = sorted_.select(group, F.arrays_zip("_e", F.aggregate("_e", start, step)["notes"].alias("_x")).alias("_z")).select(group, F.explode("_z").alias("_z"))
    return noted.select(group, *[F.col(f"_z._e.{c}").alias(c) for c in order], F.col("_z._x").alias("exceeded"))


def _in_rounds(entries: DataFrame, sizes: DataFrame, group: str, order: list[str], budget: Budget, total: int) -> DataFrame:
    """The same choice for large groups, all of them at once.

    In a round an entry is small when it takes at most half of what is left of
    each cost and no new file.  Small entries fit one after the other until they
    have used half of some cost; a larger one fits where the small ones before
    it leave room.  The round ends at the first of these events, which halves
    what is left of a cost, adds a file or ends the count, so that the number of
    rounds is the logarithm of the budget and not the number of entries.  Only
    the number of open groups comes to the driver.
    """
    names = [c for c, *_ in budget.costs]
    rows = ordered(entries.withColumns({f"_k_{c}": _cost(c) for c in names}), group, *order)
    most = budget.count[0] if budget.count else (1 << 62)
    state = settled(sizes.select(group, F.col("_n"), F.lit(-1).cast("long").alias("at"), F.lit(most).cast("long").alias("left"), F.array().cast("array<string>").alias("files"), *[F.lit(limit).cast(_COST).alias(f"r_{c}") for c, limit, _ in budget.costs]))
    taken, every = [], lambda conds: reduce(lambda a, x: a & x, conds, F.lit(True))
    while state.where("left > 0").limit(1).count():
        open_ = state.where("left > 0")
        known = F.array_contains("files", F.col(budget.files[0])) if budget.files else F.lit(True)
        fits = every([F.col(f"_k_{c}") <= F.col(f"r_{c}") for c in names]) & (F.col("_seq") > F.col("at"))
        if budget.files:
            fits = fits & (known | (F.size("files") < budget.files[1]))
        live = lookup(rows, open_, [group], "_n", total).where(fits)
        live = live.withColumn("_small", known & every([F.col(f"_k_{c}") * 2 <= F.col(f"r_{c}") for c in names]))
        sums = prefix_sums(live, [group], {f"s_{c}": F.when(F.col("_small"), F.col(f"_k_{c}")).otherwise(0) for c in names} | {"s_n": F.col("_small").cast("long")})
        half = reduce(lambda a, x: a | x, [(F.col(f"s_{c}") + F.col(f"_k_{c}")) * 2 > F.col(f"r_{c}") for c in names], F.col("s_n") + 1 >= F.col("left"))
        room = every([F.col(f"s_{c}") + F.col(f"_k_{c}") <= F.col(f"r_{c}") for c in names]) & (F.col("s_n") < F.col("left"))
        sums = settled(sums.withColumn("_event", F.when(F.col("_small"), half).otherwise(room)))
        after = [(F.col(f"r_{c}") - F.col(f"s_{c}") - F.col(f"_k_{c}")).cast(_COST).alias(f"r_{c}") for c in names]
        files = F.array_union("files", F.array(F.col(budget.files[0]))) if budget.files else F.col("files")
        event = sums.where("_event").groupBy(group).agg(F.min(F.struct("_seq", (F.col("left") - F.col("s_n") - 1).alias("left"), files.alias("files"), *after)).alias("e"))
        event = settled(event.select(group, F.col("e._seq").alias("at"), "e.left", "e.files", *[f"e.r_{c}" for c in names]))
        # Where there was no event, all small entries fit and the group is done.
        ends = match(open_.select(group, "_n"), event.select(group, F.col("at").alias("end")), [group], "left")
        chosen = lookup(sums.select(group, "_seq", "_part", "_small"), ends, [group], "_n", total)
        taken.append(settled(chosen.where((F.col("_small") & (F.col("end").isNull() | (F.col("_seq") < F.col("end")))) | (F.col("_seq") == F.col("end"))).select("_seq")))
        state = settled(match(open_.select(group, "_n"), event, [group]))
    picked = reduce(DataFrame.unionByName, taken).withColumn("_taken", F.lit(True))
    return _noted(rows.join(picked, "_seq", "left").withColumn("_taken", F.coalesce("_taken", F.lit(False))), sizes, group, order, budget, total)


def _noted(rows: DataFrame, sizes: DataFrame, group: str, order: list[str], budget: Budget, total: int) -> DataFrame:
    """The limits that each entry passes, given which ones are taken: sums over the taken entries before it."""
    names = [c for c, *_ in budget.costs]
    rows = settled(rows)
    used = prefix_sums(rows, [group], {f"s_{c}": F.when(F.col("_taken"), F.col(f"_k_{c}")).otherwise(0) for c in names} | {"s_n": F.col("_taken").cast("long")})
    found = []
    if budget.files:
        file, most, name = budget.files
        firsts = rows.where("_taken").groupBy(group, file).agg(F.min("_seq").alias("first")).groupBy(group).agg(F.collect_list(F.struct(file, "first")).alias("_files"))  # at most ``most``
        used = lookup(used, match(sizes, firsts, [group], "left"), [group], "_n", total)
        earlier = F.filter(F.coalesce("_files", F.array().cast(firsts.schema["_files"].dataType)), lambda f: f["first"] < F.col("_seq"))
        found.append(F.when((F.size(earlier) >= most) & ~F.exists(earlier, lambda f: f[file].eqNullSafe(F.col(file))), F.lit(name)))
    found += [F.when(F.col(f"s_{c}") + F.col(f"_k_{c}") > limit, F.lit(name)) for c, limit, name in budget.costs]
    found += [F.when(F.col("s_n") >= budget.count[0], F.lit(budget.count[1]))] if budget.count else []
    return used.select(group, *order, F.array_compact(F.array(*found)).cast("array<string>").alias("exceeded"))


def _in_order(order: list[str], value: Column, cond: Column) -> Column:
    """Values of the rows that hold a condition, as an array in order."""
    return F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(*order, value.alias("_v"))))), lambda x: x["_v"])


def greedy_selection(entries: DataFrame, group: str, max_selected: int = MAX_SELECTED, max_cost: float = MAX_COST) -> DataFrame:
    """Selection in (priority, type rank, id) order: (group, used, selected, over_budget, skipped).

    ``over_budget`` lists the skipped ids in order, ``skipped`` counts them; a
    reader of the count alone gathers no list, and ``greedy`` has them as rows.
    """
    budget = Budget((("cost", max_cost, "cost"),), (max_selected, "count"))
    order = ["priority", "rank", "workload_id"]
    done = greedy(entries.select(group, *order, "cost"), group, order, budget)
    taken = F.size("exceeded") == 0
    used = F.coalesce(F.sum(F.when(taken, _cost("cost"))), F.lit(0)).cast("double")
    return done.groupBy(group).agg(used.alias("used"), _in_order(order, F.col("workload_id"), taken).alias("selected"), _in_order(order, F.col("workload_id"), ~taken).alias("over_budget"), F.count_if(~taken).cast("int").alias("skipped"))


def plan(entries: DataFrame, matched: DataFrame, group: str, max_selected: int = MAX_SELECTED, max_cost: float = MAX_COST) -> DataFrame:
    """Plan of each group: selection, omissions by category, confidence and state.

    ``entries``: group, workload_id, priority, rank, cost, completeness,
    fallback, eligible; ``matched``: group, workload_id of those with evidence.
    An incomplete graph allows only eligible fallbacks, at half the confidence.
    """
    m = matched.select(group, "workload_id", F.lit(True).alias("hit")).distinct()
    j = entries.join(m, [group, "workload_id"], "left")
    incomplete = F.col("completeness") < 1
    reason = F.when(incomplete & ~(F.col("fallback") & F.col("eligible")), "incomplete_graph").when(~incomplete & F.col("hit").isNull(), "node_evidence")
    j = settled(j.withColumn("omitted", reason))  # read by every round of the budget
    folded = greedy_selection(j.where("omitted is null"), group, max_selected, max_cost).drop("over_budget").withColumnRenamed("skipped", "over_budget")
    info = j.groupBy(group).agg(F.min("completeness").alias("completeness"), F.count_if(F.col("omitted") == "incomplete_graph").alias("incomplete_graph"), F.count_if(F.col("omitted") == "node_evidence").alias("node_evidence"))
    out = info.join(folded, group, "left")
    none = F.array().cast("array<bigint>")
    out = out.withColumns({"selected": F.coalesce("selected", none), "over_budget": F.coalesce("over_budget", F.lit(0)), "used": F.coalesce("used", F.lit(0.0))})
    empty, incomplete = F.size("selected") == 0, F.col("completeness") < 1
    state = (
        F.when(empty & (F.col("over_budget") > 0), "budget_exhausted").when(incomplete & empty, "incomplete_no_fallback").when(incomplete, "incomplete_with_fallback")
        .when(~empty, "planned").otherwise("complete_no_applicable")
    )
    confidence = F.when(incomplete & empty, 0.0).when(incomplete, F.col("completeness") * 0.5).otherwise(F.col("completeness"))
    return out.withColumn("state", state).withColumn("confidence", confidence)


def bundle_items(items: DataFrame, group: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Items (group, ord, key, file, bytes, tokens) of context bundles with ``exceeded``, the limits of three budgets that an item would pass.

    ``items``: group, ord, key, file, text.  Tokens are bytes over four, rounded up.
    """
    size = F.octet_length("text")
    costs = items.select(group, "ord", "key", "file", size.cast("long").alias("bytes"), F.ceil(size / F.lit(4)).cast("long").alias("tokens"))
    budget = Budget((("bytes", max_bytes, "byte-size"), ("tokens", max_tokens, "token-count")), files=("file", max_files, "file-count"))
    return greedy(costs, group, ["ord", "key"], budget)


def bundle(items: DataFrame, group: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row for each bundle: included keys, omitted ones with their limits, and what is used."""
    taken = F.size("exceeded") == 0
    named = F.concat(F.col("key").cast("string"), F.lit(":"), F.array_join("exceeded", ", "))
    used = lambda c: F.coalesce(F.sum(F.when(taken, F.col(c))), F.lit(0))
    order = ["ord", "key"]
    return bundle_items(items, group, max_files, max_bytes, max_tokens).groupBy(group).agg(
        _in_order(order, F.col("key"), taken).alias("included"), _in_order(order, named, ~taken).alias("omitted"), used("bytes").alias("bytes"), used("tokens").alias("tokens"), F.size(F.collect_set(F.when(taken, F.col("file")))).alias("files")
    )


def byte_cap(files: DataFrame, group: str, total: int) -> DataFrame:
    """Files in path order up to a total size; one that does not fit is skipped and takes no budget."""
    done = greedy(files.select(group, "path", "size"), group, ["path"], Budget((("size", total, "byte-size"),)))
    taken = F.size("exceeded") == 0
    return done.groupBy(group).agg(F.coalesce(F.sum(F.when(taken, F.col("size"))), F.lit(0)).alias("used"), _in_order(["path"], F.col("path"), taken).alias("kept"))


def truncated(values: Column, cap: int) -> Column:
    """First values with a closing row that says how many are left out."""
    return F.when(F.size(values) > cap, F.concat(F.slice(values, 1, cap), F.array(F.concat((F.size(values) - cap).cast("string"), F.lit(" more"))))).otherwise(values)
