"""Each stage of the pipeline against a plain version, and the whole run."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sparkwitness.llm import quality, secrets
from sparkwitness.llm import textkernel as tk

from .test_operators import EDGE, plain_components, plain_contained, plain_mix, plain_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame(out[-1], docs.schema), SF)
        out.append(docs.toPandas())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_quality_stage(spark, stages):
    docs, kept = stages[0], stages[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.createDataFrame(docs), labels)
    want = [i for i, t in zip(docs.doc_id, docs.text, strict=True) if model.score(quality.statistics(*tk.text_buffers(__import__("pyarrow").array([t]))))[0] >= quality.THRESHOLD]
    assert sorted(kept.doc_id) == sorted(want)
    good = set(labels.where("quality = 1").toPandas().doc_id)
    assert len(good - set(kept.doc_id)) <= 0.03 * len(good)


def test_near_duplicate_stage(stages):
    docs, kept = stages[1].sort_values("doc_id"), stages[2]
    component = plain_components(plain_sets(list(docs.text)))
    assert sorted(kept.doc_id) == sorted({docs.doc_id.iloc[c] for c in component})


def test_decontamination_stage(spark, stages):
    docs, kept = stages[2], stages[3]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    bad = {docs.doc_id.iloc[d] for d, *_ in plain_contained(list(docs.text), list(items.text))}
    assert set(kept.doc_id) == set(docs.doc_id) - bad


def test_secret_stage(stages):
    docs, kept = stages[3], stages[4]
    assert sorted(docs.doc_id) == sorted(kept.doc_id) and list(docs.columns) == list(kept.columns)
    model = secrets.default_model()
    got = kept.set_index("doc_id")
    for i, text, source in zip(docs.doc_id, docs.text, docs.source, strict=True):
        for _, a, b, s in reversed(secrets.findings_of(text, source or "", model)):
            if s >= secrets.THRESHOLD:
                text = text[:a] + secrets.MASK + text[b:]
        assert got.text[i] == text and (secrets.MASK not in text or got.n_chars[i] == len(text))


def test_mixing_stage(stages):
    docs, mixed = stages[4], stages[5].set_index("doc_id")
    size, target = plain_mix([(i, s, len(t.split())) for i, s, t in zip(docs.doc_id, docs.source, docs.text, strict=True)])
    assert sorted(mixed.index) == sorted(docs.doc_id)
    for s, g in mixed.groupby("source"):
        assert g.source_size.iloc[0] == size[s] and g.target.iloc[0] == pytest.approx(target[s]) and abs(g.taken.sum() - target[s]) <= g["size"].max()
    assert (mixed.taken <= 2 * mixed["size"]).all()


def test_run_equals_its_stages(spark, stages):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, out.astype(str).values)) == sorted(map(tuple, stages[5][out.columns].astype(str).values))


def test_stages_on_edges(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_k0", F.lit(1)).withColumn("score", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0 and (name == "mixing" or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), SF).count() == 0
