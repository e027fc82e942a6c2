import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from test_decontam import brute as brute_decontam
from test_linededup import brute_by_content
from test_nearcopies import brute_groups

from sparkvane.llm import packing, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs.cache())]
    for name, f in P.STAGES:
        out.append((name, f(spark, out[-1][1], sf).cache()))
    return dict(out)


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_the_stages_are_five_and_in_order():
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def test_columns_are_kept(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_each_stage_takes_its_decisions(spark, sf, stages):
    model = toxicity.fit(toxicity.training_rows(stages["documents"], spark.read.parquet(f"{sf}/labels.parquet")))
    low = {r["doc_id"] for r in toxicity.score(stages["documents"], model).collect() if r["score"] < toxicity.THRESHOLD}
    assert ids(stages["toxicity"]) == low < ids(stages["documents"])
    texts = lambda name: dict(sorted((r["doc_id"], r["text"]) for r in stages[name].collect()))
    before, after = texts("toxicity"), texts("line_dedup")
    assert after == dict(zip(before, brute_by_content(list(before.values())), strict=True)) != before
    labels = brute_groups(list(after.values()))
    assert ids(stages["simhash_near_dedup"]) == {d for i, d in enumerate(after) if labels[i] == i} < set(after)
    left = texts("simhash_near_dedup")
    found = brute_decontam(left.values(), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert ids(stages["benchmark_decontamination"]) == {d for d, f in zip(left, found, strict=True) if not f[5]} < set(left)
    assert {r["doc_id"] for r in stages["packing"].collect()} == ids(stages["benchmark_decontamination"])


def test_run_gives_the_same_documents(spark, sf, stages):
    got = P.run(spark, sf)
    assert ids(got) == ids(stages["packing"])
    # where documents are cut depends on the bins of a worker, what they hold does not
    held = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    assert held(got) == held(stages["packing"]) and all(n == total for _, n, total in held(got))


def test_stages_on_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y z", None, None, 5), (4, "w " * 40000, "en", "s", 80000)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"places": F.lit(1), "component_id": F.lit("c"), "fp": F.lit(0)})
    for name, f in P.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= 5, name
        assert f(spark, docs.limit(0), sf).count() == 0
    assert packing.pack(docs).count() > 4
