"""Every query of the subpackage against its SQL or the plain Python of these tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))
import check_oracle  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SMALL = "/root/testdata/sf0.001"
NUMBERED = [n for n in contract.queries() if n.startswith("op") and n[2].isdigit()]

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data here")


def test_numbered_queries_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in NUMBERED) == list(range(1, 14))
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", [*NUMBERED, "pipeline"])
def test_query(spark, name):
    outcome, rows, _ = check_oracle.compare(spark, SMALL, name)
    assert outcome in ("ok", "rows only") and rows > 0


def test_pipeline_stages_do_their_work(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    accepted = corpus_pipeline.quality(spark, docs, SMALL)
    assert accepted.columns == docs.columns and 0 < accepted.count() <= docs.count()
    single = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    found = contract.queries()["op5_near_duplicates"](spark, SMALL)
    assert single.columns == docs.columns
    assert single.count() == found.select("component_id").distinct().count()
    cleaned = corpus_pipeline.repeated_passages(spark, docs, SMALL)
    removed = contract.queries()["op3_substring_dedup"](spark, SMALL)
    same = cleaned.join(docs.select("doc_id", docs["text"].alias("before")), "doc_id").where(
        "text = before").count()
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert same == removed.where("n_removed = 0").count()
    mixed = corpus_pipeline.source_mix(spark, docs, SMALL)
    taken = contract.queries()["op10_mix_sources"](spark, SMALL)
    assert mixed.columns == docs.columns
    assert mixed.count() == taken.selectExpr("sum(taken / size)").first()[0]


def test_stages_pass_on_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage + " one", "s"), (2, "a b " + passage + " two", "s"), (3, None, None),
            (None, "no id", "t"), (4, "", "t"), (5, "text of its own", "t"), (5, "another", "t")]
    spark.createDataFrame([(r[0], 1) for r in rows], "doc_id bigint, quality int").write.parquet(
        str(tmp_path / "labels.parquet"))
    names = ["n_words", "n_removed", "kept_text", "kept_0", "batch", "copy", "size", "repeats",
             "epochs", "extra", "target", "score", "predicted", "component_id", "n", "__key"]
    docs = spark.createDataFrame(
        [(*r, 7, *[f"{c} {i}" for c in names]) for i, r in enumerate(rows)],
        "doc_id bigint, text string, source string, n_chars bigint, "
        + ", ".join(f"`{c}` string" for c in names))
    for stage, function in corpus_pipeline.STAGES[:-1]:
        found = function(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, stage
        kept = found.collect()
        assert kept, stage
        for r in kept:
            number = r["n_words"].split()[1]
            assert all(r[c] == f"{c} {number}" for c in names), stage
    # The document that loses its passage keeps its other words; the first one keeps all.
    texts = {r["n_words"]: r["text"] for r in corpus_pipeline.repeated_passages(
        spark, docs, str(tmp_path)).collect()}
    assert texts["n_words 0"] == passage + " one" and texts["n_words 1"] == "a b two"
    none = docs.where("false")
    for stage, function in corpus_pipeline.STAGES:
        assert function(spark, none, str(tmp_path)).collect() == [], stage
