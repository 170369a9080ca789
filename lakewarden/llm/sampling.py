"""Bounded samples of labelled texts to fit a classifier on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.text import texts_of

SAMPLE_BYTES = 16_000_000  # of the texts of one label, but for the text that passes it


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int,
                    work: str, most_bytes: int = SAMPLE_BYTES
                    ) -> tuple[DataFrame, dict[int, int]]:
    """At most `per_class` rows of each label (0 and 1), and how many rows carry each label.

    The rows are those with the smallest hash of their id, so reruns draw the same. Ids are drawn
    first; only the texts of the drawn ids are read on. Texts are drawn whole and in that order, until
    those drawn have `most_bytes`. The sample is written under `work`.
    """
    usable = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                            F.col(label).cast("int").alias("label"))
              .where(learn & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)))
    counts = {r["label"]: r["n"]
              for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = reduce(DataFrame.unionByName, [
        usable.where(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
        .limit(per_class) for c in (0, 1)])
    # 2 * per_class ids at most, of 12 bytes.
    found = texts_of(docs).join(F.broadcast(drawn.distinct()), "doc_id")
    by_hash = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "text")
    before = Window.partitionBy("label").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # An id that many documents share counts once per document, so rows are counted too.
    (found.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= per_class)
     .withColumn("read", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
     .where(F.col("read") < most_bytes).drop("place", "read").write.parquet(f"{work}/sample"))
    return docs.sparkSession.read.parquet(f"{work}/sample"), counts


def fitted_model(sample: DataFrame, fit, **settings) -> bytes:
    """Run `fit(texts, labels, **settings) -> bytes` in one task over the bounded sample."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["label"].to_pylist(),
                          table["text"].to_pylist(), strict=True))
        rows = [r for c in (0, 1) for r in rows if r[1] == c]
        model = fit([t for _, _, t in rows], [c for _, c, _ in rows], **settings)
        return pa.table({"model": pa.array([model], pa.binary())})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(
        run, "model binary").collect()
    return bytes(found[0]["model"]) if found else fit([], [], **settings)
