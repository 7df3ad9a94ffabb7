"""Bounded samples of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(marked: DataFrame, docs: DataFrame, key: str, text: str, label: Column, per_label: int) -> list[tuple[str, object]]:
    """(text, label) of at most *per_label* rows for each label: those with the least hashes of *key*.

    *marked* has keys and what *label* is made of, *docs* keys and texts. Any run takes the same rows. Keys and labels alone
    are counted and ranked; only the chosen keys, whose number is bounded, are broadcast to fetch their texts, so no text is
    shuffled but theirs. A key stands for one row (its largest label, its least text); rows without key, label or text take
    no part.
    """
    marks = marked.select(F.col(f"`{key}`").alias("key"), label.alias("label")).filter("key is not null and label is not null")
    marks = marks.groupBy("key").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    if not counts:
        return []
    draw = F.xxhash64(F.col("key"), F.lit("sample")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * per_label + 50.0) / n))])
    few = marks.withColumn("draw", draw).filter(F.col("draw") <= share[F.col("label")])
    ranked = few.selectExpr("*", "row_number() over (partition by label order by draw, key) as position")
    chosen = ranked.filter(F.col("position") <= per_label).select("key", "label").collect()
    kept = docs.sparkSession.createDataFrame(chosen, marks.schema)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    found = rows.join(F.broadcast(kept), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return [(r["text"], r["label"]) for r in found.orderBy("label", "key").collect()]
