"""Bounded samples of labelled texts for fitting the models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows a model is fitted on at most. They are the first by a hash of the id, so the
#: choice depends on neither the layout of the tables nor the number of executors.
SAMPLE_ROWS = 8_000


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, where: Column | None = None
) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled documents.

    Rows without id or label are left out. A repeated label counts once (the largest);
    of a repeated document the smallest text is taken, so the bound holds whatever the
    tables repeat.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        usable = usable.where(where)
    chosen = (
        usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # The right side has at most ``rows`` rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5: such rows never train a model."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0
