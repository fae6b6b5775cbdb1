"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.session import materialise


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that no classifier learns from: crc32 of the id as text mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `rows` of the labelled documents outside the held-out fifth, as id, text, label.

    The sample goes by a hash of the id, so it is the same in every run. Rows with a null id or
    label are passed over; where an id has several labels the least is taken. The ids, at most
    `rows`, are broadcast, so the documents are read once and not shuffled.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    total = usable.count()
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    few = usable.where(place < F.lit(min(1_000_000, int(1_300_000 * rows / max(total, 1)) + 1)))
    chosen = few.orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(own.join(F.broadcast(chosen), "id"), f"labelled-{label_col}")
