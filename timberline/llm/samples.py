"""Bounded samples of rows and texts for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a text that a model learns from at most; of a longer one it sees a window.
SAMPLE_BYTES = 1 << 14
#: Characters of such a window; one takes four bytes at most.
WINDOW = SAMPLE_BYTES // 4


def drawn(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """About `most` of the different rows, never more than twice as many, in the order of a digest of all their columns.

    Equal rows count once, so neither repeated nor null ids empty the sample;
    it has rows whenever `rows` has any, and is the same in every run.
    """
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rows.columns], F.lit(salt))
    marked = rows.withColumn("_digest", digest)
    share = min(1.0, most / max(1, marked.agg(F.approx_count_distinct("_digest")).first()[0]))
    picked = marked.filter(F.pmod("_digest", F.lit(1 << 30)) <= int(share * (1 << 30)))
    if share < 1 and picked.isEmpty():
        picked = marked
    return picked.dropDuplicates(["_digest"]).orderBy("_digest").limit(2 * most).drop("_digest")


def sample(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """drawn() of rows (text, ...), where a text of more than SAMPLE_BYTES is a window of WINDOW characters.

    A digest of the whole text says where the window begins, so long texts of
    any length, and all parts of them, are learned from.
    """
    spare = F.greatest(F.lit(1), F.length("text") - WINDOW + 1)
    start = (F.pmod(F.xxhash64("text", F.lit(salt)), spare) + 1).cast("int")
    window = F.when(F.octet_length("text") > SAMPLE_BYTES, F.col("text").substr(start, F.lit(WINDOW))).otherwise(F.col("text"))
    return drawn(rows.withColumn("_whole", F.xxhash64("text")).withColumn("text", window), most, salt).drop("_whole")
