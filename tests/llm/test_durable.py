"""What a written table leaves behind."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from timberline.llm import durable


def test_shuffle_files_go_with_their_query(spark):
    def files() -> set[str]:
        return {p.name for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(durable.CLEANED, None)
    df = durable.written(spark.range(10_000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("n")))
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(durable.CLEANED, None) == setting
    assert {r.k: r.n for r in df.collect()} == {k: sum(range(k, 10_000, 7)) for k in range(7)}
    durable.forget(df)
