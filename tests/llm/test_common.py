"""Stored tables leave no shuffle files behind."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tilewright.llm.common import CLEANUP, stored


def test_shuffle_files_go_with_the_write(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in dirs for _, _, names in os.walk(d.getAbsolutePath()) for f in names if f.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(CLEANUP)
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(4, "k").groupBy("k").agg(F.max("id").alias("m"))
    kept = stored(rows, "shuffled")
    assert files() <= before and spark.conf.get(CLEANUP) == setting
    assert kept.count() == 7 and rows.count() == 7  # the plan itself can be run again


def test_freed_memory_is_given_back():
    """Blocks that are free between others in use stay with the process until they are given back."""
    import re
    from pathlib import Path

    from tilewright.llm.common import give_back

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

    blocks = [bytearray(20_000) for _ in range(10_000)]
    last = bytearray(20_000)
    del blocks
    before = held()
    give_back()
    assert before - held() > 100 and last


def test_samples_parity_bitmaps(spark):
    """Of one value an odd number of bits is left over: the small bitmaps tell whether they stand for an odd number of values."""
    from tilewright.llm import near_dup

    docs = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(60, 130)], "doc_id bigint, text string")
    bits = sum(F.bit_count(F.col("small")[i]) for i in range(near_dup.SMALL))
    got = near_dup.samples(docs).select("s0", bits.alias("bits")).collect()
    assert len(got) == 70 and all((r.s0 - r.bits) % 2 == 0 and r.bits <= r.s0 for r in got)
