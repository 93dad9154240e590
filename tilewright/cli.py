"""Annotation sets from the command line: python -m tilewright.cli concatenate|split|merge ..."""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import annotations as an
from .sources import annotations as source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright")
    sub = p.add_subparsers(dest="what", required=True)
    c = sub.add_parser("concatenate", help="documents of the slides that two folders have in common")
    c.add_argument("first")
    c.add_argument("second")
    c.add_argument("out")
    c.add_argument("--keep-layers", action="store_true", help="rename the second's layers instead of joining those of the same name")
    s = sub.add_parser("split", help="a document's layers in parts")
    s.add_argument("folder")
    s.add_argument("out")
    s.add_argument("-n", type=int, default=2)
    s.add_argument("--mode", choices=("parts", "size"), default="parts")
    s.add_argument("--least", type=int, default=0, help="layers of fewer items are repeated in every part")
    s.add_argument("-s", "--slide-ids", nargs="*", help="only the first file whose name holds one of these, for each of them")
    m = sub.add_parser("merge", help="parts named slide_N.json joined again")
    m.add_argument("folder")
    m.add_argument("out")
    m.add_argument("--num-splits", type=int, required=True)
    for one in (c, s, m):
        one.add_argument("--project", default="annotations")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Returns the names of the files written."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tilewright").getOrCreate()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())  # a cluster's session has one
    if a.what == "concatenate":
        first, second = (source.items(source.read_documents(spark, f)) for f in (a.first, a.second))
        both = an.concatenate(first.drop("layer_idx"), second.drop("layer_idx"), not a.keep_layers, a.project)
        return source.write_documents(an.with_layer_order(both), a.out, a.project)
    docs = source.read_documents(spark, a.folder)
    if a.what == "split":
        if a.slide_ids:
            hit = F.array_compact(F.array(*[F.when(F.col("file").contains(i), F.lit(i)) for i in a.slide_ids]))
            first = docs.select("file", F.explode(hit).alias("i")).groupBy("i").agg(F.min("file").alias("file")).select("file").distinct()
            docs = docs.join(first, "file", "left_semi")
        rows = source.items(docs)
        parts = an.split_parts(rows, a.n, a.least) if a.mode == "parts" else an.split_size(rows, a.n)
        named = parts.withColumn("slide", F.concat_ws("_", "slide", "part")).drop("part")
        return source.write_documents(named, a.out, a.project)
    rows = source.items(docs.withColumn("slide_id", F.col("file"))).withColumnRenamed("slide", "name").drop("layer_idx")
    return source.write_documents(an.with_layer_order(an.merge_parts(an.whole_reviews(rows, a.num_splits))), a.out, a.project)


if __name__ == "__main__":
    print("\n".join(main()))
