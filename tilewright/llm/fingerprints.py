"""Document fingerprints by invertible Bloom lookup sketches, with DataFrame functions only.

A text's units are its paragraphs (lines), long ones cut into runs of 24 words; a unit's digest is a 64-bit hash. A sketch hashes each digest into one cell
of each of three sub-tables; a cell holds a count and the XORs of its digests and of their checks. Two versions' sketches subtract cell by cell; what is
left holds only the digests in which they differ, and peeling recovers those: a cell with a single digest gives it away, it is removed
from its other cells, and so on. If digests remain, the sketch is built again, larger. Long texts are sketched in shards
by digest, so that no sketch grows with a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stored, text_of

#: A run of at most 24 words of one line.
UNIT = r"(?:\S++[^\S\n]*+){1,24}+"
WIDTH = 8
#: Digests of both versions in a shard, on average.
SHARD = 10
ROUNDS = 12
#: Sub-table widths that are tried in turn, each four times the last.
WIDTHS = (8, 32, 128, 512)
BASE_WIDTH = 8


def digests(text: Column) -> Column:
    """The different digests of a text's units; none for an empty text or one of white space."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(F.rtrim(u))))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(7)).bitwiseAND((1 << 31) - 1)


def _cell_of(d: Column, table: int | Column, width: int) -> Column:
    """The digest's cell in a sub-table: bits of its own."""
    shifted = F.shiftrightunsigned(d, 13 * table) if isinstance(table, int) else F.when(table == 0, d).when(table == 1, F.shiftrightunsigned(d, 13)).otherwise(F.shiftrightunsigned(d, 26))
    return shifted.bitwiseAND(width - 1).cast("int")


def sketch(ds: Column, width: int = WIDTH) -> Column:
    """3 * width cells (n, k, x) of an array of digests."""

    def cell(at: Column) -> Column:
        mine = F.filter(ds, lambda d: _cell_of(d, F.floor(at / width).cast("int"), width) == at % width)
        empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("x"))
        return F.aggregate(mine, empty, lambda c, d: F.struct((c["n"] + 1).alias("n"), c["k"].bitwiseXOR(d).alias("k"), c["x"].bitwiseXOR(_check(d)).alias("x")))

    return F.transform(F.sequence(F.lit(0), F.lit(3 * width - 1)), cell)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct((p["n"] - q["n"]).alias("n"), p["k"].bitwiseXOR(q["k"]).alias("k"), p["x"].bitwiseXOR(q["x"]).alias("x")))


def peel(cells: Column, width: int = WIDTH, rounds: int = ROUNDS) -> Column:
    """struct(found array of (k digest, n 1 or -1: which version has it), done): all digests of a difference, if done."""

    def once(s: Column) -> Column:
        single = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["x"]))
        return let(F.array_distinct(F.transform(single, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n")))), lambda new: F.struct(removed(s["cells"], new).alias("cells"), F.concat(s["found"], new).alias("found"), (F.size(new) == 0).alias("end")))

    def removed(cells: Column, new: Column) -> Column:
        def less(c: Column, at: Column) -> Column:
            return F.aggregate(
                F.filter(new, lambda f: _cell_of(f["k"], F.floor(at / width).cast("int"), width) == at % width),
                c,
                lambda c, f: F.struct((c["n"] - f["n"]).alias("n"), c["k"].bitwiseXOR(f["k"]).alias("k"), c["x"].bitwiseXOR(_check(f["k"])).alias("x")),
            )

        return F.when(F.size(new) == 0, cells).otherwise(F.transform(cells, less))

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<k:bigint,n:int>>").alias("found"), F.lit(False).alias("end"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.when(s["end"], s).otherwise(once(s)),
        lambda s: F.struct(s["found"].alias("found"), (~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["x"] != 0))).alias("done")),
    )


def difference(a: Column, b: Column, widths: tuple[int, ...] = WIDTHS) -> Column:
    """struct(found, done) of two arrays of digests: sketched, subtracted and peeled, and again with wider sketches while that fails."""
    first, *rest = widths
    got = peel(subtract(sketch(a, first), sketch(b, first)), first)
    return let(got, lambda g: F.when(g["done"], g).otherwise(difference(a, b, tuple(rest)))) if rest else got


def differing(a: Column, b: Column, shard: int = SHARD) -> Column:
    """How many digests are in one of two arrays only: recovered shard by shard from sketches, so that no sketch grows with a text.

    The shards' digests are picked in two steps (groups of shards, then shards), which takes about n * sqrt(n) looks for n digests.
    """

    def count(v: Column) -> Column:
        got = let(difference(v["a"], v["b"]), lambda g: F.when(g["done"], F.size(g["found"])))
        # beyond the widest sketch (odds below any that occur) the digests themselves are compared
        return F.coalesce(got, F.size(F.array_except(v["a"], v["b"])) + F.size(F.array_except(v["b"], v["a"]))).cast("long")

    def within(v: Column) -> Column:
        of = lambda d: F.pmod(F.shiftrightunsigned(d, 40), v["s"])
        pick = lambda u, test: F.struct(F.filter(u["a"], test).alias("a"), F.filter(u["b"], test).alias("b"))

        def group(acc: Column, k: Column) -> Column:
            part = let(pick(v, lambda d: of(d) % v["g"] == k), lambda u: F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor((v["s"] - 1 - k) / v["g"]).cast("long")), F.lit(0).cast("long"), lambda acc, j: acc + let(pick(u, lambda d: of(d) == k + v["g"] * j), count)))
            return acc + part

        return F.aggregate(F.sequence(F.lit(0).cast("long"), v["g"] - 1), F.lit(0).cast("long"), group)

    shards = F.greatest(F.lit(1).cast("long"), F.ceil((F.size(a) + F.size(b)) / shard).cast("long"))
    return let(let(shards, lambda s: F.struct(a.alias("a"), b.alias("b"), s.alias("s"), F.ceil(F.sqrt(s.cast("double"))).cast("long").alias("g"))), within)


def printed(cells: Column) -> Column:
    """A sketch as text: base64 of each cell's count (16 bits), digest (64) and check (32)."""
    cell = lambda c: F.concat(F.lpad(F.hex(F.pmod(c["n"], F.lit(65536))), 4, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["x"]), 8, "0"))
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(cells, cell), ""))), r"\s", "")


def fingerprint(ds: Column) -> Column:
    """Number of different units, then the base sketch. Equal texts have equal fingerprints."""
    return F.concat(F.size(ds).cast("string"), F.lit(":"), printed(sketch(ds, BASE_WIDTH)))


def likeness(shared_or_total: Column, differing: Column) -> Column:
    """Jaccard likeness of two unit sets from their sizes' sum and the number of recovered digests; two empty sets are alike."""
    return F.when(shared_or_total == 0, F.lit(1.0)).otherwise((shared_or_total - differing) / (shared_or_total + differing))


def followers(rows: DataFrame) -> DataFrame:
    """For each different (doc_id, h) of rows the one that follows it in descending doc_id, and after the last the first.

    The ids alone are sorted by range; a window runs in each range, and the ranges' first rows, one per task, are matched in a small second window.
    """
    keys = rows.select("doc_id", "h", "n_chars").distinct()
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    placed = stored(keys.repartitionByRange(*order).select("*", F.spark_partition_id().alias("p")), "fingerprint-order")
    w = Window.partitionBy("p").orderBy(*order)
    here = F.struct("doc_id", "h")
    rows = placed.select("p", "doc_id", "h", "n_chars", F.lead(here).over(w).alias("next"))
    heads = placed.groupBy("p").agg(F.min_by(here, F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), F.col("h"))).alias("head"))
    wp = Window.orderBy("p")
    after = heads.select("p", F.coalesce(F.lead("head").over(wp), F.first("head").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    return rows.join(after, "p").select("doc_id", "h", "n_chars", F.coalesce("next", "_after").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the numbers of recovered digests for every row of docs.

    The edited text has the last third of the code points replaced by as many (or all) first ones of the next document by descending doc_id; after the last comes
    the first, so a single document follows itself. A null text is empty: no units, and two texts without units have likeness 1. A null doc_id comes last.
    Rows equal in doc_id and text count as one in that order and all get its result; rows with equal doc_id and different texts are ordered by the texts' hash. A very long text is
    sketched in shards; a text without white space is one unit. No rows give no rows. Only doc_id and text are read, so other columns' names can't clash.
    """
    base = docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    order = followers(base.withColumn("n_chars", F.char_length("text").cast("long")).select("doc_id", "h", "n_chars"))
    given = order.select(F.col("next.doc_id").alias("_d"), F.col("next.h").alias("_h"), F.col("doc_id").alias("to_doc"), F.col("h").alias("to_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    # both joins shuffle the same columns of the texts by the same keys, so that one exchange serves the two
    sent = given.join(base, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")))
    sent = sent.select("to_doc", "to_h", F.expr("substring(text, 1, need)").alias("lent"), digests(F.col("text")).alias("next_ds"))
    first = Window.partitionBy("to_doc", "to_h").orderBy("to_doc", "to_h")
    sent = sent.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    both = base.join(sent, F.col("doc_id").eqNullSafe(F.col("to_doc")) & (F.col("h") == F.col("to_h"))).withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 3) as int)), lent)")
    rows = both.select("doc_id", "n_chars", kept.alias("edited"), digests(F.col("text")).alias("ds"), "next_ds")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "ds", digests(F.col("edited")).alias("edited_ds"), "next_ds")
    rows = rows.withColumns({"edited_differs": differing(F.col("ds"), F.col("edited_ds")), "next_differs": differing(F.col("ds"), F.col("next_ds"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("ds")).alias("fingerprint"), fingerprint(F.col("edited_ds")).alias("edited_fingerprint"),
        likeness(F.size("ds") + F.size("edited_ds"), F.col("edited_differs")).alias("near_edited"), likeness(F.size("ds") + F.size("next_ds"), F.col("next_differs")).alias("near_next"),
        "edited_differs", "next_differs",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
