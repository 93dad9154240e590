"""Fuzzy line dedup by MinHash, with DataFrame functions only.

A line's shingles are its windows of five lower-cased characters, one from every character on; a shorter line is one shingle. Signature and exact Jaccard are of the same shingles: the hash of
each falls into one of BANDS * ROWS bins, the least hash of each bin is the signature (one permutation; a bin without any counts as equal to another such), and ROWS bins make a band. A
bucket's lines are first held against one of them, and those of exact Jaccard 0.8 or more are linked. Of lines that share a bucket and are then still in different components every pair is held
against each other, by the exact Jaccard again. Union-find joins all links into components, and the first line of each component stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, let, release, stored, text_of
from .links import apart_pairs, components, merged_roots, star_buckets, star_pairs

#: Each match looks five characters ahead and leaves one behind.
SHINGLE = r"(?s)(?=(.{5}|\A.{1,4}\z))."
WIDTH = 5
#: A pair of Jaccard s shares a band with about 1 - (1 - s ** ROWS) ** BANDS: 0.998 at 0.8. Fewer than BANDS changed shingles leave a band as it was, a key if it holds a shingle.
BANDS, ROWS = 12, 4
#: Longs of a band's bitmap, a power of two. Of all bands they have 768 bits, which tell lines of a Jaccard well below 0.8 apart up to some 1,500 different shingles; longer ones go by their sizes too.
HALVES = 1
THRESHOLD = 0.8


def hashes(line: Column) -> Column:
    """A hash for each window of the line; the same windows as SHINGLE finds. They are cut from the line at four bytes a character, where each is one slice."""
    size = 4 * WIDTH
    each = lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (size - 1), F.lit(1)), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(size))))
    return let(F.encode(F.lower(line), "utf-32"), each)


def shingles(line: Column) -> Column:
    """The different shingles' hashes, for signature and exact Jaccard."""
    return F.array_distinct(hashes(line))


def windows(texts: DataFrame, once: bool = False) -> DataFrame:
    """id and v (a hash), a row for each window of each line, or once for each different one."""
    if not once:
        return texts.select("id", F.explode(hashes(F.col("line"))).alias("v"))
    # strings of their own, so that all but the pattern is compiled: a lambda's body isn't
    found = F.regexp_extract_all(F.lower("line"), F.lit(SHINGLE), F.lit(1))
    return texts.select("id", F.explode(F.array_distinct(found)).alias("s")).select("id", F.xxhash64("s").alias("v"))


def signatures(texts: DataFrame) -> DataFrame:
    """id, w (how many different shingles), k0... (a key for each band that has one) and b0... (parity bitmaps: of each place, whether an odd number of the band's shingles falls on it).

    texts: id (each once), line, dealt by id.
    """
    v = F.col("v")
    place = F.pmod(v.bitwiseAND((1 << 31) - 1), F.lit(BANDS * ROWS)).cast("int")
    u = F.shiftrightunsigned(v, 31)  # its lowest bits are a place in the bitmap
    # every shingle falls on one of the band's 64 * HALVES places: with one long on any of its bits
    bit = lambda h: F.when(u.bitwiseAND(64 * (HALVES - 1)) == 64 * h, F.call_function("shiftleft", F.lit(1).cast("long"), u.bitwiseAND(63).cast("int")))
    # the array is a column first, so that explode is compiled (a lambda in it would keep it from that); outer, or Spark would filter by the array's size before and make it twice
    rows = texts.select("id", shingles(F.col("line")).alias("vs")).select("id", F.explode_outer("vs").alias("v")).select("id", F.floor(place / ROWS).cast("int").alias("band"), (place % ROWS).alias("bin"), u.alias("u"), *[bit(h).alias(f"x{h}") for h in range(HALVES)])
    least = [F.min(F.when(F.col("bin") == k, F.col("u"))).alias(f"u{k}") for k in range(ROWS)]
    rows = rows.groupBy("id", "band").agg(F.count("*").alias("w"), *least, *[F.bit_xor(f"x{h}").alias(f"x{h}") for h in range(HALVES)])
    rows = rows.select("id", "band", "w", F.xxhash64("band", *[F.coalesce(f"u{k}", F.lit(-1)) for k in range(ROWS)]).alias("key"), *[f"x{h}" for h in range(HALVES)])
    of = lambda c, i: F.max(F.when(F.col("band") == i, F.col(c)))
    keys = [of("key", i).alias(f"k{i}") for i in range(BANDS)]
    return rows.groupBy("id").agg(F.sum("w").alias("w"), *keys, *[F.coalesce(of(f"x{i % HALVES}", i // HALVES), F.lit(0)).alias(f"b{i}") for i in range(BANDS * HALVES)])


def possible(threshold: float):
    """Of two rows with w and the bitmaps: whether they allow a Jaccard of threshold. What both sets have cancels out of the parities, so that sets differ in at least as many shingles as their
    bitmaps differ in bits, however full these are: none that has the Jaccard is left out."""

    def test(left: str, right: str) -> Column:
        v, w, differ = F.col(f"{left}w"), F.col(f"{right}w"), F.lit(0)
        for i in range(BANDS * HALVES):
            differ = differ + F.bit_count(F.col(f"{left}b{i}").bitwiseXOR(F.col(f"{right}b{i}")))
        return (F.least(v, w) >= threshold * F.greatest(v, w) - 1e-6) & (differ <= (v + w) * ((1 - threshold) / (1 + threshold)) + 1e-6)

    return test


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), pos, line (trimmed) and id (its hash) of every line that isn't blank."""
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where(F.col("line").rlike(r"\S"))
    return rows.withColumn("id", F.xxhash64("line"))


def sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b) with the other columns of rows, by id, named l_... for a and r_... for b."""
    for end, prefix in (("a", "l_"), ("b", "r_")):
        pairs = pairs.join(rows.withColumnsRenamed({c: end if c == "id" else prefix + c for c in rows.columns}), end)
    return pairs


def verified(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """The stored pairs (a, b) of a Jaccard of threshold or more, stored in the shared folder. lines: id, line. Only the lines of pairs are taken along."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = stored(lines.select("id", "line").join(wanted.hint("shuffle_hash"), "id", "left_semi").groupBy("id").agg(F.min("line").alias("line")), "line-texts")
    release(lines.sparkSession)
    test = let(F.struct(shingles(F.col("l_line")).alias("x"), shingles(F.col("r_line")).alias("y")), lambda v: let(F.size(F.array_intersect(v["x"], v["y"])), lambda n: n >= threshold * (F.size(v["x"]) + F.size(v["y"]) - n)))
    links = stored(sides(pairs, texts).where(test).select("a", "b"), "line-links")
    for table in (texts, pairs):
        discard(table)
    release(lines.sparkSession)
    return links


def different(lines: DataFrame) -> DataFrame:
    """id and line of the different lines, dealt by id."""
    return lines.select("id", "line").repartition("id").groupBy("id").agg(F.min("line").alias("line"))


def line_roots(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of different lines by their hashes: components of the verified links between lines that share a band."""
    spark = lines.sparkSession
    signed = stored(signatures(different(lines)), "line-bands")
    release(spark)
    buckets = star_buckets(signed.select(F.explode_outer(F.array_compact(F.array(*[f"k{i}" for i in range(BANDS)]))).alias("key"), "id"))
    release(spark)
    wanted = buckets.select("id").distinct()
    traits = stored(signed.select("id", "w", *[f"b{i}" for i in range(BANDS * HALVES)]).join(wanted.hint("shuffle_hash"), "id", "left_semi"), "line-bits")
    discard(signed)
    release(spark)
    may = possible(threshold)
    candidates = stored(sides(star_pairs(buckets), traits).where(may("l_", "r_")).select("a", "b"), "line-candidates")
    release(spark)
    links = verified(candidates, lines, threshold)
    roots = stored(components(links), "line-roots")
    apart = apart_pairs(buckets, roots, traits, may, near=1)
    more = stored(apart, "line-apart")
    discard(apart.rooted)
    discard(buckets)
    discard(traits)
    release(spark)
    more = verified(more, lines, threshold)
    out = merged_roots(roots, more)
    for table in (more, links, roots):
        discard(table)
    release(spark)
    return out


def first_lines(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, h and the positions of the lines that stay: the first of each component by (doc_id, h, pos), null ids first. A common line is one row before it meets its component."""
    once = lines.groupBy("id").agg(F.min(F.struct("doc_id", "h", "pos")).alias("f"))
    rooted = once.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = rooted.groupBy("root").agg(F.min("f").alias("f"))
    return first.select("f.*").groupBy("doc_id", "h").agg(F.collect_list("pos").alias("kept"))


def _deduped(docs: DataFrame, threshold: float) -> DataFrame:
    """row (all columns of docs), text (of the lines that stay), n_lines and kept_lines."""
    lines = occurrences(docs)
    kept = stored(first_lines(lines, line_roots(lines, threshold)), "kept-lines")
    release(docs.sparkSession)
    own = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(text_of()).alias("h"))
    kept = kept.withColumnsRenamed({"doc_id": "kept_id", "h": "kept_h"})
    out = own.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left")

    def rebuilt(v: Column) -> Column:
        blank = F.filter(F.transform(v["lines"], lambda line, i: F.when(~line.rlike(r"\S"), i)), lambda i: i.isNotNull())
        stay = F.transform(F.sort_array(F.concat(v["kept"], blank)), lambda i: F.get(v["lines"], i))
        return let(blank, lambda b: F.struct(F.array_join(stay, "\n").alias("text"), (F.size(v["lines"]) - F.size(b)).alias("n_lines")))

    # bound once: else the text would be split again for every line
    got = let(F.struct(F.split("text", "\n").alias("lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept")), rebuilt)
    out = out.select("row", F.when(F.col("text").isNotNull(), got).alias("got"), F.coalesce(F.size("kept"), F.lit(0)).alias("size"))
    return out.select("row", F.col("got.text").alias("text"), F.coalesce("got.n_lines", F.lit(0)).alias("n_lines"), F.greatest("size", F.lit(0)).alias("kept_lines"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with text reduced to the lines that stay, and n_lines and kept_lines (neither counts blank lines). All columns of docs stay, in their order.

    Lines are alike if equal after trimming or linked through pairs of Jaccard `threshold` or more; of alike lines the first by (doc_id, text's hash, place) stays. Blank lines stay where they
    are. A null text stays null, an empty one empty, no rows give no rows; a very long line is one line. Rows equal in doc_id and text keep the same lines; a null doc_id comes first. A
    column of docs named like one of the two counts is replaced, any other name stays what it is. Each line's component is found over all documents; no line, bucket or group is capped.
    """
    out = _deduped(docs, threshold)
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "kept_lines")]
    return out.select(*columns, "n_lines", "kept_lines")


def without_alike_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with text reduced to the lines that stay, without the rows that had lines and keep none. The columns are those of docs, whatever their names."""
    out = _deduped(docs, threshold).where("n_lines = 0 OR kept_lines > 0")
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "kept_lines", F.char_length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
