"""Near-duplicate documents by a containment ensemble of MinHash samples.

A document is the set of its five-word shingles, each a 64-bit hash. Sets are partitioned by size, into powers of two. The values below a partition's bound are a set's sample
(SAMPLE to 2 * SAMPLE of them; all of a set of fewer than 2**FULL); as bounds only fall with size, a set's sample can be looked up in any larger set. A containment of t leaves a set
of m sampled values at most `allowed` that the container lacks; the values that no other set has are such, and of the others so many of the rarest as the allowance still asks for
are its keys: one of them at least is in every container. That is a banding of its own for each partition: its bound says how many values, its allowance how many bands.
A Jaccard of t asks the same of sets of one partition or the next, and bounds the bits in which their samples' bitmaps may differ.

Pairs that share a key and whose bitmaps allow it are held against each other by their whole sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, stored, text_of
from .links import apart_pairs, components, merged_roots, star_pairs
from .sketches import ERRORS, FULL, SMALL, alike_buckets, alike_possible, bound, rare_keys, seen, shared_values, small_traits
from .texts import slices

WORDS = 5
THRESHOLD = 0.8
#: Bits of the filter that holds the shingles of sets sampled whole. Its size is fixed (8 MB): more of them only let more values of larger sets through, none is lost.
FILTER_BITS = 1 << 26
LARGE = 16  # longs of the large bitmaps
#: What stands between words: anything but letters, numerals and underscores.
NO_WORD = r"[^\pL\pN_]+"
#: Bytes of words that are hashed at once.
BLOCK = 1 << 20
#: Whole words between white space, each different one of which starts a shingle of its own (but for the last four).
PLAIN_WORD = r"(?<=\s)[a-z0-9_]++(?=\s)"


def jaccard_needed(threshold: float, q: int, u: int) -> float:
    """The Jaccard of two sets of q and u (the larger) shingles if the smaller is contained by the threshold."""
    return threshold * q / (q + u - threshold * q)


def allowed(m, n, threshold: float = THRESHOLD, xp=np):
    """Of m sampled values of a set of n, how many its container may lack: exact if all are sampled, else with ERRORS standard errors."""
    whole = xp.floor(n * (1 - threshold) + 1e-9)
    return xp.where(m >= n, whole, xp.floor(m * (1 - threshold) + ERRORS * xp.sqrt(m * (threshold * (1 - threshold)) * (1 - m / xp.maximum(n, 1))) + 0.5))


def word_hashes(words) -> np.ndarray:
    """A 64-bit hash of each string of an Arrow array: a polynomial of its bytes, each replaced by a random number, and mixed. BLOCK bytes at a time."""
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    table = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(np.diff(ends).max()), 0xD6E8FEB86659FD93, np.uint64))])
    out, at = np.empty(len(words), np.uint64), 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        first = ends[at:to] - ends[at]
        lengths = np.diff(ends[at : to + 1])
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        out[at:to] = np.add.reduceat(table[data[ends[at] : ends[to]]] * power[place], first)
        at = to
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def shingle_sets(texts) -> list[np.ndarray]:
    """For each text of an Arrow array the different 64-bit hashes of all runs of five lower-cased words, ascending; a shorter text is one run; one without words has none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.string())), pattern=NO_WORD)
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    many = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    w = word_hashes(words.filter(full))
    offsets = split.offsets.to_numpy()
    bounds = many[offsets - offsets[0]].tolist()

    def runs(n: int, of: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(of) - n + 1, np.uint64)
        for i in range(n):
            mixed = (mixed ^ of[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed

    all_ = runs(WORDS, w) if len(w) >= WORDS else w
    none = np.zeros(0, np.uint64)
    return [np.unique(all_[a : b - WORDS + 1]) if b - a >= WORDS else runs(b - a, w[a:b]) if b > a else none for a, b in zip(bounds, bounds[1:], strict=False)]


def shingle_hashes(text: str) -> np.ndarray:
    import pyarrow as pa

    return shingle_sets(pa.array([text], pa.string()))[0]


def _below(s: np.ndarray, share: float) -> int:
    """How many of the ascending values are below that share of all."""
    return len(s) if share >= 1 else int(np.searchsorted(s, np.uint64(share * 2.0**64)))


def _bitmap(s: np.ndarray, longs: int, parity: bool = False) -> np.ndarray:
    """A bit for each value, by bits that neither the samples' bounds nor the filter look at; with parity, whether an odd number of values falls on it.

    Parities of what two sets share cancel out, so that sets differ in at least as many values as their bits do, and hardly in more as long as these are few; containment needs plain bits.
    """
    at = ((s >> np.uint64(27)) & np.uint64(64 * longs - 1)).astype(np.int64)
    count = np.bincount(at, minlength=64 * longs)
    return np.packbits((count & 1 if parity else count > 0).astype(np.uint8), bitorder="little").view(np.uint64)


def _signed(s: np.ndarray) -> np.ndarray:
    """As bigint in the same order."""
    return (s ^ np.uint64(1 << 63)).view(np.int64)


# -- samples -----------------------------------------------------------------------------------------------------------------


def small_set_filter(docs: DataFrame) -> np.ndarray:
    """FILTER_BITS bits with one for each shingle of a set of fewer than 2**FULL. Words are combined on the executors; at most FILTER_BITS / 64 reach the driver."""
    plain = F.size(F.array_distinct(F.regexp_extract_all(F.substring(F.lower("text"), 1, 1500), F.lit(PLAIN_WORD), F.lit(0))))
    rows = docs.select(text_of().alias("text")).where(plain < (1 << FULL) + WORDS - 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for part in slices(batch, 0):
                found += [s for s in shingle_sets(part.column(0)) if len(s) < 1 << FULL]
            at = np.unique(np.concatenate(found) & np.uint64(FILTER_BITS - 1))
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = rows.mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


SAMPLE_SCHEMA = "doc_id bigint, h bigint, g bigint, n int, p int, m int, near int, upper int, s0 int, s1 int, vals array<bigint>, small array<bigint>, large binary"


def samples(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, h (hash of the text), g (hash of its shingle set), n (its size), p (partition), and of its values those that others may look for.

    vals has first the m sampled values; then, ascending, those that a smaller set's sample or the filter of small sets asks for; the first m + near are below the bound of
    partition p - 1, and the first upper below that of FULL. small: parity bitmaps of the sample and of the values below the bound of p - 1 (s1 of them);
    large: three bitmaps of the values below the bound that takes 2**FULL of 2**p, half of it and a quarter. A null text is empty.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(small_set_filter(docs))

    def run(batches):
        import pyarrow as pa
        import xxhash

        bits = shipped.value
        low = np.uint64(FILTER_BITS - 1)
        for batch in batches:
            for part in slices(batch, 2):
                out = {k: [] for k in ("g", "n", "p", "m", "near", "upper", "s0", "s1", "vals", "small", "large")}
                for s in shingle_sets(part.column(2)):
                    n = len(s)
                    p = max(0, n.bit_length() - 1)
                    m, upper = _below(s, bound(p)), _below(s, bound(FULL))
                    near, s0, s1 = _below(s, bound(p - 1)), _below(s, seen(p)), _below(s, seen(p - 1))
                    if p >= FULL:
                        rest = s[upper:]
                        at = rest & low
                        rest = rest[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                        vals = np.concatenate([s[:upper], rest])
                    else:
                        vals = s
                    out["g"].append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                    out["n"].append(n)
                    out["p"].append(p)
                    out["m"].append(m)
                    out["near"].append((len(vals) if p <= FULL else near) - m)
                    out["upper"].append(upper if p >= FULL else m)
                    out["s0"].append(s0)
                    out["s1"].append(s1)
                    out["vals"].append(_signed(vals))
                    out["small"] += [_bitmap(s[:s0], SMALL, parity=True), _bitmap(s[:s1], SMALL, parity=True)]
                    out["large"].append(np.concatenate([_bitmap(s[: _below(s, 2.0 ** (FULL - max(p, FULL) - i))], LARGE) for i in range(3)]).tobytes())
                lengths = np.cumsum([0, *map(len, out["vals"])])
                arrays = [part.column(0), part.column(1), pa.array(out["g"], pa.int64()), *(pa.array(out[k], pa.int32()) for k in ("n", "p", "m", "near", "upper", "s0", "s1"))]
                arrays += [pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(out["vals"]), pa.int64()))]
                arrays += [pa.ListArray.from_arrays(pa.array(np.arange(len(out["n"]) + 1) * 2 * SMALL, pa.int32()), pa.array(np.concatenate(out["small"]).view(np.int64), pa.int64())), pa.array(out["large"], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "g", "n", "p", "m", "near", "upper", "s0", "s1", "vals", "small", "large"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, SAMPLE_SCHEMA)


# -- candidates --------------------------------------------------------------------------------------------------------------


def likely(pairs: DataFrame, sets: DataFrame, threshold: float, contained: bool) -> DataFrame:
    """The pairs (a, b) that the large bitmaps allow to be contained (a in b, or the smaller in the larger) or to be alike by the threshold."""
    traits = sets.select("id", "n", "large")
    both = pairs.join(traits.withColumnsRenamed({"id": "a", "n": "na", "large": "la"}), "a").join(traits.withColumnsRenamed({"id": "b", "n": "nb", "large": "lb"}), "b")
    both = both.where(F.col("nb") >= F.col("na")) if contained else both.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            la, lb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, 3, LARGE) for i in (4, 5))
            swap = na > nb
            na, nb = np.minimum(na, nb), np.maximum(na, nb)
            la, lb = np.where(swap[:, None, None], lb, la), np.where(swap[:, None, None], la, lb)
            pa_, pb = (np.maximum(np.frexp(n)[1] - 1, FULL) for n in (na, nb))
            gap = pb - pa_
            mine = la[np.arange(len(la)), np.minimum(gap, 2)]
            lacks = np.bitwise_count(mine & ~lb[:, 0]).sum(1)
            share = 2.0 ** np.minimum(0, FULL - pb)  # of the smaller set's values, that many are below the larger one's bound
            need = threshold if contained else 2 * threshold / (1 + threshold)
            whole = np.floor(na * (1 - need) + 1e-9)
            some = np.floor(na * share * (1 - need) + ERRORS * np.sqrt(na * share * (1 - need) * (1 - share)) + 0.5)
            ok = (gap > 2) | (lacks <= np.where(share >= 1, whole, some))
            yield batch.select([0, 1]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "la", "lb").mapInArrow(run, "a bigint, b bigint")


class Sets:
    """The whole shingle sets of those documents that a pair has asked for, packed from the texts once, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes, self.tables = docs, nodes, []

    def add(self, pairs: DataFrame) -> None:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if self.tables:
            wanted = wanted.join(self.all().select("id"), "id", "left_anti")
        wanted = wanted.join(self.nodes.select("id", "doc_id", "h"), "id").withColumnsRenamed({"doc_id": "own_id", "h": "own_h"})
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
        texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))).select("id", "text")

        def pack(batches):
            import pyarrow as pa

            def packed(sets):
                return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))

            for batch in batches:
                for part in slices(batch, 1):
                    yield pa.RecordBatch.from_arrays([part.column(0), packed(shingle_sets(part.column(1)))], names=["id", "s"])

        self.tables.append(stored(texts.mapInArrow(pack, "id bigint, s array<bigint>").dropDuplicates(["id"]), "near-sets"))

    def all(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b, na, nb, shared: exact sizes of the two sets and of what they share."""
        self.add(pairs)
        sets = self.all()
        both = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
        return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))

    def drop(self) -> None:
        for t in self.tables:
            discard(t)


# -- classes -----------------------------------------------------------------------------------------------------------------


def alike_roots(sets: DataFrame, index: DataFrame, whole: Sets, threshold: float) -> DataFrame:
    """(node, root): components of all verified links of Jaccard `threshold` or more between sets that share a key."""
    spark = sets.sparkSession
    buckets = alike_buckets(index)
    near = F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared"))
    first = stored(likely(star_pairs(buckets), sets, threshold, False), "near-likely")
    release(spark)
    roots = stored(components(stored(whole.verified(first).where(near).select("a", "b"), "near-links")), "near-roots")
    release(spark)
    apart = apart_pairs(buckets, roots, small_traits(sets), alike_possible(threshold), near=1)
    more = stored(likely(apart, sets, threshold, False), "near-apart")
    discard(apart.rooted)
    discard(buckets)
    discard(first)
    out = merged_roots(roots, whole.verified(more).where(near))
    discard(more)
    return out


def containers(sets: DataFrame, index: DataFrame, named: DataFrame, heads: DataFrame, whole: Sets, threshold: float) -> DataFrame:
    """a, b, na, nb, shared: every head a that is contained by `threshold` in a set b of another component. named: id, comp, rank; heads: comp, x."""
    comp = named.select("id", "comp")
    rows = stored(index.select("v", "id", "p", "own", "wide").join(comp, "id"), "near-outer")
    # a value of one component only is one that every container of another lacks
    outer = rows.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("v", "df")
    rows_of = stored(rows.join(outer.hint("shuffle_hash"), "v"), "near-outer")
    discard(rows)
    own = rows_of.join(heads.select(F.col("x").alias("id")), "id")
    keys = rare_keys(own, sets, threshold)
    keys = keys.withColumnRenamed("id", "a").join(own.select(F.col("id").alias("a"), "v", F.col("p").alias("pa"), F.col("comp").alias("ca")), ["a", "v"])
    others = rows_of.select("v", F.col("id").alias("b"), F.col("p").alias("pb"), F.col("comp").alias("cb"))
    pairs = keys.join(others, "v").where((F.col("pb") >= F.col("pa")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()
    found = stored(likely(pairs, sets, threshold, True), "near-containers")
    discard(rows_of)
    release(sets.sparkSession)
    out = stored(whole.verified(found).where((F.col("nb") >= F.col("na")) & (F.col("shared") >= threshold * F.col("na"))), "near-contained")
    discard(found)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, h, class_id, kept, n_shingles for every row of docs.

    Documents of Jaccard `threshold` or more are joined into components. A component whose largest member is contained by `threshold` in a document of another one joins that one (the
    best container; never two containers through something small that both hold). class_id is the doc_id of the class's largest set, ties to
    the smaller doc_id, null ids last; that row is kept. Equal sets, so all texts without words too, are one node and always of one class. Rows equal in
    doc_id and text are both kept or both not; `without_near_duplicates` returns one of them. A null or empty text has no shingle; a text shorter than five words is a single
    one; a very long text is a larger set, packed as eight bytes a shingle. No rows give no rows. Only doc_id and text are read, so other columns' names can't clash.

    No group's pairs are all emitted: a bucket's sets are first held against one of them, and only those that are still in different components against each other, in blocks, by bitmaps.
    """
    rows = stored(samples(docs), "near-samples")
    slim = stored(rows.select("doc_id", "h", "g", "n"), "near-rows")
    sets = rows.groupBy(F.col("g").alias("id")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("f"), *[F.first(c).alias(c) for c in ("n", "p", "m", "near", "upper", "s0", "s1", "vals", "small", "large")])
    sets = stored(sets.select("id", "f.doc_id", "f.h", "n", "p", "m", "near", "upper", "s0", "s1", "vals", "small", "large"), "near-nodes")
    discard(rows)
    release(docs.sparkSession)
    index = shared_values(sets, threshold)
    release(docs.sparkSession)
    whole = Sets(docs, sets)
    roots = alike_roots(sets, index, whole, threshold)
    order = F.struct("n", (-F.coalesce("doc_id", F.lit(1 << 62))).alias("o"), F.col("id").alias("node"))
    named = sets.select("id", "doc_id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).withColumn("rank", order)
    named = stored(named.select("id", "comp", "rank"), "near-components")
    heads = named.groupBy("comp").agg(F.max("rank").alias("rank")).select("comp", F.col("rank.node").alias("x"))
    links = containers(sets, index, named, heads, whole, threshold)
    whole.drop()
    discard(index)
    up = links.join(named.select(F.col("id").alias("a"), "comp", F.col("rank").alias("ra")), "a").join(named.select(F.col("id").alias("b"), F.col("comp").alias("to"), F.col("rank").alias("rb")), "b")
    up = up.where((F.col("to") != F.col("comp")) & (F.col("rb") > F.col("ra"))).groupBy("comp").agg(F.max_by("to", F.struct(F.col("shared") / F.col("na"), "rb")).alias("to"))
    trees = components(up.select(F.col("comp").alias("a"), F.col("to").alias("b")))
    classed = named.join(trees.select(F.col("node").alias("comp"), F.col("root").alias("tree")), "comp", "left").withColumn("tree", F.coalesce("tree", "comp"))
    tops = classed.groupBy("tree").agg(F.max("rank").alias("top")).select("tree", F.col("top.node").alias("top"))
    tops = tops.join(sets.select(F.col("id").alias("top"), F.col("doc_id").alias("class_id"), F.col("h").alias("class_h")), "top")
    nodes = stored(classed.join(tops, "tree").select(F.col("id").alias("g"), "class_id", "class_h"), "near-classes")
    discard(sets)
    discard(links)
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))
    return slim.join(nodes, "g").select("doc_id", "h", "class_id", kept.alias("kept"), F.col("n").alias("n_shingles"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, one for each class, with the columns of docs, whatever their names."""
    kept = near_duplicates(docs, threshold).where("kept").select("doc_id", "h").distinct()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text_of()).alias("own_h"))
    out = own.join(kept, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h")))
    return out.dropDuplicates(["own_id", "own_h"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "kept", "n_shingles")
