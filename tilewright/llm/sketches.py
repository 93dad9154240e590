"""Candidate pairs from samples of sets: values below a bound that falls with a set's size, keys of the rarest of them, bitmaps. DataFrame functions only.

Tables of sets have id, n (size), p (partition: 2**p <= n < 2**(p + 1)), vals (of the set's hashes those that others may look for: first the m below the bound of p, then, up to m + near,
those below the bound of p - 1), upper (how many of the first are a wider sample, m if there is none), small (two bitmaps of SMALL longs: of the hashes below `seen(p)` of all and of those below
`seen(p - 1)`), s0 and s1 (how many hashes these two stand for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Least number of sampled values of a set, on average.
SAMPLE = 12
#: Sets of fewer than 2**FULL hashes are sampled whole.
FULL = 6
#: Standard errors by which a sample may miss what its set promises.
ERRORS = 2.6
SMALL = 4  # longs of a small bitmap
#: Least number of values that a small bitmap stands for, on average; all of a set of fewer.
SEEN = 64


def bound(p: int) -> float:
    """The share of all hashes that the sample of a set of 2**p or more takes."""
    return 1.0 if p < FULL else min(1.0, SAMPLE / 2.0**p)


def seen(p: int) -> float:
    """The share of all hashes that the small bitmap of such a set takes."""
    return min(1.0, SEEN / 2.0**p)


def _allowed_column(m: Column, n: Column, threshold: float) -> Column:
    whole = F.floor(n * F.lit(1 - threshold) + 1e-9)
    return F.when(m >= n, whole).otherwise(F.floor(m * F.lit(1 - threshold) + ERRORS * F.sqrt(m * F.lit(threshold * (1 - threshold)) * (1 - m / n)) + 0.5)).cast("int")


def rare_keys(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, v): keys of the sets. rows: id, v, df, p, own, wide, for the values that a partner may have; all other values are ones that it lacks.

    The rarest values of the sample are keys, one more than the allowance leaves after those that no partner has. A set whose wide sample (`upper` values) lacks too many has none.
    """
    mine = rows.where(F.col("own") | F.col("wide")).groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("df", "v")))).alias("mine"), F.count_if("wide").alias("seen"))
    mine = mine.join(sets.select("id", "n", "m", "upper"), "id").where(F.col("upper") - F.col("seen") <= _allowed_column(F.col("upper"), F.col("n"), threshold))
    left = _allowed_column(F.col("m"), F.col("n"), threshold) - (F.col("m") - F.size("mine")) + 1
    return mine.where(left > 0).select("id", F.explode(F.slice("mine", F.lit(1), left)).alias("x")).select("id", F.col("x.v").alias("v"))


def shared_values(sets: DataFrame, threshold: float) -> DataFrame:
    """v, id, p, df, own, near, wide, low and lead for every value that two sets or more have been asked for: lead marks the keys of id for a Jaccard of threshold.

    own: v is in id's sample; near: below the bound of p - 1; wide: in the wide sample; low: id is small enough to be alike to a set of partition p - 1.
    """
    pos = F.col("pos")
    flag = lambda test, bit: F.when(test, bit).otherwise(0)
    flags = flag(pos < F.col("m"), 1) + flag(pos < F.col("m") + F.col("near"), 2) + flag(F.col("n") * threshold <= F.pow(F.lit(2.0), F.col("p")), 8) + flag(pos < F.col("upper"), 16) + F.col("p") * 32
    values = sets.where("n > 0").select("id", "n", "p", "m", "near", "upper", F.posexplode("vals").alias("pos", "v")).select("v", "id", flags.cast("int").alias("flags"))
    often = values.groupBy("v").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    has = lambda name, bit: (F.col("flags").bitwiseAND(bit) != 0).alias(name)
    rows = values.join(often.hint("shuffle_hash"), "v").select("v", "id", "df", F.floor(F.col("flags") / 32).cast("int").alias("p"), has("own", 1), has("near", 2), has("low", 8), has("wide", 16))
    rows = stored(rows, "near-values")
    # a Jaccard of t holds 2 t / (1 + t) of the smaller set in the larger one
    keys = rare_keys(rows, sets, 2 * threshold / (1 + threshold)).withColumn("lead", F.lit(True))
    out = stored(rows.join(keys, ["v", "id"], "left").withColumn("lead", F.coalesce("lead", F.lit(False))), "near-index")
    discard(rows)
    return out


def alike_buckets(index: DataFrame) -> DataFrame:
    """key, q, id, lead, n, leads, hub: the sets of partition q, and those of the next that may be alike to them, by shared value; each bucket has a set of which it is a key."""
    qs = F.array_compact(F.array(F.when(F.col("own"), F.col("p")), F.when(F.col("low") & F.col("near") & (F.col("p") > 0), F.col("p") - 1)))
    rows = index.select("v", "id", "p", "lead", F.explode(qs).alias("q")).select(F.xxhash64("v", "q").alias("key"), "q", "id", (F.col("lead") & (F.col("p") == F.col("q"))).alias("lead"))
    of = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("lead").alias("leads"), F.max(F.struct("lead", "id")).alias("hub")).where("n > 1 AND leads > 0")
    return stored(rows.join(of.select("key", "n", "leads", F.col("hub.id").alias("hub")).hint("shuffle_hash"), "key"), "near-buckets")


def alike_possible(threshold: float, glance: float | None = None):
    """Of two rows of a bucket: whether their bitmaps' difference allows a Jaccard of threshold. Samples get ERRORS standard errors, whole sets none, and glances as many as are given."""

    def test(left: str, right: str) -> Column:
        a, b = F.col(f"{left}s"), F.col(f"{right}s")
        differ = F.lit(0)
        for w in range(SMALL):
            differ = differ + F.bit_count(F.col(f"{left}b{w}").bitwiseXOR(F.col(f"{right}b{w}")))
        of = (a + b) / (1 + threshold)  # the union of sets of that Jaccard
        slack = (glance or ERRORS) * F.sqrt(of * (threshold * (1 - threshold))) + 1
        if glance is None:
            slack = F.when(F.pow(F.lit(2.0), F.col("q")) > SEEN, slack).otherwise(1e-9)
        return differ <= of * (1 - threshold) + slack

    return test


def small_traits(sets: DataFrame) -> DataFrame:
    """id, q, s and b0 to b3: a row for the set's own partition and one for that below it."""
    each = F.array(*[F.struct((F.col("p") - i).alias("q"), F.col(f"s{i}").alias("s"), *[F.col("small")[SMALL * i + w].alias(f"b{w}") for w in range(SMALL)]) for i in range(2)])
    return sets.where("n > 0").select("id", F.explode(each).alias("x")).select("id", "x.*")
