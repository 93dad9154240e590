"""Candidate links from buckets, first one for each member and then all that are still apart, and connected components by distributed union-find. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, stored

#: Members of one block: blocks are compared in pairs, each pair in a task of its own.
BLOCK = 1024


def star_buckets(rows: DataFrame) -> DataFrame:
    """The rows (key, id) whose key others have too, with n (the bucket's size) and hub (its largest id), stored in the shared folder."""
    rows = rows.repartition("key")  # once, for both what follows
    of = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("hub")).where("n > 1")
    return stored(rows.join(of.hint("shuffle_hash"), "key"), "star-buckets")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b), a < b, of each bucket's hub and each other member: a cheap beginning, `apart_pairs` has what it leaves in different components."""
    return buckets.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def in_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of a bucket's members, to be joined by key, i and j. members: key, id, n (the bucket's size) and others, which are named r_... on the right.

    A bucket is dealt into blocks of about BLOCK members; a pair of blocks i <= j meets once. Where i = j the caller keeps id < r_id. If members have lead and leads (how many lead
    in the bucket), the left side has only those that lead, and the caller keeps pairs of two that lead where id < r_id.
    """
    own = lambda parts: F.pmod(F.xxhash64("id"), F.ceil(F.col(parts) / BLOCK).cast("int")).cast("int")
    if "lead" in members.columns:
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.ceil(F.col(parts) / BLOCK).cast("int") - 1))
        left = members.where("lead").withColumn("i", own("leads")).withColumn("j", every("n"))
        right = members.withColumn("j", own("n")).withColumn("i", every("leads"))
    else:
        left = members.withColumn("i", own("n")).withColumn("j", F.explode(F.sequence("i", F.ceil(F.col("n") / BLOCK).cast("int") - 1)))
        right = members.withColumn("j", own("n")).withColumn("i", F.explode(F.sequence(F.lit(0), "j")))
    left, right = left.drop("n", "leads"), right.drop("n", "leads")
    return left, right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in ("key", "q", "i", "j")})


def apart_pairs(members: DataFrame, roots: DataFrame, traits: DataFrame, possible, near: int = 1) -> DataFrame:
    """All pairs (a, b), a < b, of members of one bucket that are in different components: none is left out but those that possible(prefix, prefix) rules out.

    members: key, id, n, as stored before, perhaps with lead and leads (then only pairs with one that leads count); roots: node, root; traits: id (and what
    else they share with members) and what `possible` looks at. Buckets of up to near + 1 members had
    every pair before, and those within one component are settled. The pairs of a bucket are tried in blocks, and only possible ones leave the join.
    """
    columns = [c for c in members.columns if c in {"key", "id", "n", "lead", "leads", "q"}]
    big = members.where(F.col("n") > near + 1).select(*columns).join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    big = stored(big, "bucket-roots")
    unsettled = big.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left, right = in_blocks(big.join(unsettled.hint("shuffle_hash"), "key").join(traits, [c for c in traits.columns if c in columns]))
    once = (~F.col("r_lead") if "lead" in columns else F.col("i") < F.col("j")) | (F.col("id") < F.col("r_id"))
    pairs = left.join(right, [c for c in ("key", "q", "i", "j") if c in left.columns]).where((F.col("root") != F.col("r_root")) & once & possible("", "r_"))
    out = pairs.select(F.least("id", "r_id").alias("a"), F.greatest("id", "r_id").alias("b")).distinct()
    out.rooted = big  # the stored table that the pairs read
    return out


def merged_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components that roots and further links (a, b) make together. A link joins whole components, so that one for each two of them is enough."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    joined = links.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left")
    joined = stored(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct(), "joins")
    top = components(joined)
    named = roots.unionByName(joined.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("root"))).distinct()
    out = named.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    out = stored(out.select("node", F.coalesce("top", "root").alias("root")), "merged-roots")
    discard(joined)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component. Alternating large and small stars.

    All minima are map-side combined; each round's table is checkpointed in the shared folder. Nothing but a count and a sum goes to the driver.
    """
    e = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = checkpointed(small.distinct())
        new = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
