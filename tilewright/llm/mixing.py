"""Mixing sources to target weights, with DataFrame functions only.

Each source's words are packed, document after document in a pseudorandom order, into blocks of fixed length. A slot of the mix takes one block. How many slots of each source an
output shard gets is drawn without replacement (a multinomial draw given the totals, so that totals meet the targets exactly); the slots that a source got walk through its
blocks by a pseudorandom permutation of indices, a new one for each pass; blocks and documents meet in a join on (source, block index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, let, stored, text_of

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
TASK_SLOTS = 1 << 18
BUCKET_DOCS = 512
#: Rows of a window at most, when buckets or shards are summed up.
STRETCH = 4096
#: Cells in which the source of a slot is looked up.
CELLS = 4096
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def permuted(i: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 applied to i: four Feistel rounds on an a x b grid with a*b >= n, again while the result is n or more.

    Fewer than a of the grid's cells are out of range, so the walk ends: within 24 steps for sure where a <= 24, and else but for odds below a**-24.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")

    def walk(side: Column) -> Column:
        a, b, n = side["a"], side["b"], side["n"]

        def once(x: Column) -> Column:
            def turn(s: Column, k: Column) -> Column:
                left = F.struct(((s["l"] + F.pmod(F.xxhash64(*seed, k, s["r"]), a)) % a).alias("l"), s["r"].alias("r"))
                right = F.struct(s["l"].alias("l"), ((s["r"] + F.pmod(F.xxhash64(*seed, k, s["l"]), b)) % b).alias("r"))
                return F.when(k % 2 == 0, left).otherwise(right)

            start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
            return F.aggregate(F.array(*[F.lit(k) for k in range(4)]), start, turn, lambda s: s["l"] * b + s["r"])

        def step(s: Column, _: Column) -> Column:
            return F.when(s["done"], s).otherwise(let(once(s["x"]), lambda y: F.struct(y.alias("x"), (y < n).alias("done"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(side["i"].alias("x"), F.lit(False).alias("done")), step, lambda s: s["x"])

    return let(F.struct(i.cast("long").alias("i"), n.cast("long").alias("n"), a.alias("a"), F.greatest(F.ceil(n / a), F.lit(1)).cast("long").alias("b")), walk)


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, h (hash of the text) and the number of words of each row; a null text has none."""
    return docs.select("doc_id", "source", F.xxhash64(text_of()).alias("h"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, src (its place by code point, null last), source_size, source_docs, target.

    Targets are least(most * size, level * weight) with the level at which they sum to all words: what a source can't take is reshared by
    weight until none is above. The windows are over sources, whose number a catalogue bounds, not over documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src") % len(weights)) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs")).select("source", (F.row_number().over(ordered) - 1).alias("src"), "source_size", "source_docs").withColumn("w", share)
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "src")
    rows = rows.withColumns({
        "below": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(Window.partitionBy()),
    })
    rows = rows.withColumn("level", (F.col("all") - F.col("below")) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("level", level).select("source", "src", "source_size", "source_docs", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def running(rows: DataFrame, group: list[str], order: str, value: str, name: str, step: int) -> DataFrame:
    """rows with name: the sum of value in the group before the row, by order (0, 1, ...). In two steps, so that no window holds more than `step` rows of a group."""
    parts = rows.withColumn("stretch", F.floor(F.col(order) / step))
    sums = parts.groupBy(*group, "stretch").agg(F.sum(value).alias("all_of"))
    ahead = Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("all_of").over(ahead) - F.col("all_of")).drop("all_of")
    within = Window.partitionBy(*group, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("within", F.sum(value).over(within) - F.col(value)).join(sums, [*group, "stretch"])
    return out.withColumn(name, F.col("before") + F.col("within")).drop("stretch", "before", "within")


def packed(sizes: DataFrame, sources: DataFrame, n_sources: int, seed: int = SEED) -> DataFrame:
    """sizes with src, source_size, target and start: the place of the document's first word among its source's words, which are cut into blocks.

    Prefix sums in steps: a source's documents fall by a hash into buckets of about BUCKET_DOCS, so that no window holds a whole source.
    """
    cat = checked_broadcast(sources, n_sources, 64)
    order = F.xxhash64(F.lit(seed), F.col("d.doc_id"), F.col("d.size"))
    rows = sizes.alias("d").join(cat.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.source", "d.h", "d.size", "src", "source_size", "target", order.alias("ord"), F.ceil(F.col("source_docs") / BUCKET_DOCS).alias("buckets"))
    rows = rows.withColumn("bucket", F.pmod(F.col("ord"), F.col("buckets"))).drop("buckets")
    sums = running(rows.groupBy("src", "bucket").agg(F.sum("size").alias("n")), ["src"], "bucket", "n", "base", STRETCH).select("src", "bucket", "base")
    within = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("ord", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("inner", within).join(sums.hint("merge"), ["src", "bucket"]).select("doc_id", "source", "h", "size", "src", "source_size", "target", (F.col("base") + F.col("inner")).alias("start"))


def source_slots(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source that the mix takes words of: src, n and t (words it has and gives), blocks, full (those of whole length), passes (over all blocks), rest (words of the last pass), slots, first and total.

    Slots of all sources are numbered one after the other: a source's are first to first + slots - 1 of total.
    """
    b = F.lit(block_words).cast("long")
    s = sources.where((F.col("source_size") > 0) & (F.col("target") > 0)).select("src", F.col("source_size").alias("n"), F.round("target").cast("long").alias("t"))
    s = s.withColumns({"full": F.floor(F.col("n") / b).cast("long"), "blocks": F.ceil(F.col("n") / b).cast("long"), "passes": F.floor(F.col("t") / F.col("n")).cast("long"), "rest": F.col("t") % F.col("n")})
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long")).where("slots > 0")
    return s.withColumns({"first": F.sum("slots").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slots"), "total": F.sum("slots").over(Window.partitionBy())})


def shard_counts(slots: DataFrame, total: int, n_sources: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED, tasks: int = 8) -> DataFrame:
    """shard, src, n: the multinomial draw of each output shard, given the sources' totals (so without replacement), as totals have to meet the targets.

    A shard's places draw by a pseudorandom permutation of all slots; the source whose slots hold the number drawn is the one. No table of slots is shuffled for that.
    """
    spark = slots.sparkSession
    width = max(1, -(-total // CELLS))
    ranges = slots.select("src", "first", (F.col("first") + F.col("slots")).alias("end"), F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("slots") - 1) / width))).alias("cell"))
    shards = spark.range(0, -(-total // shard_slots), 1, tasks).withColumnRenamed("id", "shard")
    places = shards.select("shard", F.explode(F.sequence(F.col("shard") * shard_slots, F.least(F.lit(total), (F.col("shard") + 1) * shard_slots) - 1)).alias("place"))
    drawn = places.select("shard", permuted(F.col("place"), F.lit(total).cast("long"), F.lit(seed + 1)).alias("slot")).withColumn("cell", F.floor(F.col("slot") / width))
    held = drawn.join(checked_broadcast(ranges, n_sources + CELLS, 40), "cell").where((F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("end")))
    return held.groupBy("shard", "src").agg(F.count("*").alias("n"))


def mix_slots(counts: DataFrame, slots: DataFrame, n_sources: int, block_words: int = BLOCK_WORDS, seed: int = SEED, tasks: int = 8) -> DataFrame:
    """Every slot of the mix: shard, src, pass, block, words (block_words, fewer in a source's last block and in its last slot).

    A source's slots of a shard follow those of the shards before it. They walk through the source's blocks by a pseudorandom permutation of the index, a new one for each pass: whole passes
    take each block once, and the last as many as it needs, so that the words are round(target) to the word.
    """
    b = F.lit(block_words).cast("long")
    rows = running(counts, ["src"], "shard", "n", "before_it", STRETCH).join(checked_broadcast(slots.withColumnRenamed("n", "words_of"), n_sources, 96), "src")
    # a row becomes up to a shard's slots: their bytes don't tell Spark how many tasks they are worth
    rows = rows.repartition(tasks, "shard", "src").select("*", F.explode(F.sequence(F.col("before_it"), F.col("before_it") + F.col("n") - 1)).alias("i"))
    rows = rows.withColumns({"pass": F.floor(F.col("i") / F.col("blocks")).cast("long"), "j": F.col("i") % F.col("blocks")})
    block = F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.col("full"), F.lit(seed), F.col("src"), F.col("pass"))).otherwise(F.col("full"))
    rows = rows.withColumn("block", block)
    words = F.when(F.col("pass") < F.col("passes"), F.least(b, F.col("words_of") - F.col("block") * b)).otherwise(F.least(b, F.col("rest") - F.col("j") * b))
    return rows.select("shard", "src", "pass", "block", words.alias("words"), (F.col("pass") < F.col("passes")).alias("whole"))


def taken_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """For each row of docs: doc_id, source, h, size, source_size, target, start, taken, whole (passes that take all its words) and ranges (from, to: its words in blocks of the last pass)."""
    spark = docs.sparkSession
    sizes = stored(document_sizes(docs), "mix-sizes")
    sources = stored(source_targets(sizes, weights, most), "mix-sources")
    n_sources, n_words = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    rows = packed(sizes, sources, n_sources, seed)
    empty = F.array().cast("array<struct<from:int,to:int>>")
    none = rows.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "whole": F.lit(0).cast("long"), "ranges": empty})
    columns = ["doc_id", "source", "h", "size", "source_size", "target", "start", "taken", "whole", "ranges"]
    slots = stored(source_slots(sources, block_words), "mix-slots")
    total = slots.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if not total:
        return none.select(*columns)
    tasks = max(spark.sparkContext.defaultParallelism, n_words // block_words // TASK_SLOTS)
    counts = stored(shard_counts(slots, total, n_sources, seed=seed, tasks=tasks), "mix-counts")
    uses = mix_slots(counts, slots, n_sources, block_words, seed, tasks).groupBy("src", "block").agg(F.count_if("whole").alias("whole"), F.coalesce(F.max(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("part"))
    b = F.lit(block_words).cast("long")
    touched = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / b).cast("long"))))
    at = F.col("block") * b
    lo, hi = F.greatest(F.col("start") - at, F.lit(0)), F.least(F.col("start") + F.col("size") - at, b)
    # blocks and documents meet by index; uses grows with the words, so it is never broadcast
    met = touched.withColumns({"lo": lo, "hi": hi}).join(uses.hint("merge"), ["src", "block"], "left").fillna(0, ["whole", "part"])
    last = F.greatest(F.lit(0), F.least("hi", "part") - F.col("lo"))
    met = met.withColumns({"taken": F.col("whole") * (F.col("hi") - F.col("lo")) + last, "from": (at + F.col("lo") - F.col("start")).cast("int"), "last": last.cast("int")})
    part = F.when(F.col("last") > 0, F.struct("from", (F.col("from") + F.col("last")).alias("to")))
    some = met.groupBy("src", "start", "doc_id", "source", "h", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max("whole").alias("whole"), F.sort_array(F.collect_list(part)).alias("ranges"))
    return some.select(*columns).unionByName(none.select(*columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    A null or empty text has size 0 and takes nothing; a source without words has target 0. A null source is a source of its own, ordered last.
    Repeated rows and doc_ids are rows of their own; a very long text fills more blocks; no rows give no rows. Words are counted exactly: a source's taken words sum to round(target),
    and each block is taken at most `most` times, so no document takes more than `most` times its size. The draw depends on the rows and the seed only: reruns agree. Only
    doc_id, source and text are read, so other columns' names can't clash.
    """
    return taken_rows(docs, weights, most, block_words, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """docs as the mix takes them: a row for each pass that takes all its words, and one with the words of its blocks that the last pass drew, with the white space behind them.

    So a source's words are round(target). A row of which nothing is taken goes, one without words stays. The columns are those of docs, whatever their names; only text is changed.
    """
    key = lambda h: F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull(), h)
    nth = lambda by: F.row_number().over(Window.partitionBy("key").orderBy(by))
    # of rows equal in doc_id, source and text the first gets the first taking, and so on
    takes = taken_rows(docs, seed=seed, **options).where("size > 0").select(key(F.col("h")).alias("key"), "start", "whole", "ranges").withColumn("take", nth("start")).drop("start")
    own = docs.select(F.struct("*").alias("row"), key(F.xxhash64(text_of())).alias("key")).withColumn("nth", nth("key"))
    own = own.join(takes.withColumnRenamed("key", "take_key"), (F.col("key") == F.col("take_key")) & (F.col("nth") - F.col("take") == 0), "left")
    copies = F.when(F.col("whole").isNull(), 1).otherwise(F.col("whole") + F.when(F.size("ranges") > 0, 1).otherwise(0)).cast("int")
    rows = own.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    pieces = let(F.regexp_extract_all(F.col("row")["text"], F.lit(WORD + r"[\x20\x09-\x0D]*+"), F.lit(0)), lambda w: F.concat_ws("", F.flatten(F.transform("ranges", lambda r: F.slice(w, r["from"] + 1, r["to"] - r["from"])))))
    text = F.when(F.col("whole").isNull() | (F.col("copy") <= F.col("whole")), F.col("row")["text"]).otherwise(pieces)
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
