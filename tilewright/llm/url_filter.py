"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of its possible hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_WORDS = 8  # 512-bit blocks
BITS_PER_KEY = 16


@dataclass(frozen=True)
class Rule:
    """A rule fits a host and its subdomains where the url's path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: The block list of the query holds the canonical URL of every page whose host has one of these words between dots and hyphens.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or where :// is missing."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def canonical_url(host: Column, path: Column) -> Column:
    """Host without a leading www. or m. and path without trailing slashes, .html or index pages; scheme, query and fragment go."""
    bare = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"(?:index)?\.html?$", ""), r"/+$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does. Equally long rules: the first listed."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(range(len(rules)), key=lambda i: (len(rules[i].text), -i))
    for i in ordered:
        rule = rules[i]
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _bits(key: Column) -> list[tuple[Column, Column]]:
    """Word and bit for each of four probes, from the bits of one hash that the block number doesn't use."""
    h = F.xxhash64(key, F.lit(1))
    return [(F.shiftrightunsigned(h, 9 * i).bitwiseAND(7).cast("int"), F.shiftrightunsigned(h, 9 * i + 3).bitwiseAND(63).cast("int")) for i in range(4)]


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row for each block that has a key: block, words array<bigint>. Map-side bit_or leaves at most a row per block and task."""
    k = F.col(key)
    words = [F.lit(0).cast("long") for _ in range(BLOCK_WORDS)]
    for word, bit in _bits(k):
        words = [w.bitwiseOR(F.when(word == j, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))) for j, w in enumerate(words)]
    rows = listed.where(k.isNotNull()).select(F.pmod(F.xxhash64(k), F.lit(n_blocks)).alias("block"), *[w.alias(f"w{j}") for j, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(BLOCK_WORDS)])


def possible_hits(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """df with maybe_listed: false means that its key is surely not listed."""
    k = F.col(key)
    probed = df.withColumn("_block", F.pmod(F.xxhash64(k), F.lit(n_blocks))).join(checked_broadcast(blocks.withColumnRenamed("block", "_block"), n_blocks, 8 * (BLOCK_WORDS + 1)), "_block", "left")
    hit = F.lit(True)
    for word, bit in _bits(k):
        of = F.lit(0).cast("long")
        for j in range(BLOCK_WORDS):
            of = F.when(word == j, F.col(f"w{j}")).otherwise(of)
        hit = hit & (F.call_function("shiftrightunsigned", of, bit).bitwiseAND(1) == 1)
    return probed.withColumn("maybe_listed", k.isNotNull() & F.col("w0").isNotNull() & F.coalesce(hit, F.lit(False))).drop("_block", *[f"w{j}" for j in range(BLOCK_WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every row of pages: the longest rule that fits decides; else rows with a listed canonical URL are blocked and all others allowed.

    listed has a column canonical; repeats and nulls in it don't matter. A null or schemeless url has empty host and path, fits no rule
    and is allowed (its canonical form is empty, which is never listed). An empty list allows all that no rule blocks. Repeated page
    ids are judged row by row; other columns of pages are not read, so their names can't clash. A url of any length is judged whole. No rows give no rows.
    """
    listed = listed.select("canonical").where(F.length("canonical") > 0).distinct()
    n = listed.count()
    n_blocks = max(1, -(-n * BITS_PER_KEY // (64 * BLOCK_WORDS)))
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", text.alias("rule"), verdict.alias("_rule_verdict"), canonical_url(F.col("host"), F.col("path")).alias("canonical"))
    probed = possible_hits(rows, "canonical", bloom_blocks(listed, "canonical", n_blocks), n_blocks)
    # only possible hits carry a join key: all others leave the exact join at once and spread by their page id
    keyed = probed.withColumn("_key", F.when(F.col("maybe_listed") & F.col("_rule_verdict").isNull(), F.col("canonical")))
    exact = checked_broadcast(listed.select(F.col("canonical").alias("_key"), F.lit(True).alias("_listed")), n, 120)
    sure = keyed.where(F.col("_key").isNull()).withColumn("_listed", F.lit(None).cast("boolean"))
    hits = keyed.where(F.col("_key").isNotNull()).join(exact, "_key", "left").select(*sure.columns)
    return sure.unionByName(hits).select("page_id", "host", "path", "rule", F.coalesce("_rule_verdict", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"), F.coalesce("_listed", F.lit(False)).alias("listed"))


def _listed_host(words=LISTED_WORDS) -> str:
    return f"(^|[.-])({'|'.join(words)})([.-]|$)"


def listed_urls(pages: DataFrame, words=LISTED_WORDS) -> DataFrame:
    """Canonical URLs of the pages whose host has a listed word: a list that grows with the pages."""
    host = url_host(F.col("url"))
    return pages.where(host.rlike(_listed_host(words))).select(canonical_url(host, url_path(F.col("url"))).alias("canonical")).where(F.length("canonical") > 0).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages))


_PARTS = r"""
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages"""


def _fits(rule: Rule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


def oracle(rules=RULES, words=LISTED_WORDS) -> str:
    by_length = sorted(rules, key=lambda r: -len(r.text))
    text = " ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in by_length)
    verdict = " ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in by_length)
    return f"""
WITH parts AS ({_PARTS}),
judged AS (
  SELECT *, CASE {text} END AS rule, CASE {verdict} END AS rule_verdict,
         regexp_replace(host, '^(?:www|m)\\.', '') || regexp_replace(regexp_replace(path, '(?:index)?\\.html?$', ''), '/+$', '') AS canonical
  FROM parts),
listed AS (SELECT DISTINCT canonical FROM judged WHERE regexp_matches(host, '{_listed_host(words)}') AND canonical <> '')
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       (rule_verdict IS NULL AND l.canonical IS NOT NULL) AS listed
FROM judged j LEFT JOIN listed l ON j.canonical = l.canonical"""
