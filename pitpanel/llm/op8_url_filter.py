"""URL filtering: a blocked Bloom filter in front of an exact hash join.

Listed are rules (host, path, verdict), which fit their host and its subdomains where
the url's path starts with the rule's, and single canonical urls (host and path without
a last slash), which are blocked. Every entry is one key. A page has few keys of its
own: its host and as many parent domains as the longest rule host has labels, each with
the beginnings of its path in the lengths that rules have, and its canonical url.

The keys' hashes go through a Bloom filter whose bits for a key lie in one 64-bit block.
Pages of which no key passes are judged at once and shuffled no more. Keys that pass are
counted and meet the table of entries in an inner equi-join, once each, which removes the
false ones; what is found goes back to the pages, keys of many pages by broadcast. The
filter itself is of bounded size: beyond ``LIMIT_BLOCKS`` only more keys pass it.

Defined results: a null url, or one without ``://``, has an empty host and path, meets
no rule and is allowed; the longest rule (host and path) wins, among equals the one with
the longer host, then ``allow``; repeated rows give repeated rows; null entries of the
list are left out; an empty table gives an empty one; other columns are left out. Urls of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import cut, meet

#: (verdict, host, path) of the fixed list of rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
BITS_A_KEY = 16
PROBES = 6
#: 64-bit blocks of the filter at most: 64 MB.
LIMIT_BLOCKS = 8_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The key of a single url; an ``=`` keeps it apart from rules. Null without a host."""
    return F.when(host != "", F.concat(F.lit("="), host, F.regexp_replace(path, "/$", "")))


def mask_of(hashes: np.ndarray) -> np.ndarray:
    """PROBES bits of one 64-bit block, from the hash's upper bits."""
    h, out = hashes.astype(np.uint64), np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
    for k in range(PROBES):
        out |= np.uint64(1) << ((mixed >> np.uint64(6 * k + 10)) & np.uint64(63))
    return out


class BlockedBloom:
    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        mask = mask_of(hashes)
        return self.blocks[hashes.astype(np.uint64) % np.uint64(len(self.blocks))] & mask == mask


def build(entries: DataFrame, limit_blocks: int = LIMIT_BLOCKS) -> BlockedBloom:
    """The filter of the entries' keys; tasks set bits, Spark unites blocks with OR."""
    count = entries.count()
    size = int(min(max(count * BITS_A_KEY // 64, 1), limit_blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            block, mask = h % np.uint64(size), mask_of(h)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(mask.view(np.int64))], names=["block", "bits"])

    rows = entries.select(F.xxhash64("key")).mapInArrow(run, "block bigint, bits bigint").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    blocks = np.zeros(size, np.uint64)
    made = rows.toArrow()
    blocks[made.column("block").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return BlockedBloom(blocks)


def entries_of(spark: SparkSession, rules: list[tuple[str, str, str]], listed: DataFrame | None) -> DataFrame:
    """``key, rule, host_len, verdict`` of all entries; ``rule`` is null for a single url."""
    rows = [(host + path, host + path, len(host), verdict) for verdict, host, path in rules]
    out = spark.createDataFrame(rows, "key string, rule string, host_len int, verdict string")
    if listed is not None:
        host, path = host_and_path(F.col("url").cast("string"))
        urls = listed.select(canonical(host, path).alias("key")).dropna().distinct()
        out = out.unionByName(urls.select("key", F.lit(None).cast("string").alias("rule"), F.lit(0).alias("host_len"), F.lit("block").alias("verdict")))
    return out


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, listed: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", limit_blocks: int = LIMIT_BLOCKS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page; ``listed`` has a column url."""
    spark = pages.sparkSession
    entries = entries_of(spark, rules, listed)
    bloom = spark.sparkContext.broadcast(build(entries, limit_blocks))
    labels = max([host.count(".") + 1 for _, host, _ in rules], default=0)
    lengths = sorted({len(path) for _, _, path in rules})
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    parents = [F.substring_index("host", ".", -k) for k in range(1, labels + 1)]
    keys = [F.when((F.col("host") != "") & (F.length("path") >= n), F.concat(p, F.substring("path", 1, n))) for p in parents for n in lengths]
    rows = rows.withColumn("keys", F.array_distinct(F.array_compact(F.array(*keys, canonical(F.col("host"), F.col("path"))))))
    rows = rows.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "hashes")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(5)
            good = bloom.value.passes(held.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            keys = batch.column(4)
            offsets = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            left = np.concatenate([[0], np.cumsum(good)])[offsets].astype(np.int32)
            passed = pa.ListArray.from_arrays(pa.array(left), keys.flatten().filter(pa.array(good)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], passed], names=["row", "page_id", "host", "path", "keys"])

    passed = rows.mapInArrow(probe, kinds)
    none = passed.filter(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    some = cut(passed.filter(F.size("keys") > 0))
    each = some.select("row", F.explode("keys").alias("key"))
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "host_len", F.when(F.col("verdict") == "allow", 1).otherwise(0), "rule", "verdict"))).alias("best")
    single = F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("single")
    found = each.groupBy("key").agg(F.count("*").alias("n")).join(entries, "key").groupBy("key").agg(F.first("n").alias("n"), best, single)
    met = meet(each, cut(found), "key", each.count())
    one = met.groupBy("row").agg(F.max("best").alias("best"), F.max("single").alias("single"))
    judged = some.join(one, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "single", F.lit("allow")).alias("verdict"))
    return none.unionByName(judged)


#: The query's list of single urls: the pages whose host has a label beginning so.
SPAM = r"(^|\.)spam-"

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH rules(verdict, h, p) AS (VALUES {', '.join(map(str, RULES))}),
cut AS (SELECT row_number() OVER () AS r, page_id,
               CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT r, page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
urls AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '') END AS canon FROM parts),
listed AS (SELECT DISTINCT canon FROM urls WHERE regexp_matches(host, '{SPAM}')),
fit AS (SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, verdict) AS k
        FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.verdict, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN fit ON fit.r = urls.r AND k = 1 LEFT JOIN listed ON listed.canon = urls.canon
"""
