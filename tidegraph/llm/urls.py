"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact join.

A listed URL is a host and a path (`example.com/en/`). For each URL the candidates are its host and every parent
domain, each with the starts of its path that are as long as some listed path. A candidate's hash picks one block of
the filter and the bits that must be set in it. URLs without a candidate that passes are done; the others' candidates
go to the join with the list, which drops those that passed by chance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import maybe_broadcast

#: Bytes of a block; bits tested in it; most bytes of a filter (a larger list passes more by chance, and the join drops that).
BLOCK, PROBES, MOST = 32, 4, 8 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Else both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _bit(h: Column, probe: int) -> Column:
    """Which of a block's bits a probe tests."""
    return F.shiftrightunsigned(h, 32 + 8 * probe).bitwiseAND(F.lit(255)).cast("int")


def bloom(listed: DataFrame, n: int, bits_per_key: int = 16) -> bytes:
    """A blocked filter of n keys (listed), set by an aggregate per block: at most MOST bytes reach the driver, however long the list is."""
    blocks = min(1 << max(0, math.ceil(math.log2(max(1, n * bits_per_key / 8 / BLOCK)))), MOST // BLOCK)
    h = F.xxhash64("listed")
    word = lambda w: reduce(Column.bitwiseOR, [F.when(F.shiftright(_bit(h, p), 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h, p).bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")) for p in range(PROBES)])
    rows = listed.groupBy(h.bitwiseAND(F.lit(blocks - 1)).cast("int").alias("block")).agg(*(F.bit_or(word(w)).alias(f"w{w}") for w in range(4))).toPandas()
    table = np.zeros((blocks, 4), "<i8")
    table[rows["block"].to_numpy(np.int64)] = rows[[f"w{w}" for w in range(4)]].to_numpy(np.int64)
    return table.tobytes()


def might_hold(filter_: bytes, key: Column) -> Column:
    """Whether the filter passes a key: all its bits are set in its block. The filter stands in the plan once."""
    h = F.xxhash64(key)
    block = F.substr(F.lit(filter_), h.bitwiseAND(F.lit(len(filter_) // BLOCK - 1)).cast("int") * BLOCK + 1, F.lit(BLOCK))

    def all_set(b: Column) -> Column:
        tests = []
        for p in range(PROBES):
            byte = F.conv(F.hex(F.substr(b, F.shiftright(_bit(h, p), 3) + 1, F.lit(1))), 16, 10).cast("int")
            tests.append(F.floor(byte / F.pow(F.lit(2), _bit(h, p).bitwiseAND(F.lit(7)))) % 2 == 1)
        return reduce(Column.__and__, tests)

    return F.exists(F.array(block), all_set)


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of pages -> page_id, host, path, rule, verdict.

    rules: (host, path, verdict) rows, any number. A rule fits its host and all subdomains if the URL's path starts with the
    rule's. The longest fitting rule (host and path together, then host, then text) gives the verdict; a URL that no
    rule fits isn't listed and gets `default`. Null URLs and those without :// have empty host and path, which no rule
    with a host fits. Repeated rows each get a row; of rules that repeat a host and path, the first by verdict holds.
    Empty pages: no rows; empty rules: default for all. Only URLs that the filter passes are joined and grouped.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    listed = rules.groupBy(F.concat("host", "path").alias("listed"), F.length("host").alias("host_length")).agg(F.min("verdict").alias("listed_verdict")).filter("listed is not null")
    about = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("listed") - F.col("host_length"))).alias("lengths")).first()
    host, path = split_url(F.col(url))
    base = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    plain = ["page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not about["n"]:
        return base.select(*plain)
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    starts = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in about["lengths"]]), lambda x: x.isNotNull()))
    candidates = F.flatten(F.transform("domains", lambda d: F.transform("starts", lambda s: F.struct(F.concat(d, s).alias("listed"), F.length(d).alias("host_length")))))
    filter_ = bloom(listed, about["n"])
    passed = F.filter(candidates, lambda c: might_hold(filter_, c["listed"]))
    tried = base.withColumn("domains", domains).withColumn("starts", starts).withColumn("c", passed)
    misses = tried.filter(F.size("c") == 0).select(*plain)
    hits = tried.filter(F.size("c") > 0).select("row", "page_id", "host", "path", F.explode("c").alias("c")).select("row", "page_id", "host", "path", "c.*").join(maybe_broadcast(listed), ["listed", "host_length"], "left")
    best = F.max(F.when(F.col("listed_verdict").isNotNull(), F.struct(F.length("listed").alias("n"), "host_length", "listed", "listed_verdict")))
    found = hits.groupBy("row", "page_id", "host", "path").agg(best.alias("b")).select("page_id", "host", "path", F.col("b.listed").alias("rule"), F.coalesce("b.listed_verdict", F.lit(default)).alias("verdict"))
    return found.unionByName(misses)
