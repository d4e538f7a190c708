"""URL filter: a blocked Bloom filter of listed keys lets possible hits through to an exact hash join.

A listed entry is a host with a path, either a rule (allow or block; it fits its host and all subdomains, if the url's
path starts with the rule's) or the canonical form of one listed url, which is blocked where no rule fits. Every url
has a few candidate keys: each suffix of its host with each prefix of its path whose length occurs in the list, and
its canonical form. The filter says in one cache line per key whether it may be listed; only those keys are joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import BROADCAST_BYTES, mix, prepare, stored

BITS_A_KEY, WORDS, HASHES = 16, 8, 8  #: a block has 8 words of 64 bits; each key sets one bit in each word
MAX_BYTES = 32 << 20  #: of a filter; a longer list is split over several, used one after the other


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a www. label, a trailing slash and an .html ending; query and fragment are gone already."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


class BlockedBloom:
    """Bits of a power-of-two number of 512-bit blocks; the first hash picks the block, the next ones a bit a word."""

    def __init__(self, keys: int):
        self.blocks = 1 << max(0, int(np.ceil(np.log2(max(1, keys) * BITS_A_KEY / 512))))
        self.bits = np.zeros((self.blocks, WORDS), np.uint64)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = (mix(h) & np.uint64(self.blocks - 1)).astype(np.int64)
        g = mix(h + np.uint64(0x9E3779B97F4A7C15))
        shift = np.arange(WORDS, dtype=np.uint64) * np.uint64(6)
        return block, np.uint64(1) << ((g[:, None] >> shift) & np.uint64(63))

    def add(self, h: np.ndarray) -> None:
        block, bits = self._places(h)
        np.bitwise_or.at(self.bits, block, bits)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        block, bits = self._places(h)
        return ((self.bits[block] & bits) == bits).all(axis=1)


def key_hash(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _build(blocks: int):
    """Filters of the partitions; or-ed into one by block."""

    def run(batches):
        bloom = BlockedBloom(1)
        bloom.blocks, bloom.bits = blocks, np.zeros((blocks, WORDS), np.uint64)
        some = False
        for pdf in batches:
            if len(pdf):
                bloom.add(key_hash(pdf["key"].tolist()))
                some = True
        if some:
            used = np.flatnonzero(bloom.bits.any(axis=1))
            yield pd.DataFrame({"block": used, **{f"w{i}": bloom.bits[used, i].view(np.int64) for i in range(WORDS)}})

    return run


def build_filter(keys: DataFrame, n: int) -> BlockedBloom:
    """The filter of keys(key): partitions fill their own, blocks are or-ed by an aggregation, the driver gets the blocks."""
    bloom = BlockedBloom(n)
    schema = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))
    parts = keys.select("key").mapInPandas(_build(bloom.blocks), schema)
    rows = parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).toPandas()
    for i in range(WORDS):
        bloom.bits[rows["block"].to_numpy(), i] = rows[f"w{i}"].to_numpy().view(np.uint64)
    return bloom


def candidates(host: str, path: str, exact: str, lengths: list[int]) -> list[str]:
    """Keys under which a listed entry may fit: r:host suffix and path prefix, u:canonical url."""
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [f"r:{s}{path[:n]}\n{len(s)}" for s in suffixes for n in lengths if n <= len(path)] + [f"u:{exact}"]


def _probe(bloom: BlockedBloom, lengths: list[int]):
    def run(batches):
        for pdf in batches:
            keys = [candidates(h, p, e, lengths) for h, p, e in zip(pdf["host"], pdf["path"], pdf["exact"])]
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat = [k for x in keys for k in x]
            hit = np.flatnonzero(bloom.may_hold(key_hash(flat)))
            urls = pdf["url"].tolist()
            yield pd.DataFrame({"url": [urls[i] for i in owner[hit].tolist()], "key": [flat[i] for i in hit.tolist()]}, columns=["url", "key"], dtype=object)

    return run


def possible_hits(urls: DataFrame, entries: DataFrame, total: int, lengths: list[int]) -> DataFrame:
    """(url, key) of urls(url, host, path, exact): the keys that a filter lets pass. A list that fills several filters
    is dealt over them by hash; each is built, sent, used and dropped before the next, its hits being stored."""
    parts = max(1, -(-total * BITS_A_KEY // 8 // MAX_BYTES))
    found = None
    for i in range(parts):
        some = entries.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == i)
        hits = urls.mapInPandas(_probe(build_filter(some, -(-total // parts)), lengths), "url string, key string")
        if parts > 1:
            hits = stored(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    return found


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row of pages(page_id, url, ...).

    rules(host, path, verdict): the longest fitting one (host and path together; then the longer host) decides.
    listed(url): a url with the same canonical form is blocked where no rule fits; all others are allowed.
    - Null url or one without `://`: host and path are empty, no rule fits, allowed.
    - Repeated rows are judged alike, one by one; null page_id is a value like any other. Repeated rules with other
      verdicts: `allow`, the smallest, holds. Extra columns are ignored; empty rules and lists let all pass.
    """
    prepare(pages.sparkSession)
    kind = rules.select(F.concat(F.lit("r:"), "host", "path", F.lit("\n"), F.char_length("host")).alias("key"), F.concat("host", "path").alias("rule"), F.char_length("host").alias("n"), F.char_length("path").alias("depth"), "verdict")
    exact = listed.where("url is not null").select(F.concat(F.lit("u:"), canonical(host_of(F.col("url")), path_of(F.col("url")))).alias("key")).distinct()
    entries = kind.groupBy("key", "rule", "n", "depth").agg(F.min("verdict").alias("verdict"))
    entries = entries.unionByName(exact.withColumn("verdict", F.lit("block")), allowMissingColumns=True)
    total, width, lengths = entries.agg(F.count("*"), F.coalesce(F.max(F.octet_length("key")), F.lit(0)), F.sort_array(F.collect_set("depth"))).first()
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # each distinct url is probed once; a hot host is many urls, a hot url one row a task
    probed = urls.select("url", "host", "path", canonical(F.col("host"), F.col("path")).alias("exact")).distinct()
    hits = possible_hits(probed.where("url is not null"), entries, total, lengths)
    side = F.broadcast(entries) if total * (3 * width + 64) <= BROADCAST_BYTES else entries
    order = F.struct(F.char_length("rule").alias("size"), "n", "rule", "verdict")
    found = hits.join(side, "key").groupBy("url").agg(F.max(F.when(F.col("rule").isNotNull(), order)).alias("best"), F.max(F.col("rule").isNull()).alias("in_list"))
    out = urls.join(found, "url", "left")
    rule, hit = F.col("best.rule"), F.coalesce("in_list", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(hit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), hit.alias("listed"))
