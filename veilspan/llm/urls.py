"""Operator 1, URL filters: a Bloom filter cascade over the corpus's complete key universe.

Keys are hosts and their parent domains. Level 0 is a Bloom filter of the listed keys; the universe's other keys that pass it by
mistake are level 1; the listed keys that pass level 1 by mistake are level 2; and so on until a level lets nothing wrong through.
A key of the universe is listed if the first level that rejects it is odd, or if it passes all of an odd number of levels: exact
membership, with no join of pages with the list. The list is a table of domains. Keys are dealt over shards by hash, by the number of all keys, and one task makes
all levels of a shard from at most about ``SHARD_KEYS`` keys, as two 64-bit numbers each. The filters are a table in the shared folder; no filter
of all shards is ever in one place. They are judged by in groups of at most ``GROUP_BYTES`` (or one shard): a group is sent, the pages are read past it, and it is
let go before the next one, so that the driver and each executor hold one group at a time.

A stated rule (host and its subdomains, path prefix) that fits a url comes first, the longest one wins.

Edge cases: a null url and one without ``://`` have an empty host and path, which no rule fits and no list names, so they are allowed;
an empty list blocks nothing, null domains on it and domains that the corpus does not have change nothing, and domains listed twice count once; an empty table gives
an empty table; repeated rows are judged one by one; ids may be null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import cut_lineage, query, read

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Names that put a domain on the list, as one label of the host.
LISTED_NAMES = ["ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"]
BITS_PER_KEY, HASHES = 10, 7
SHARD_KEYS = 1_000_000
GROUP_BYTES = 64 << 20
#: Levels shrink by about a hundred each; only two keys with the same 128 bits would never be told apart.
MOST_LEVELS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(begin)
        name, verdict = F.when(fits, at + begin).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def domains(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


@dataclass(frozen=True)
class Cascade:
    """filters: shard, levels (bit arrays); groups: the first and last shard of each group that is sent together."""

    shards: int
    filters: DataFrame
    groups: list[tuple[int, int]]


def _numbers(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), key).alias("ab"[k]) for k in (0, 1)]


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)).cast("int")


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit number for each level, by multiplying and shifting."""
    with np.errstate(over="ignore"):
        y = x.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return y ^ (y >> np.uint64(31))


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """The bit numbers of all keys under one hash after the other, by double hashing."""
    at, step = _mixed(a, level), _mixed(b, level) | np.uint64(1)
    for _ in range(HASHES):
        yield (at >> np.uint64(11)) % np.uint64(size)
        with np.errstate(over="ignore"):
            at = at + step


def passes(bits: bytes, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    array = np.frombuffer(bits, np.uint8)
    good = np.ones(len(a), bool)
    for at in _places(a, b, level, 8 * len(array)):
        good &= (array[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return good


def filter_of(a: np.ndarray, b: np.ndarray, level: int, bits_per_key: int) -> bytes:
    size = max(8, (len(a) * bits_per_key + 7) // 8)
    bits = np.zeros(8 * size, bool)
    for at in _places(a, b, level, 8 * size):
        bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def levels_of(a: np.ndarray, b: np.ndarray, listed: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> list[bytes]:
    """All levels for the keys of a shard."""
    levels: list[bytes] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed key and another one have the same 128 bits")
        levels.append(filter_of(a[inside], b[inside], len(levels), bits_per_key))
        wrong = outside[passes(levels[-1], a[outside], b[outside], len(levels) - 1)]
        inside, outside = wrong, inside
    return levels


def found(levels: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed, by the first level that rejects it."""
    out, alive = np.full(len(a), len(levels) % 2 == 1), np.arange(len(a))
    for level, bits in enumerate(levels):
        good = passes(bits, a[alive], b[alive], level)
        out[alive[~good]] = level % 2 == 1
        alive = alive[good]
    return out


def build(keys: DataFrame, shard_keys: int = SHARD_KEYS, group_bytes: int = GROUP_BYTES, bits_per_key: int = BITS_PER_KEY) -> Cascade:
    """``keys``: key, listed (the universe, each key once). One shuffle of 21 bytes a key, then one task a shard."""

    def levels(group: pa.Table) -> pa.Table:
        a, b, listed = (group.column(c).to_numpy() for c in ("a", "b", "listed"))
        return pa.Table.from_pydict({"shard": group.column("shard")[:1], "levels": [levels_of(a, b, listed.astype(bool), bits_per_key)]}, schema=pa.schema([("shard", pa.int32()), ("levels", pa.list_(pa.binary()))]))

    keys = cut_lineage(keys.select(*_numbers(F.col("key")), "key", "listed"), "universe")
    shards = max(1, -(-keys.count() // shard_keys))
    dealt = keys.select(_shard(F.col("key"), shards).alias("shard"), "a", "b", "listed")
    filters = cut_lineage(dealt.groupBy("shard").applyInArrow(levels, "shard int, levels array<binary>").where(F.size("levels") > 0), "cascade")
    size = F.aggregate("levels", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    groups: list[tuple[int, int]] = []
    held = 0
    for r in filters.select("shard", size.alias("size")).orderBy("shard").toLocalIterator():  # two numbers a shard
        if not groups or held + r["size"] > group_bytes:
            groups.append((r["shard"], r["shard"]))
            held = 0
        groups[-1] = (groups[-1][0], r["shard"])
        held += r["size"]
    return Cascade(shards, filters, groups)


def mark_listed(keys: Column, cascade: Cascade, df: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean column ``out``: whether any of the array ``keys`` is listed. Only meaningful for keys of the universe."""
    context = df.sparkSession.sparkContext
    probes = F.transform(keys, lambda k: F.struct(_shard(k, cascade.shards).alias("shard"), *_numbers(k)))
    wide = df.withColumns({out: F.lit(False), "__probes": probes})
    for i, (first, last) in enumerate(cascade.groups):
        rows = cascade.filters.where(F.col("shard").between(first, last)).collect()  # at most GROUP_BYTES, or one shard
        sent = context.broadcast({r["shard"]: [bytes(x) for x in r["levels"]] for r in rows})
        wide = wide.mapInArrow(_tested(sent, wide.columns.index(out)), wide.schema)
        if i + 1 < len(cascade.groups):  # the next group comes once this one is done with
            wide = cut_lineage(wide, "judged")
            sent.unpersist()
    return wide.drop("__probes")


def _tested(sent, at: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = sent.value
        for batch in batches:
            probes = batch.column(batch.num_columns - 1)
            flat = probes.flatten()
            owner = np.repeat(np.arange(len(probes)), np.diff(probes.offsets.to_numpy()))
            shard, a, b = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("shard", "a", "b"))
            order = np.argsort(shard, kind="stable")
            listed = np.zeros(len(shard), bool)
            for here in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(here) and int(shard[here[0]]) in group:
                    listed[here] = found(group[int(shard[here[0]])], a[here], b[here])
            columns = list(batch.columns)
            hit = np.array(columns[at].to_pylist(), bool)
            hit[owner[listed]] = True
            columns[at] = pa.array(hit)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows


def hosts_named(pages: DataFrame, names: list[str]) -> DataFrame:
    """key: a list made from the corpus, of the domains whose first label is one of ``names``."""
    keys = pages.select(F.explode(domains(host_of(F.col("url")))).alias("key")).distinct()
    return keys.where(F.split("key", r"\.")[0].isin(names)) if names else keys.limit(0)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of ``pages``. ``blocked``: key, domains that are listed with all their subdomains."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = parsed.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    # subdomains are met through their parents; of the list only what the universe has is kept
    both = universe.select("key", F.lit(False).alias("listed"), F.lit(True).alias("met")).unionByName(blocked.select("key", F.lit(True).alias("listed"), F.lit(False).alias("met")))
    keys = both.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed"), F.max("met").alias("met")).where("met").select("key", "listed")
    seen = mark_listed(domains(F.col("host")), build(keys), parsed, "listed")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def _sql() -> str:
    part = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = "(host = '{1}' or ends_with(host, '.{1}')) and starts_with(path, '{2}')"
    rule = " ".join(f"when {fits.format(*r)} then '{r[1]}{r[2]}'" for r in order)
    verdict = " ".join(f"when {fits.format(*r)} then '{r[0]}'" for r in order)
    names = ", ".join(f"'{x}'" for x in LISTED_NAMES)
    return f"""
with parsed as (select page_id, translate({part.format(1)}, '{UPPER}', '{LOWER}') as host, {part.format(2)} as path from pages),
seen as (select *, len(list_intersect(string_split(host, '.'), [{names}])) > 0 as listed from parsed)
select page_id, host, path, case {rule} end as rule, case {verdict} when listed then 'block' else 'allow' end as verdict, listed from seen
"""


@query("op1_url_cascade", _sql())
def op1_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    return judge(pages, RULES, hosts_named(pages, LISTED_NAMES))
