"""Near copies by exact Jaccard similarity: the near-duplicate stage of the pipeline.

A document is its set of word shingles, as XXH64 hashes. Two documents are near copies if their sets have a Jaccard similarity of at least
``ALIKE``; linked documents form a component.

Equal sets are one row. Candidates come from operator 7 first: each set has its SimHash fingerprint, fingerprints that differ in at most
``simhash.BITS`` places are found by the pivot distance tables, and each component of them is a bucket. That radius holds most pairs of a
similarity of 0.96 or more and few at 0.8, so sets that agree in one of ``BANDS`` bands of ``ROWS`` minimum hashes each share a bucket too,
which a pair of similarity s does with probability 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8. Every link is then verified by the exact
similarity of the two sets, so none is false. Buckets with the same members are looked at once. A bucket is walked breadth first, so that a tight cluster
costs one comparison per member and leaves a spanning tree, not all pairs; a bucket of more than ``SLICE_SHINGLES`` shingles is dealt
out as pairs of slices over several tasks, each of bounded size. None is capped. Only documents that share a bucket are read again
for their shingles.

Edge cases: null and empty texts are one set, the empty one; fewer words than a shingle are one shingle; repeated rows share a
component; rows without doc_id take part, and a component's first document is one with a doc_id if there is any; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import simhash
from veilspan.llm.common import arrow_stage, cut_lineage, raw_text, slices
from veilspan.llm.simhash import components, first_rows, majority, row_key, shingles, text_key

WORDS = 5
#: Similarity of 4 / 5 or more, as a fraction of whole numbers.
ALIKE = (4, 5)
BANDS, ROWS = 16, 4
SLICE_SHINGLES = 2_000_000
#: Hashes mixed at once.
STEP = 4096
MIXERS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, width: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(shingles(text, width))


def buckets(own: np.ndarray) -> list[int]:
    """One key for each band, as signed longs."""
    least = np.full(len(MIXERS), np.iinfo(np.uint64).max)
    for begin in range(0, len(own), STEP):
        np.minimum(least, (own[begin : begin + STEP, None] * MIXERS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def marked(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, text_key, set_key, size, fingerprint (of the set, as a signed long) and buckets of each row."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for part in (x for batch in batches for x in slices(batch, 2)):
            sets = [shingle_set(x, width) for x in part.column(2).to_pylist()]
            fps = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
            yield {"doc_id": part.column(0), "text_key": part.column(1), "set_key": [set_key(x) for x in sets], "size": [len(x) for x in sets], "fp": fps, "buckets": [buckets(x) for x in sets]}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), raw_text().alias("text"))
    return arrow_stage(texts, rows, "doc_id long, text_key long, set_key binary, size long, fp long, buckets array<long>")


def walk(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning trees of the links among ``sets``: each found set is met once and never compared again."""
    sizes = np.array([len(x) for x in sets])
    over, under = ALIKE
    rest = np.arange(len(sets))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            at = front.pop()
            own, n = sets[at], sizes[at]
            # sets whose sizes differ by more cannot be alike
            able = (under * np.minimum(sizes[rest], n) >= over * np.maximum(sizes[rest], n)) & (n > 0)
            some = rest[able]
            if len(some):
                flat, of = np.concatenate([sets[k] for k in some]), np.repeat(np.arange(len(some)), sizes[some])
                place = np.minimum(np.searchsorted(own, flat), n - 1)
                both = np.bincount(of[own[place] == flat], minlength=len(some))
                new = some[under * both >= over * (n + sizes[some] - both)]
                yield from ((at, int(k)) for k in new)
                front += new.tolist()
                rest = np.setdiff1d(rest, new, assume_unique=True)


def met_by_pivots(distinct: DataFrame) -> DataFrame:
    """The same rows, with one more bucket: the component of their fingerprint by operator 7. A fingerprint that links to none is its own."""
    found = components(simhash.links(distinct.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    component = F.xxhash64(F.lit("component"), F.coalesce("root", "fp"))
    return distinct.join(found, "fp", "left").withColumn("buckets", F.concat("buckets", F.array(component))).drop("root")


def links(docs: DataFrame, distinct: DataFrame, width: int = WORDS, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """a, b: verified links that span the components of the set keys."""
    placed = met_by_pivots(distinct).select("set_key", "size", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("set_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_key")).alias("y")
    ).where("members > 1")
    chosen = shared.groupBy("members", "size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("size") / slice_shingles).cast("int").alias("slices"))
    members = cut_lineage(placed.drop("size").join(chosen, "bucket"), "members")

    def rows(batches: Iterator[pa.RecordBatch]):
        for part in (x for batch in batches for x in slices(batch, 0)):
            sets = [shingle_set(x, width) for x in part.column(0).to_pylist()]
            yield {"set_key": [set_key(x) for x in sets], "shingles": [x.tobytes() for x in sets]}

    wanted = distinct.join(members.select("set_key").distinct(), "set_key", "left_semi").select(*row_key(F.col("first.doc_id"), F.col("first.text_key")))
    texts = docs.select(raw_text().alias("text"), *row_key(F.col("doc_id").cast("long"), text_key())).join(wanted, wanted.columns, "left_semi").select("text")
    sets = arrow_stage(texts, rows, "set_key binary, shingles binary").dropDuplicates(["set_key"])
    own = members.withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("slices")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.least("own", j).cast("long") * F.col("slices") + F.greatest("own", j))
    dealt = own.join(sets, "set_key").select("bucket", F.explode(pairs).alias("slice"), "set_key", "shingles")
    groups = dealt.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice")

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def found(batches: Iterator[pa.RecordBatch]):
        for _, group in groupby(read(batches), lambda r: r[:2]):
            keys, sets_of = [], []
            for _, _, key, raw in group:
                keys.append(key)
                sets_of.append(np.frombuffer(raw, np.uint64))
            if edges := list(walk(sets_of)):
                yield {"a": [keys[i] for i, _ in edges], "b": [keys[j] for _, j in edges]}

    return arrow_stage(groups, found, "a binary, b binary")


def grouped(docs: DataFrame, width: int = WORDS, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """doc_id, text_key, root: rows of one component share their root."""
    rows = cut_lineage(marked(docs, width), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    distinct = cut_lineage(rows.groupBy("set_key").agg(first, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "distinct-sets")
    roots = components(links(docs, distinct, width, slice_shingles)).select(F.col("node").alias("set_key"), "root")
    return rows.select("doc_id", "text_key", "set_key").join(roots, "set_key", "left").select("doc_id", "text_key", F.coalesce("root", "set_key").alias("root"))


def one_of_each(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """The document with the least doc_id of each component, with all its columns; of equal rows one stays."""
    return first_rows(docs, grouped(docs, width), "root")
