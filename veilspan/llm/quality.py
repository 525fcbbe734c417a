"""Operator 4, quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Word unigrams and bigrams are hashed into ``BUCKETS`` buckets. Two multinomials are counted, one over the documents that a
bounded sample of labels calls good, one over the whole corpus; a document's score is the mean over its n-grams of
``log p_target - log p_raw``. A document stays if it passes the base rules and its score reaches the threshold, which is
placed between the labelled good and bad scores of the same bounded sample.

Edge cases: null text has no words, all counts are 0 and the base rules reject it; a null doc_id is scored like any other and is
never labelled; repeated rows are judged one by one; an empty table gives an empty table; without labels on either
side the threshold is minus infinity, so that only the base rules decide. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import arrow_stage, handing_back, query, raw_text, read

BUCKETS = 10_000
#: Labelled rows that the target multinomial and the threshold are fitted on, at most.
LABELLED_ROWS = 4_000
#: Good labelled documents that the threshold may lose, as a share.
GOOD_LOSS = 0.002
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def ngram_buckets(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every unigram and bigram of one document."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    keys = np.concatenate([h * np.uint64(0xFF51AFD7ED558CCD), pairs * np.uint64(0x165667B19E3779F9)])
    return ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    window = ids[:n]
    for k in range(1, width):  # renumbered at each step, so that the keys stay below n * n
        _, window = np.unique(window * len(seen) + ids[k : k + n], return_inverse=True)
    again = np.flatnonzero(np.bincount(window)[window] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[again + k] = True
    return int(covered.sum())


def base_rules(text: bytes, words: list[bytes]) -> tuple:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)] if b"\n" in text else []
    repeat = repeated_words(words)
    n = len(words)
    chars = len(text.translate(None, SPACE).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


@dataclass(frozen=True)
class Model:
    """Log ratio per bucket and the least score of a kept document; both have a fixed size."""

    ratio: np.ndarray
    threshold: float

    def score(self, words: list[bytes]) -> float:
        return float(self.ratio[ngram_buckets(words, len(self.ratio))].mean()) if words else 0.0


def labelled(labels: DataFrame, rows: int = LABELLED_ROWS) -> dict[int, bool]:
    """doc_id to "good" for at most ``rows`` labelled documents, chosen by a hash of the id."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    bad = F.col("quality") == 0
    sample = (
        labels.where(F.col("doc_id").isNotNull() & (good | bad)).select("doc_id", good.alias("good"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id", "good").limit(rows)
    )
    return {r["doc_id"]: r["good"] for r in sample.collect()}


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = LABELLED_ROWS) -> Model:
    """Count both multinomials over all documents, then place the threshold."""
    known = labelled(labels, rows)
    good = np.array(sorted(k for k, v in known.items() if v), np.int64)

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for trusted, text in zip(np.isin(ids, good), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(ngram_buckets(text.split(), buckets), minlength=buckets)
                total[1] += found
                if trusted:
                    total[0] += found
        used = np.flatnonzero(total[1])
        yield {"bucket": used, "target": total[0][used], "raw": total[1][used]}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    sums = arrow_stage(texts, count, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.ones(buckets), np.ones(buckets)
    for r in sums.collect():
        target[r["bucket"]] += r["target"]
        raw[r["bucket"]] += r["raw"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if not len(good) or len(good) == len(known):
        return Model(ratio, float("-inf"))
    free = Model(ratio, float("-inf"))
    ids = docs.sparkSession.createDataFrame([(k,) for k in known], "doc_id long")
    scored = score(texts.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("text", F.col("text").cast("string")), free)
    pairs = [(r["score"], known[r["doc_id"]]) for r in scored.where("not base_failed").select("doc_id", "score").collect()]
    return Model(ratio, place(pairs))


def place(pairs: list[tuple[float, bool]], good_loss: float = GOOD_LOSS) -> float:
    """The cut with the most bad scores below it of those that lose at most ``good_loss`` of the good; midway in its gap."""
    good = np.sort([s for s, g in pairs if g])
    bad = np.sort([s for s, g in pairs if not g])
    if not len(good) or not len(bad):
        return float("-inf")
    least = good[int(len(good) * good_loss)]
    below = bad[bad < least]
    return float((below[-1] + least) / 2) if len(below) else float("-inf")


def judge(text: bytes, model: Model) -> tuple:
    words = text.split()
    base = base_rules(text, words)
    value = model.score(words)
    return *base, value, not base[-1] and value >= model.threshold


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept, one row per document, in one pass without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [judge(x, model) for x in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [[]] * 8
            yield {"doc_id": batch.column(0)} | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"), map(list, columns), strict=True))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    return arrow_stage(texts, rows, f"doc_id long, {BASE}, score double, kept boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that pass, with all their columns; the filter runs where the rows are read."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([judge(x or b"", model)[-1] for x in texts], pa.bool_()))

    return docs.mapInArrow(handing_back(rows), docs.schema)


@query("op4_quality_ratio")
def op4_quality_ratio(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return score(docs, fit(docs, labels))
