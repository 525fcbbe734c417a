"""Operator 13, spelling variant grouping: words one edit apart, found through the one-edit neighbourhoods of reduced words.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Letters are hashed to ``SYMBOLS`` symbols, so
that each word has a reduced word; near words have reduced words that are equal or one edit apart. The neighbourhood of every distinct reduced
word is made in full and joined with the reduced vocabulary by a 64-bit key. Pairs of reduced words are then resolved to their words
and verified on the original strings, so a false pair costs time and nothing else. An edit seen from one side is the opposite edit
seen from the other: an insertion is the other's deletion, a replacement by a greater symbol the other's by a lesser one. Each pair is
therefore made from one side only, which leaves a third of the rows and none twice.

A word's form is its near word of largest count, if that is at least ``RATIO`` times its own; its root is where the forms lead. Counts
grow along forms, so a chain has at most log2 of the largest count steps, and roots are found by pointer doubling.

All steps are shuffles by word or by key: occurrences are summed before they are shuffled, a key holds the words of one reduced word
(35 at most of the 794,948 words of 0.86 GB of text), and adaptive execution splits what is skewed. Tables that are read more
than once are written to the shared folder.

Edge cases: null and empty texts have no words; a null doc_id counts like any other (the registered query deletes nothing there); repeated
rows count as often as they stand there; equal counts go by code-point order; an empty table gives an empty table; a word of any length takes
part, as neighbourhoods are keys and not strings; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.spans import unnest
from veilspan.llm.common import arrow_stage, cut_lineage, query, read

LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_LENGTH, LEAST_COUNT = 5, 3
SYMBOLS = 8
#: How many times a word's own count its form must have.
RATIO = 2
#: Letters worked on at once.
STEP = 1 << 20
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def occurrences(docs: DataFrame, letters: str = LETTERS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id and word for every maximal run of letters that is long enough, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{letters}]{{{least_length},}}"), F.lit(0))
    runs = unnest(docs, found, "run", F.col("doc_id").cast("long").alias("doc_id"))
    plain = F.length("run") == F.octet_length("run")
    return runs.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).alias("word"))


def misspelt(words: DataFrame) -> DataFrame:
    """One word in 97, chosen by document and word, loses a letter."""
    h, size = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word"))), F.length("word")
    at = (h % size).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size))
    return words.select("doc_id", F.when(h % 97 == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, its number of occurrences, for words that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def reduced(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their reduced words as rows of symbols; at most ``STEP`` letters at once."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        rows = max(1, STEP // max(1, size))
        for k in range(0, len(of), rows):
            at = of[k : k + rows]
            points = np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), size)
            yield at, ((points * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(symbols)).astype(np.uint64)


def powers(size: int) -> np.ndarray:
    out = np.full(size, BASE, np.uint64)
    if size:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def finished(sums: np.ndarray, size: int) -> np.ndarray:
    """The key of a reduced word of ``size`` symbols, as signed long."""
    mixed = (sums ^ (sums >> np.uint64(31)) ^ np.uint64(size * 0xC2B2AE3D27D4EB4F % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def keys(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The key of each word's reduced word: the sum of (symbol + 1) * BASE ** place modulo 2 ** 64, mixed with the length."""
    out = np.empty(len(words), np.int64)
    for at, rows in reduced(words, symbols):
        out[at] = finished(((rows + np.uint64(1)) * powers(rows.shape[1])).sum(axis=1, dtype=np.uint64), rows.shape[1])
    return out


def neighbourhoods(words: list[str], symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``words`` and keys of their reduced words' neighbours: all different deletions and all replacements by a lesser symbol."""
    for at, rows in reduced(words, symbols):
        size = rows.shape[1]
        weight = powers(size)
        terms = (rows + np.uint64(1)) * weight
        until = np.cumsum(terms, axis=1, dtype=np.uint64)
        total = until[:, -1:] if size else np.zeros((len(at), 1), np.uint64)
        apart = np.ones(rows.shape, bool)  # one of equal neighbours gives the same word as the other
        apart[:, 1:] = rows[:, 1:] != rows[:, :-1]
        r, c = np.nonzero(apart)
        yield at[r], finished((until - terms + (total - until) * np.uint64(BACK))[r, c], size - 1)
        for lesser in range(symbols - 1):
            r, c = np.nonzero(rows > lesser)
            yield at[r], finished((total - (rows - np.uint64(lesser)) * weight)[r, c], size)


def keyed(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """The vocabulary with the key of each word's reduced word."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield {"word": batch.column(0), "n": batch.column(1), "key": keys(batch.column(0).to_pylist(), symbols)}

    return arrow_stage(words.select("word", F.col("n").cast("long").alias("n")), rows, "word string, n long, key long")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, a_n, b, b_n: every pair of near words of a vocabulary (word, n), once, in one of its two orders."""
    own = cut_lineage(keyed(words, symbols), "reduced-words")
    classes = own.groupBy("key").agg(F.min("word").alias("word"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            mine = batch.column(0).to_numpy()
            for at, other in neighbourhoods(batch.column(1).to_pylist(), symbols):
                yield {"key": mine[at], "other": other}

    made = arrow_stage(classes.select("key", "word"), rows, "key long, other long")
    same = classes.select("key", F.col("key").alias("other"))
    pairs = made.join(classes.select(F.col("key").alias("other")), "other", "left_semi").select("key", "other").unionByName(same)
    left = own.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = own.select(F.col("key").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    candidates = pairs.join(left, "key").join(right, "other").where((F.col("key") != F.col("other")) | (F.col("a") < F.col("b")))
    return candidates.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def forms(words: DataFrame, links: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest count that has at least ``ratio`` times the word's own count."""
    both = links.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    held = -F.col("best.less") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, F.col("best.near")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n")
    )


def rooted(formed: DataFrame) -> DataFrame:
    """Adds root: where the forms lead from each word, itself if it has none. Counts must grow along forms."""
    steps = cut_lineage(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        steps = cut_lineage(joined, "roots")
        if steps.where("moved").isEmpty():
            return formed.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(words: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary of distinct words with their counts."""
    words = cut_lineage(words.select("word", "n"), "vocabulary")
    return rooted(cut_lineage(forms(words, near_words(words, symbols), ratio), "formed")).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return grouped(vocabulary(misspelt(occurrences(read(spark, folder, "documents")))))
