"""Operator 12, periodic run detection: maximal repetitions of words from Lyndon roots and suffix-tree extensions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least ``LEAST_LENGTH`` words and
``LEAST_EXPONENT`` periods that no neighbouring word extends keeping the period. Every run of two periods or more has a Lyndon word of
length q among its words that is the longest one to start where it does, in the order of the words' numbers or in the opposite one. So the
candidates are, for each place and both orders, the stretch up to the next smaller suffix. Each is extended to both sides as far as the
period holds by two longest-common-extension queries: to the right on Ukkonen's tree of the words, to the left on the tree of their
reversal. A query is the string depth of a lowest common ancestor, answered in constant time from the Euler tour: the least depth between
two leaves, of which a sparse table holds all powers of two.

Trees are built over the parts of a text that can hold a run at all: in a run of period q each word but the last q meets its equal
within the next q words, so a stretch of at least (``LEAST_EXPONENT`` - 1) * q such words must be there for a q. Those stretches are found for
all scales of q at once for a portion of texts. A run lies in one of the parts as a whole, so nothing is lost by it.

Each text is worked on by itself where it is read, without a shuffle; a lost executor costs the portions of its tasks. Memory is a few
hundred bytes for each word of the longest such part, besides portions of ``PORTION`` bytes.

Edge cases: null, empty and blank texts have no words, no runs and an empty collapsed text; a null doc_id is kept as null (the registered
query plants nothing there); repeated rows are worked on one by one; equal exponents go by start, then period; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import arrow_stage, query, raw_text, read

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Bytes of text whose words are numbered together; a longer text is a portion by itself.
PORTION = 1 << 21


class SuffixTree:
    """Ukkonen's tree of a row of positive numbers, closed by a 0, with constant-time longest common extensions.

    ``ranks`` are the suffixes' places in the order of the numbers, ``back_ranks`` those in the opposite order; in both a suffix comes
    before the longer ones that begin with it.
    """

    def __init__(self, symbols: list[int], opposite: bool = False):
        self.text = [*symbols, 0]
        self._grow()
        self._tour()
        self.back_ranks = self._ranks(self._leaves(True)) if opposite else None

    def _grow(self) -> None:
        text, n = self.text, len(self.text)
        width = max(text) + 1
        start, end, link, parent, child = [0], [0], [0], [0], {}
        node = edge = length = left = 0
        for i, symbol in enumerate(text):
            unlinked = 0
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    parent.append(node)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    at = start[below]
                    size = end[below] - at
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if text[at + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = child[key] = len(start)
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    parent += (node, middle)
                    start[below] = at + length
                    parent[below] = middle
                    child[middle * width + text[at + length]] = below
                    child[middle * width + symbol] = middle + 1
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.start, self.end, self.parent = (np.array(x, np.int64) for x in (start, end, parent))

    def _leaves(self, opposite: bool) -> list[int]:
        """Nodes in depth-first order, children by their first number, 0 before all others in both orders."""
        first = np.array(self.text, np.int64)[np.minimum(self.start, len(self.text) - 1)]
        if opposite:
            first = np.where(first == 0, 0, len(self.text) + first.max() - first)
        order = np.lexsort((first[1:], self.parent[1:])) + 1
        heads = np.searchsorted(self.parent[order], np.arange(len(self.start) + 1)).tolist()
        order = order[::-1].tolist()  # children are pushed last first
        n, stack, out = len(order), [0], []
        while stack:
            v = stack.pop()
            out.append(v)
            if heads[v] != heads[v + 1]:
                stack += order[n - heads[v + 1] : n - heads[v]]
        return out

    def _ranks(self, visited: list[int]) -> np.ndarray:
        at = np.array(visited, np.int64)
        begins = len(self.text) - self.depth[at[self.end[at] == len(self.text)]]
        ranks = np.empty(len(self.text), np.int64)
        ranks[begins] = np.arange(len(begins))
        return ranks

    def _tour(self) -> None:
        """Ranks, and the Euler tour cut down to the least depth between neighbouring leaves."""
        visited = self._leaves(False)
        depth, size, parent = [0] * len(self.start), (self.end - self.start).tolist(), self.parent.tolist()
        lows, low, before, leaf = [], 0, 0, (self.end == len(self.text)).tolist()
        for v in visited[1:]:
            above = parent[v]
            depth[v] = depth[above] + size[v]
            if above != before:  # the tour came back up to this parent since the last leaf
                low = depth[above]
            if leaf[v]:
                lows.append(low)
            before = v
        self.depth = np.array(depth, np.int64)
        self.ranks = self._ranks(visited)
        least = np.array(lows, np.int32)
        self.table = [least]
        step = 1
        while 2 * step <= len(least):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the different suffixes at ``i`` and at ``j`` share; the end may be asked for."""
        a, b = self.ranks[i], self.ranks[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one, where the next smaller one begins."""
    values = ranks.tolist()
    out, stack = [0] * (len(values) - 1), [len(values) - 1]
    for i in range(len(values) - 2, -1, -1):
        own = values[i]
        while values[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def maximal_runs(symbols: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """start, length and period of every run of a row of numbers, as rows in the order of start, then period; two periods at least."""
    _, named = np.unique(symbols, return_inverse=True)
    forward = SuffixTree((named + 1).tolist(), opposite=True)
    n, found = len(symbols), []
    at = np.arange(n)
    backward = SuffixTree((named[::-1] + 1).tolist())
    for ranks in (forward.ranks, forward.back_ranks):
        after = next_smaller(ranks)
        some = (after - at) * least_exponent <= n
        i, j = at[some], after[some]
        left, right = backward.extension(n - i, n - j), forward.extension(i, j)
        period = j - i
        length = period + left + right
        held = length >= np.maximum(least_exponent * period, least_length)
        found.append(np.stack([(i - left)[held], length[held], period[held]], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def gaps(ids: np.ndarray) -> np.ndarray:
    """How far away the next equal number is; beyond the end where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids) + 1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def possible(gap: np.ndarray, ends: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Parts of the row that can hold a run; ``ends`` has for each place the end of its text."""
    n, change, scale = len(gap), np.zeros(len(gap) + 1, np.int64), 1
    longest = int(np.diff(np.unique(ends), prepend=0).max()) if n else 0
    while least_exponent * (scale // 2 + 1) <= longest:
        near = np.concatenate([[0], (gap <= scale).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(near))
        begin, end = edges[::2], edges[1::2]
        held = end - begin >= max((least_exponent - 1) * (scale // 2 + 1), least_length - scale)
        begin, end = begin[held], end[held]
        np.add.at(change, begin, 1)
        np.add.at(change, np.minimum(end + scale, ends[begin]) if len(begin) else end, -1)
        scale *= 2
    inside = np.cumsum(change[:-1]) > 0
    label = np.concatenate([[0], np.where(inside, ends, 0), [0]])
    cuts = np.flatnonzero(np.diff(label))
    return [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if label[a + 1] and b - a >= least_length]


def split_words(doc_id: int | None, text: bytes) -> list[bytes]:
    return text.split()


def runs_of(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[np.ndarray]:
    """The runs of each text of a portion."""
    sizes = np.array([len(x) for x in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[np.ndarray]] = [[] for _ in texts]
    words = [w for x in texts for w in x]
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    of = np.repeat(np.arange(len(texts)), sizes)
    for a, b in possible(gaps(of * (len(names) + 1) + ids), bounds[of + 1], least_length, least_exponent):
        rows = maximal_runs(ids[a:b], least_length, least_exponent)
        if len(rows):
            k = int(of[a])
            out[k].append(rows + [a - int(bounds[k]), 0, 0])
    none = np.zeros((0, 3), np.int64)
    return [np.concatenate(x) if x else none for x in out]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The text without the words that a run repeats: in each run all but its first period goes."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def portions(ids: list, texts: Iterator[bytes], limit: int = PORTION) -> Iterator[list[tuple]]:
    part, size = [], 0
    for pair in zip(ids, texts, strict=True):
        if part and size + len(pair[1]) > limit:
            yield part
            part, size = [], 0
        part.append(pair)
        size += len(pair[1])
    if part:
        yield part


def find(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, words: Callable[[int | None, bytes], list[bytes]] = split_words
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and the collapsed text of each row of ``docs``."""
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in portions(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))):
                texts = [words(i, x) for i, x in part]
                runs = runs_of(texts, least_length, least_exponent)
                flat = np.concatenate(runs)
                ends = np.cumsum([0, *(len(x) for x in runs)])
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
                yield {
                    "doc_id": [i for i, _ in part], "n_words": [len(x) for x in texts], "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
                    "text": [collapsed(x, r) for x, r in zip(texts, runs, strict=True)],
                }

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    found = arrow_stage(texts, rows, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, text binary")
    return found.withColumn("text", F.col("text").cast("string"))


def planted(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; every tenth document, by its id's crc32, gets a periodic tail."""
    words = text.split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + period]
    return words[:a] + (root * -(-(n - a) // len(root)))[: n - a]


def strongest(runs: Column) -> Column:
    """The run of most periods, compared as whole numbers; the earliest of equals, as ``runs`` are in the order of start and period."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and hashes of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
    milli = F.expr("(1000 * best.length) div best.period")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return digest(find(read(spark, folder, "documents"), words=planted))
