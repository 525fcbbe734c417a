"""Operator 6, language-model scoring: a weighted backoff automaton over smoothed word n-grams.

Tokens are the words, A-Z lower-cased, then one end for each document. Counts of all n-grams up to ``ORDER`` are smoothed by a Dirichlet prior,

    P(w | h) = (c(h w) + MU * P(w | h')) / (c(h) + MU),      P(w) = (c(w) + 1) / (N + V + 1),

where h' is h without its first word. As an automaton: the seen histories are the states; a seen n-gram h w is an arc that weighs the log of
the whole formula and leads to the longest suffix of h w that is a state; the failure arc of a state leads to h' and weighs
log(MU / (c(h) + MU)). The empty history is a state with an arc for every word. A document is one walk from left to right: at each
token the walker takes failure arcs until its state has an arc for the token, takes it, and adds up what all of them weigh.
Many walkers go side by side. What a state remembers is at most ORDER - 1 words, so a long text is walked in segments: a
walker that starts inside a text reads the ORDER - 1 tokens before its segment first, and is then in the state it would have come in.

The model grows with the corpus and is never held in one place. Documents are gathered to chunks of about ``CHUNK_TOKENS`` tokens,
numbered once and written. Each chunk lists its distinct n-grams as 64-bit keys, with their counts in its training documents, and
deals the lists out by ranges of the key; a range adds up what all chunks say and answers each chunk with the totals, in the
order asked. A key has at most one place in a chunk's list, so a word that is everywhere makes no hot task. A chunk then holds just
the part of the automaton that its documents walk through.

Edge cases: null or empty text is the end alone; null doc_ids count as id 0 for the split into training and held-out documents; repeated
rows are counted and scored each; without training documents N = V = 0 and all probabilities are those of the smoothing; an empty table
gives an empty table. Other columns are not read. Two n-grams share a key with a chance of about one in 2^64 a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import arrow_stage, cut_lineage, query, raw_text, read

ORDER, MU = 3, 50.0
CHUNK_TOKENS = 1_500_000
#: Keys that one range holds, about.
RANGE_KEYS = 1_000_000
#: Tokens of a text that one walker reads; a longer text has several walkers.
SEGMENT = 1024
FOLDS, HELD_OUT = 7, 2
#: Token numbers that no word has: before a document's first word, and behind its last.
START, END = np.uint64(xxhash.xxh64_intdigest(b"\n", 6)), np.uint64(xxhash.xxh64_intdigest(b" ", 6))
MIX = np.uint64(0x9E3779B97F4A7C15)


def squeezed(numbers: np.ndarray) -> bytes:
    """Small or slowly growing numbers: byte planes, which zstandard shortens well."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data, "<u8"), dtype=np.uint64)


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """Places of the most frequent first, equal ones in their order."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id or 0).encode()) % FOLDS == HELD_OUT


def token_numbers(text: bytes) -> np.ndarray:
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = list(map(xxhash.xxh64_intdigest, words, (6 for _ in words)))
    out[-1] = END
    return out


def mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of history + word: a bijection for each history, well spread over all ranges."""
    with np.errstate(over="ignore"):
        x = (history ^ (history >> np.uint64(31))) * MIX + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ word) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))


def ngram_keys(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """The key of the n-gram that ends at each token, for n = 1 .. order; ``first`` marks where documents begin.

    Longer n-grams begin with START as often as the document has no earlier words.
    """
    keys = [tokens]
    at = np.arange(len(tokens)) - np.maximum.accumulate(np.where(first, np.arange(len(tokens)), 0))
    for n in range(2, order + 1):
        before = np.concatenate([[START], keys[-1][:-1]])
        # the history is the (n - 1)-gram that ends one token earlier; at a document's start it is all START
        opening = START
        for _ in range(n - 2):
            opening = mixed(np.array([opening]), np.array([START]))[0]
        keys.append(mixed(np.where(at == 0, opening, before), tokens))
    return keys


def chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """chunk, doc_ids, sizes, tokens and held-out marks of runs of whole documents, as arrays of bytes; one row a chunk."""

    def rows(batches: Iterator[pa.RecordBatch]):
        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            tokens = np.concatenate([x[1] for x in held])
            distinct, index, often = np.unique(tokens, return_inverse=True, return_counts=True)
            # words are numbered by how often they stand here, so that most numbers are small
            rank = np.empty(len(distinct), np.int64)
            rank[by_frequency(often)] = np.arange(len(distinct))
            return {
                "chunk": [part << 32 | serial], "doc_ids": [[x[0] for x in held]], "sizes": [[len(x[1]) for x in held]],
                "words": [steps(distinct)], "often": [squeezed(often.astype("<u4"))], "index": [squeezed(rank[index].astype("<u4"))], "n_tokens": [len(tokens)],
            }

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((doc, token_numbers(text)))
                size += len(held[-1][1])
                if size >= chunk_tokens:
                    yield close()
                    serial, held, size = serial + 1, [], 0
        if held:
            yield close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    return arrow_stage(texts, rows, "chunk long, doc_ids array<long>, sizes array<long>, words binary, often binary, index binary, n_tokens long")


class Chunk:
    """One chunk's tokens, unpacked: the walk's places."""

    def __init__(self, doc_ids: list, sizes: list[int], words: bytes, often: bytes, index: bytes, order: int):
        self.doc_ids, self.sizes = doc_ids, np.array(sizes, np.int64)
        self.tokens = from_steps(words)[by_frequency(unsqueezed(often, "<u4"))][unsqueezed(index, "<u4")]
        self.starts = np.cumsum(self.sizes) - self.sizes
        first = np.zeros(len(self.tokens), bool)
        first[self.starts] = True
        self.out = np.array([held_out(x) for x in doc_ids], bool)
        self.training = np.repeat(~self.out, self.sizes)
        self.order, self.first = order, first
        self.keys = ngram_keys(self.tokens, first, order)

    def lists(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of length n in ascending order, their training counts, and the place of each token's key in them."""
        distinct, index = np.unique(self.keys[n - 1], return_inverse=True)
        return distinct, np.bincount(index[self.training], minlength=len(distinct)), index


def asked(packed: DataFrame, order: int, ranges: int) -> DataFrame:
    """chunk, n, range, keys, counts: what each chunk counted and asks for, cut by ranges of the key."""
    width = (1 << 64) // ranges + 1
    edges = np.array([k * width for k in range(1, ranges)], np.uint64)

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for chunk, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = Chunk(*rest, order)
                for n in range(1, order + 1):
                    keys, counts, _ = c.lists(n)
                    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                    used = np.flatnonzero(np.diff(cuts))
                    yield {
                        "chunk": [chunk] * len(used), "n": [n] * len(used), "range": used.tolist(),
                        "keys": [steps(keys[cuts[k] : cuts[k + 1]]) for k in used], "counts": [squeezed(counts[cuts[k] : cuts[k + 1]].astype("<u4")) for k in used],
                    }

    return arrow_stage(packed.select("chunk", "doc_ids", "sizes", "words", "often", "index"), rows, "chunk long, n int, range int, keys binary, counts binary")


def answered(asks: DataFrame) -> DataFrame:
    """chunk, n, range, totals in the order asked; and, once a range, its total and number of seen keys (chunk null)."""

    def add_up(key, table):
        keys = [from_steps(x) for x in table.column("keys").to_pylist()]
        counts = [unsqueezed(x, "<u4") for x in table.column("counts").to_pylist()]
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(index, np.concatenate(counts), len(distinct)).astype(np.int64)  # doubles hold counts up to 2^53
        ends = np.cumsum([len(x) for x in keys])
        back = [squeezed(totals[index[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
        n, at = key[0].as_py(), key[1].as_py()
        chunk = table.column("chunk").to_pylist()
        return pa.Table.from_pydict(
            {
                "chunk": [*chunk, None], "n": [n] * (len(chunk) + 1), "range": [at] * (len(chunk) + 1), "totals": [*back, b""],
                "all": [*[0] * len(chunk), int(totals.sum())], "seen": [*[0] * len(chunk), int((totals > 0).sum())],
            },
            schema=pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("range", pa.int32()), ("totals", pa.binary()), ("all", pa.int64()), ("seen", pa.int64())]),
        )

    return asks.groupBy("n", "range").applyInArrow(add_up, "chunk long, n int, range int, totals binary, all long, seen long")


class Automaton:
    """States, arcs and failure arcs that a chunk's documents can meet.

    ``totals[n - 1]`` are the corpus counts of the chunk's distinct n-grams, in the order of ``Chunk.lists``. State 0 is the empty history; the
    n-gram at place i of its list is state ``base[n] + i``; behind them stand the histories of n START marks, ``opening[n]``.
    """

    def __init__(self, c: Chunk, totals: list[np.ndarray], n_all: int, seen: int, documents: int, mu: float):
        order, places, last = c.order, [], []
        for keys in c.keys:
            _, rep, index = np.unique(keys, return_index=True, return_inverse=True)
            places.append(index)
            last.append(rep)
        self.words, self.n_words, self.order = places[0], len(totals[0]), order
        sizes = [len(t) for t in totals[: order - 1]]
        self.base = [0, *(1 + sum(sizes[:n]) for n in range(order - 1))]
        self.opening = [0, *(1 + sum(sizes) + n for n in range(order - 1))]
        n_states = sum(sizes) + order
        self.failure, self.fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states)
        for n in range(1, order):
            at = slice(self.base[n], self.base[n] + sizes[n - 1])
            # the suffix that lacks the first word ends at the same token
            self.failure[at] = self.base[n - 1] + places[n - 2][last[n - 1]] if n > 1 else 0
            self.fail_weight[at] = np.log10(mu / (totals[n - 1] + mu))
            self.failure[self.opening[n]] = self.opening[n - 1]
            self.fail_weight[self.opening[n]] = np.log10(mu / (documents + mu))
        weight = (totals[0] + 1) / (n_all + seen + 1)
        self.root_weight = np.log10(weight)
        self.root_target = np.where(totals[0] > 0, 1 + np.arange(self.n_words), 0) if order > 1 else np.zeros(self.n_words, np.int64)
        codes, weights, targets = [], [], []
        for n in range(2, order + 1):
            rep, total, opens = last[n - 1], totals[n - 1], c.first[last[n - 1]]
            before = places[n - 2][rep - 1]
            # the count of a history is the count of the n-gram that ends one token earlier; all documents open with START alone
            weight = (total + mu * weight[places[n - 2][rep]]) / (np.where(opens, documents, totals[n - 2][before]) + mu)
            source = np.where(opens, self.opening[n - 1], self.base[n - 1] + before)
            target = self.base[n] + np.arange(len(rep)) if n < order else self.base[n - 1] + places[n - 2][rep]
            real = total > 0
            codes.append((source * self.n_words + places[0][rep])[real])
            weights.append(np.log10(weight[real]))
            targets.append(target[real])
        self.arcs = np.concatenate([np.zeros(0, np.int64), *codes])
        by_code = np.argsort(self.arcs)
        self.arcs = self.arcs[by_code]
        self.arc_weight, self.arc_target = np.concatenate([np.zeros(0), *weights])[by_code], np.concatenate([np.zeros(0, np.int64), *targets])[by_code]

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where walkers come on reading one word each, and what the arcs they took weigh."""
        states, weights, left = states.copy(), np.zeros(len(states)), np.arange(len(states))
        while len(left):
            at, word = states[left], words[left]
            root = at == 0
            if root.any():
                done, read = left[root], word[root]
                states[done] = self.root_target[read]
                weights[done] += self.root_weight[read]
                left, at, word = left[~root], at[~root], word[~root]
            if not len(left) or not len(self.arcs):
                fails = np.ones(len(left), bool)
            else:
                code = at * self.n_words + word
                place = np.minimum(np.searchsorted(self.arcs, code), len(self.arcs) - 1)
                fails = self.arcs[place] != code
                done, place = left[~fails], place[~fails]
                states[done] = self.arc_target[place]
                weights[done] += self.arc_weight[place]
            left, at = left[fails], at[fails]
            weights[left] += self.fail_weight[at]
            states[left] = self.failure[at]
        return states, weights


def walk(c: Chunk, automaton: Automaton, segment: int = SEGMENT) -> np.ndarray:
    """The log10 probability of each document of a chunk: walkers go through segments of the texts, all at once."""
    segments = -(-c.sizes // segment)
    doc = np.repeat(np.arange(len(c.sizes)), segments)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments)
    warm = np.where(nth > 0, c.order - 1, 0)
    begin = c.starts[doc] + nth * segment - warm
    left = warm + np.minimum(segment, c.sizes[doc] - nth * segment)
    longest = np.argsort(-left, kind="stable")
    begin, left, warm, inside = begin[longest], left[longest], warm[longest], nth[longest] > 0
    states = np.where(inside, 0, automaton.opening[-1])
    weights = np.zeros(len(doc))
    for k in range(int(left[0]) if len(left) else 0):
        going = int(np.searchsorted(-left, -k))  # walkers with more than k tokens stand in front
        states[:going], gained = automaton.step(states[:going], automaton.words[begin[:going] + k])
        weights[:going] += np.where(k >= warm[:going], gained, 0.0)
    ordered = np.empty(len(doc))
    ordered[longest] = weights
    return np.bincount(doc, ordered, len(c.sizes))


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, chunk_tokens: int = CHUNK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    packed = cut_lineage(chunks(docs, chunk_tokens), "chunks")
    tokens = packed.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(1, int(tokens // range_keys))
    replies = cut_lineage(answered(asked(packed, order, ranges).repartition(max(ranges, 1), "n", "range")), "totals")
    sums = replies.where("chunk is null and n = 1").agg(F.sum("all"), F.sum("seen")).first()
    n_all, seen = sums[0] or 0, sums[1] or 0
    # a training document opens the walk once and ends it once, so as many documents as END was counted
    documents = packed.select(F.explode("doc_ids").alias("id")).agg(F.count_if(F.pmod(F.crc32(F.coalesce("id", F.lit(0)).cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT)).first()[0]

    def rows(left, right):
        own = left.to_pylist()[0]
        answers = sorted((r["n"], r["range"], r["totals"]) for r in right.to_pylist())
        c = Chunk(own["doc_ids"], own["sizes"], own["words"], own["often"], own["index"], order)
        totals = [np.concatenate([unsqueezed(t, "<i8") for m, _, t in answers if m == n]) for n in range(1, order + 1)]
        automaton = Automaton(c, totals, n_all, seen, documents, mu)
        model = walk(c, automaton)
        base = np.add.reduceat(automaton.root_weight[automaton.words], c.starts)
        known = np.add.reduceat((totals[0] > 0)[automaton.words].astype(np.int64), c.starts)
        return pa.Table.from_pydict(
            {"doc_id": c.doc_ids, "held_out": c.out, "n_tokens": c.sizes, "n_known": known, "train_tokens": [n_all] * len(c.out), "base_score": base, "score": model},
            schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]),
        )

    back = replies.where("chunk is not null").select("chunk", "n", "range", "totals")
    return packed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op6_backoff_automaton")
def op6_backoff_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return score(read(spark, folder, "documents"))
