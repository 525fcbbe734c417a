"""Operator 5, byte-level BPE: a lazily determinised finite-state transducer, and a streaming decoder.

The ranks are compiled into a transducer that reads a piece byte by byte. A state stands for the places where a token of the true encoding may
still begin: for each its node in the token tree, and the tokens that lead to it and are not emitted yet. A byte moves all nodes;
where a node completes a token that may follow its predecessor, the place behind it gets its encoding, of which there is exactly one. What
all places of a state have in common is emitted, so a token leaves after a lookahead of at most the longest token. States and
moves are made when first met and remembered. Two tokens may follow each other if merging their bytes by rank gives them back; that is so if, while the merges
beside the boundary are undone from the last to the first, no two parts that meet there had a merge due earlier.

The decoder moves a UTF-8 state machine by whole tokens: what a token does to a state is worked out once and remembered. State and open
bytes are carried from portion to portion, and only a character that is not complete yet is held back; digests are of the bytes it let out.

Edge cases: null or empty text has no ids; repeated rows are encoded one by one; ids may be null; an empty table gives an empty table; bytes
that are no UTF-8 are read as replacement characters. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import arrow_stage, plain, query, raw_text, read
from veilspan.llm.encoding import BYTE_PATTERN, NOT_PLAIN, PieceMemory, vocabulary
from veilspan.llm.packing import portions

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of states, moves and pairs of tokens that a worker keeps, at most (as estimated); beyond it the transducer is compiled anew as texts need it.
MOST_BYTES = 160 << 20
#: About what Python takes for a state with its number, a move, an emission and a pair, beside the bytes of a state and 8 for each token of an emission.
STATE_COST, MOVE_COST, EMIT_COST, PAIR_COST = 240, 170, 190, 120
CHUNK_IDS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """BPE by its definition: the adjacent pair of least rank (under ``below``) is merged, the leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        least = min((r for r in pairs if r is not None), default=None)
        if least is None or (below is not None and least >= below):
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.tree: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.tree[node].setdefault(byte, len(self.tree))
                if node == len(self.tree):
                    self.tree.append({})
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.halves = self._halves()
        self.joins = {pair: rank for rank, pair in self.halves.items()}
        self._begin()

    def _begin(self) -> None:
        #: State 0 is the start. A state is kept as packed numbers, see ``_pack``; a move as (next state) * 2 + (emits something).
        start = self._pack(-1, [(0, ())])
        self.number, self.states, self.moves, self.emits = {start: 0}, [start], {}, {}
        self.follows: dict[int, bool] = {}
        self.held = 0

    @staticmethod
    def _pack(last: int, places: list[tuple[int, tuple[int, ...]]]) -> bytes:
        """The last emitted token (-1: none, or no place looks back at it), then node, number of tokens and tokens of each live place."""
        flat = array("i", [last if any(not path for _, path in places) else -1])
        for node, path in places:
            flat.append(node)
            flat.append(len(path))
            flat.extend(path)
        return flat.tobytes()

    @staticmethod
    def _unpack(state: bytes) -> tuple[int, list[tuple[int, tuple[int, ...]]]]:
        flat = array("i")
        flat.frombytes(state)
        places, at = [], 1
        while at < len(flat):
            end = at + 2 + flat[at + 1]
            places.append((flat[at], tuple(flat[at + 2 : end])))
            at = end
        return flat[0], places

    def _halves(self) -> dict[int, tuple[int, int]]:
        """The two tokens that a token's last merge joined; a token that merging never makes is left out, single bytes have none."""
        out = {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = merged(token, self.ranks, rank)
                if len(parts) == 2:
                    out[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return out

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            made = right in self.halves or len(self.bytes_of[right]) == 1
            known = self.follows[key] = made and (left < 0 or self._stays_apart(left, right))
            self.held += PAIR_COST
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        due = len(self.ranks) + 1  # what is side by side now stays so while merges of a lower rank than this are done
        while True:
            joint = self.joins.get((left, right))
            if joint is not None and joint < due:
                return False
            open_left, open_right = self.halves.get(left), self.halves.get(right)
            if open_left is None and open_right is None:
                return True
            if open_right is None or (open_left is not None and left > right):
                left, due = open_left[1], left  # of equal ranks the left one is merged first
            else:
                right, due = open_right[0], right + 1

    def _move(self, state: int, byte: int) -> int:
        last, places = self._unpack(self.states[state])
        live, here = [], None
        for node, path in places:
            node = self.tree[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and here is None and self.may_follow(path[-1] if path else last, token):
                here = (*path, token)
            if self.tree[node]:
                live.append((node, path))
        live.append((0, here))
        first = live[0][1]
        n = min(len(p) for _, p in live)
        for _, path in live[1:]:
            while path[:n] != first[:n]:
                n -= 1
        new = self._pack(first[n - 1] if n else last, [(node, p[n:]) for node, p in live] if n else live)
        number = self.number.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
            self.held += STATE_COST + len(new)
        key = state << 8 | byte
        if n:
            self.emits[key] = first[:n]
            self.held += EMIT_COST + 8 * n
        move = self.moves[key] = number << 1 | (n > 0)
        self.held += MOVE_COST
        return move

    def encode(self, piece: bytes) -> list[int]:
        if self.held > MOST_BYTES:
            self._begin()
        state, ids, moves, emits = 0, [], self.moves, self.emits
        for byte in piece:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = self._move(state, byte)
            if move & 1:
                ids += emits[key]
            state = move >> 1
        return [*ids, *self._unpack(self.states[state])[1][-1][1]]


class BpeEncoder(PieceMemory):
    """Ids of whole texts: each match of the pattern on its own, through one transducer."""

    def __init__(self, path: str):
        self.transducer = Transducer(load_ranks(path))
        self.width = np.uint32
        self.any_text, self.plain_text = regex.compile(BYTE_PATTERN), self.plain_pattern(BYTE_PATTERN)
        self._forget()

    def _learn(self, pieces: list[str]) -> None:
        found = [self.transducer.encode(p.encode()) for p in pieces]
        self._keep(pieces, np.array([i for x in found for i in x], self.width), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = [], []
        for text in texts:
            text = plain(text)
            got = (self.any_text if NOT_PLAIN.search(text) else self.plain_text).findall(text)
            counts.append(len(got))
            pieces += got
        ids, sizes = self._joined(pieces)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])])


#: UTF-8 as a state machine: for each state the bytes that may come and the state behind them; state 0 is between characters.
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0xA0, 0xBF, 1)], 3: [(0x80, 0xBF, 1)], 4: [(0x80, 0x9F, 1)], 5: [(0x90, 0xBF, 3)], 6: [(0x80, 0xBF, 3)], 7: [(0x80, 0x8F, 3)],
}


def utf8_step(state: int, byte: int) -> int:
    """The next state, or -1 if the byte can't come here."""
    return next((to for low, high, to in UTF8[state] if low <= byte <= high), -1)


class TokenMoves:
    """What a token does to the UTF-8 machine: the state behind it, and the bytes of it that are open, or -1 if all of them go on with an open character.

    A byte that can't come ends the open character, as it is, and is read anew.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.known: dict[int, tuple[int, int]] = {}
        #: Whether a token is made of whole characters.
        self.whole = np.array([self.move(0, i) == (0, 0) and self._valid(t) for i, t in enumerate(tokens)], bool)
        self.known = {}

    @staticmethod
    def _valid(token: bytes) -> bool:
        state = 0
        for byte in token:
            state = utf8_step(state, byte)
            if state < 0:
                return False
        return state == 0

    def move(self, state: int, token: int) -> tuple[int, int]:
        key = token << 3 | state
        known = self.known.get(key)
        if known is None:
            open_bytes = -1 if state else 0
            for byte in self.tokens[token]:
                to = utf8_step(state, byte)
                if to < 0 and state:
                    open_bytes, to = 0, utf8_step(0, byte)
                state = max(to, 0)
                open_bytes = 0 if state == 0 else open_bytes + (open_bytes >= 0)
            known = self.known[key] = (state, open_bytes)
        return known


class StreamDecoder:
    """Whole characters, as bytes, from ids that come in portions; ``end`` gives what is left open. The state is carried between portions."""

    def __init__(self, moves: TokenMoves):
        self.moves, self.state, self.held = moves, 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        tokens, move = self.moves.tokens, self.moves.move
        state, open_bytes, behind = self.state, len(self.held), 0
        for at in np.flatnonzero(~self.moves.whole[ids]).tolist():
            if at > behind:  # a whole character came: nothing is open behind it
                state = open_bytes = 0
            token = int(ids[at])
            state, fresh = move(state, token)
            open_bytes = open_bytes + len(tokens[token]) if fresh < 0 else fresh
            behind = at + 1
        if behind < len(ids):
            state = open_bytes = 0
        data = self.held + b"".join(map(tokens.__getitem__, ids.tolist()))
        cut = len(data) - open_bytes
        self.state, self.held = state, data[cut:]
        return data[:cut]

    def end(self) -> bytes:
        rest, self.state, self.held = self.held, 0, b""
        return rest


@lru_cache(maxsize=2)
def bpe_encoder(path: str) -> BpeEncoder:
    return BpeEncoder(path)


@lru_cache(maxsize=2)
def token_moves(path: str) -> TokenMoves:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return TokenMoves(out)


def encoded_rows(ranks: str, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    ids_of = bpe_encoder(ranks)
    for batch in batches:
        for keys, texts in portions(batch.column(0), batch.column(1)):
            ids, sizes = ids_of.encode(texts)
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
            yield {"doc_id": keys, "n_tokens": sizes.tolist(), "ids": [data[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]}


def decoded_rows(ranks: str, portions_of_ids: Iterable[dict[str, list]], text: bool) -> Iterator[dict[str, list]]:
    moves = token_moves(ranks)
    for columns in portions_of_ids:
        out: dict[str, list] = {"ids_sha256": [], "decoded_sha256": []} | ({"text": []} if text else {})
        for data in columns["ids"]:
            stream, digest, parts = StreamDecoder(moves), hashlib.sha256(), []
            numbers = np.frombuffer(data, "<u4")
            for k in range(0, len(numbers) + 1, CHUNK_IDS):
                let_out = stream.feed(numbers[k : k + CHUNK_IDS]) + (stream.end() if k + CHUNK_IDS > len(numbers) else b"")
                digest.update(let_out)
                if text:
                    parts.append(plain(let_out))
            out["ids_sha256"].append(hashlib.sha256(data).hexdigest())
            out["decoded_sha256"].append(digest.hexdigest())
            if text:
                out["text"].append("".join(parts))
        yield {"doc_id": columns["doc_id"], "n_tokens": columns["n_tokens"]} | out


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits each)."""
    return arrow_stage(_texts(docs), lambda batches: encoded_rows(ranks, batches), "doc_id long, n_tokens long, ids binary")


def decode(ids: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the text; ids are read in portions of bounded size."""

    def rows(batches: Iterator[pa.RecordBatch]):
        return decoded_rows(ranks, (dict(zip(("doc_id", "n_tokens", "ids"), (c.to_pylist() for c in b.columns), strict=True)) for b in batches), True)

    return arrow_stage(ids.select("doc_id", "n_tokens", "ids"), rows, f"{DIGESTS}, text string")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """The digests of the ids and of the bytes decoded from them, by one worker for both ways."""
    return arrow_stage(_texts(docs), lambda batches: decoded_rows(ranks, encoded_rows(ranks, batches), False), DIGESTS)


@query("op5_bpe_transducer")
def op5_bpe_transducer(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(read(spark, folder, "documents"), vocabulary(spark, RANKS))
