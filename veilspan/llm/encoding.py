"""Token ids by the tokenizers library for whole columns of texts.

A byte-level or word BPE cuts a text by a pattern and merges inside each piece alone, so a piece has the same ids wherever it stands.
Texts made of the characters in ``PLAIN`` are cut here by the tokenizer's own pattern; each distinct piece of a batch goes through the
library once and the ids are put together by index. Any other text goes through the library whole, as it is. Strings that look like
special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import repeat
from sys import getsizeof

import numpy as np

from veilspan.llm.common import plain

#: Where the vocabulary files are, unless the caller gives a whole path.
FOLDER_SETTING = "spark.veilspan.tokenizers"
#: Characters on which this cut and the library's agree by construction: ASCII and Latin-1 letters and signs, common punctuation.
NOT_PLAIN = re.compile(r"[^\x09-\x0d\x20-\x7e¡-ÿ–—‘-”•…€]")
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that remembered pieces take in a worker: strings, ids and table entries; beyond it the memory begins anew with the pieces at hand.
REMEMBERED_BYTES = 96 << 20
#: What a piece takes besides its string and ids: an entry of the table, a number, its place and size.
ENTRY_BYTES = 120
#: Pieces that go through the library in one call; longer calls take longer a piece.
WORDS_AT_ONCE = 200
#: The letters and numbers among the plain characters, for the standard library's faster matcher.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"


def vocabulary(spark, name: str) -> str:
    """The place of a public vocabulary file; ``spark.veilspan.tokenizers`` names another folder."""
    folder = spark.conf.get(FOLDER_SETTING, None)
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceMemory:
    """Ids of pieces that were met before, in one flat array; ``_learn`` encodes new ones."""

    width = np.uint32

    @staticmethod
    def plain_pattern(pattern: str) -> re.Pattern:
        """The same cut for plain characters alone."""
        for old, new in ((r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}{NUMBERS}]"), (r"[\p{L}]", f"[{LETTERS}]"), (r"[\p{N}]", f"[{NUMBERS}]"), (r"\p{L}", f"[{LETTERS}]"), (r"\p{N}", f"[{NUMBERS}]")):
            pattern = pattern.replace(old, new)
        return re.compile(pattern)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used, self.held = np.zeros(1 << 16, self.width), 0, 0
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first:last] = self.used + np.cumsum(sizes) - sizes
        self.size[first:last] = sizes
        self.known.update(zip(pieces, range(first, last), strict=True))
        self.used += len(ids)
        self.held += sum(map(getsizeof, pieces)) + ids.nbytes + ENTRY_BYTES * len(pieces)

    def _renew(self, pieces: list[str]) -> None:
        """Keep what is known of these pieces, the frequent ones among them, and forget the rest."""
        kept = [p for p in set(pieces) if p in self.known]
        at = np.fromiter(map(self.known.__getitem__, kept), np.int64, len(kept))
        ids, sizes = gather(self.flat, self.begin[at], self.size[at])
        self._forget()
        self._keep(kept, ids, sizes)

    def _learn(self, pieces: list[str]) -> None:
        raise NotImplementedError

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.zeros(0, self.width), np.zeros(0, np.int64)
        if self.held > REMEMBERED_BYTES:
            self._renew(pieces)
        at = np.array(list(map(self.known.get, pieces, repeat(-1))), np.int64)
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(list({pieces[i] for i in new}))
            at[new] = [self.known[pieces[i]] for i in new]
        return gather(self.flat, self.begin[at], self.size[at])


class Encoder(PieceMemory):
    """``encode(texts) -> (ids, lengths)`` for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path) as f:
            spec = json.load(f)
        self.pattern, self.lower = self._cut(spec)
        self.width = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    @staticmethod
    def _cut(spec: dict) -> tuple[re.Pattern | None, bool]:
        """The pattern whose matches are the pieces, and whether texts are lower-cased first; None if this module can't tell."""
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            return PieceMemory.plain_pattern(BYTE_PATTERN), False
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        parts = before.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["invert"] and not parts[1]["use_regex"]:
            return PieceMemory.plain_pattern(parts[0]["pattern"]["Regex"]), True
        return None, False

    def _learn(self, pieces: list[str]) -> None:
        """Many pieces in one call: joined by a break that is a piece of its own (or none), told apart by the library's word numbers."""
        blanks = [p for p in pieces if p.isspace()]
        words = [p for p in pieces if not p.isspace()]
        first, step = (0, 1) if self.lower else (2, 2)
        for k in range(0, len(words), WORDS_AT_ONCE):
            part = words[k : k + WORDS_AT_ONCE]
            got = self.library.encode(("" if self.lower else "x\n") + "\n".join(part), add_special_tokens=False)
            at = np.array(got.word_ids, np.int64)
            if not len(at) or at[-1] != first + step * (len(part) - 1):
                blanks += part
                continue
            mine = (at >= first) & ((at - first) % step == 0)
            self._keep(part, np.array(got.ids, self.width)[mine], np.bincount((at[mine] - first) // step, minlength=len(part)))
        if blanks:
            apart = self.whole(blanks)
            self._keep(blanks, np.concatenate(apart), np.array([len(x) for x in apart], np.int64))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        strings = [plain(x) for x in texts]
        lengths = np.zeros(len(strings), np.int64)
        simple = [i for i, x in enumerate(strings) if self.pattern is not None and not NOT_PLAIN.search(x)]
        other = sorted(set(range(len(strings))) - set(simple))
        apart = dict(zip(other, self.whole([strings[i] for i in other]), strict=True)) if other else {}
        pieces, counts = [], np.zeros(len(simple), np.int64)
        for k, i in enumerate(simple):
            got = self.pattern.findall(strings[i].lower() if self.lower else strings[i])
            counts[k] = len(got)
            pieces += got
        ids, sizes = self._joined(pieces)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        lengths[simple] = np.diff(bounds)
        if not apart:
            return ids, lengths
        for i, x in apart.items():
            lengths[i] = len(x)
        place = dict(zip(simple, range(len(simple)), strict=True))
        return np.concatenate([apart[i] if i in apart else ids[bounds[place[i]] : bounds[place[i] + 1]] for i in range(len(strings))]), lengths


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[begin : begin + size] in a row, and their sizes."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    return flat[at], size


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
