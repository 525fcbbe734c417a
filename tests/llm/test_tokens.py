import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from veilspan.llm import bpe, packing, token_files
from veilspan.llm.encoding import encoder

WORDS, BYTES, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def by_row(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in rows), key=lambda x: (not x[0], x[1] or 0, x[2]))


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_give_the_library_s_ids(path, odd_docs, sample):
    texts = [r["text"] or "" for df in (odd_docs, sample) for r in df.select("text").collect()]
    ids, sizes = encoder(path).encode([t.encode() for t in texts])
    wanted = [library(path)(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in wanted] and ids.tolist() == [i for x in wanted for i in x]
    assert encoder(path).encode([])[0].tolist() == []


def test_token_files_read_back(spark, odd_docs, no_docs, sample, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 40)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 7)
    for docs in (odd_docs, sample):
        files = token_files.write(docs, WORDS)
        got = sorted(token_files.scan(spark, files).collect(), key=lambda r: r["start"])
        wanted = {}
        for r in docs.collect():
            wanted.setdefault(r["doc_id"], []).append([*library(WORDS)(r["text"]), 1])
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(got) == docs.count()
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(k), len(x), crc(x)) for k, v in wanted.items() for x in v)
    found = token_files.lookup(spark, files, [3, 50, 10**9]).collect()
    assert {r["doc_id"] for r in found} == {3, 50} and all(np.frombuffer(r["ids"], "<u4").tolist() == wanted[r["doc_id"]][0] for r in found)
    assert token_files.scan(spark, token_files.write(no_docs, WORDS)).count() == 0


def test_a_wrong_dictionary_is_noticed(spark, sample):
    files = token_files.write(sample.limit(5), WORDS)
    broken = token_files.FileSet(files.path, "0" * 64, files.starts)
    with pytest.raises(Exception):  # noqa: B017
        token_files.scan(spark, broken).collect()


def test_packing_places_each_id_once(spark, odd_docs, no_docs, sample):
    for docs in (odd_docs.repartition(3), sample.repartition(4)):
        packed = packing.pack(docs, BYTES)
        rows = sorted(packing.pieces(spark, packed, ids=True).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
        wanted = sorted([str(r["doc_id"]), [*library(BYTES)(r["text"]), 0]] for r in docs.collect())
        at, docs_seen, open_doc = 0, [], []
        for r in rows:
            assert r["sequence_id"] * 1024 + r["offset"] == at and r["offset"] + r["length"] <= 1024
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"] and r["start"] == len(open_doc)
            open_doc += ids
            at += r["length"]
            if len(open_doc) == r["doc_tokens"]:
                docs_seen.append([str(r["doc_id"]), open_doc])
                open_doc = []
        assert sorted(docs_seen) == wanted and at == packed.total
        whole = sorted(packing.sequences(spark, packed).collect(), key=lambda r: r["sequence_id"])
        assert [r["sequence_id"] for r in whole] == list(range(-(-at // 1024))) and all(r["n_tokens"] == 1024 for r in whole[:-1])
        assert b"".join(r["ids"][: 4 * r["n_tokens"]] for r in whole) == b"".join(r["ids"] for r in rows)
        last = whole[-1]
        assert len(last["ids"]) == 4 * (last["n_tokens"] if last["n_tokens"] & (last["n_tokens"] - 1) == 0 else 1024)
    empty = packing.pack(no_docs, BYTES)
    assert packing.pieces(spark, empty).count() == 0 and packing.sequences(spark, empty).count() == 0


@pytest.mark.parametrize(("start", "length"), [(0, 1), (0, 1024), (1023, 1), (1023, 2), (5, 5000), (1024, 2048)])
def test_cuts(start, length):
    got = packing.cuts(start, length, 1024)
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == length
    assert all((start + a) // 1024 == (start + b - 1) // 1024 for a, b in got)


def test_transducer_is_the_reference_encoding(spark, odd_docs, sample, no_docs):
    ranks = bpe.load_ranks(RANKS)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = bpe.bpe_encoder(RANKS)
    texts = [r["text"] or "" for df in (odd_docs, sample) for r in df.select("text").collect()] + ["=" * 700, "ab" * 300, "🙂" * 40, "x" * 2000]
    ids, sizes = machine.encode([t.encode() for t in texts])
    wanted = [theirs.encode_ordinary(t) for t in texts]
    assert ids.tolist() == [i for x in wanted for i in x] and sizes.tolist() == [len(x) for x in wanted]
    back = bpe.decode(bpe.encode(odd_docs, RANKS), RANKS).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert sorted(map(tuple, bpe.round_trip(odd_docs, RANKS).collect()), key=str) == sorted((tuple(r)[:4] for r in back), key=str)
    assert bpe.round_trip(no_docs, RANKS).count() == 0


def test_transducer_begins_anew_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 20_000)
    ranks = bpe.load_ranks(RANKS)
    machine = bpe.Transducer(ranks)
    for word in (b" transducers", b" determinised", b" lookahead", b" transducers") * 5:
        assert [machine.bytes_of[i] for i in machine.encode(word)] == bpe.merged(word, ranks)
        assert machine.held < 60_000  # one word beyond the bound, at most, pairs included


def test_stream_decoder_holds_back_open_characters():
    rng = np.random.default_rng(5)
    data = "aé日🙂z".encode() + b"\xff\xe2\x82" + "ü".encode() + b"\xf0\x9fA\xed\xa0\x80\xe2"
    for cut in range(1, 6):
        moves = bpe.TokenMoves([data[i : i + cut] for i in range(0, len(data), cut)])
        for portion in (1, 2, 100):
            d, ids = bpe.StreamDecoder(moves), np.arange(len(moves.tokens), dtype="<u4")
            out = [d.feed(ids[k : k + portion]) for k in range(0, len(ids), portion)]
            text = "".join(x.decode("utf-8", "replace") for x in [*out, d.end()])  # each portion by itself: no character is cut
            assert text == data.decode("utf-8", "replace") and (d.state, d.held) == (0, b"")
    bits = [b"a", b"\xe2", b"\x82", b"\xac", b"\xf0\x9f", b"\x99\x82!", b"\xc3", "é".encode(), b"\xed", b"\xa0", b"x\xe2\x82"]
    moves = bpe.TokenMoves(bits)
    for _ in range(300):
        ids = rng.integers(0, len(bits), 30).astype("<u4")
        d, cuts = bpe.StreamDecoder(moves), sorted(rng.integers(0, 31, 3).tolist())
        out = [d.feed(x) for x in np.split(ids, cuts)] + [d.end()]
        assert "".join(x.decode("utf-8", "replace") for x in out) == b"".join(bits[i] for i in ids).decode("utf-8", "replace")


def test_memory_that_begins_anew_gives_the_same_ids(monkeypatch):
    import public_tokenizers

    from veilspan.llm import encoding

    texts = [f"word{i % 50} and{i} the rest {i * i}".encode() for i in range(300)] + [b"", b"x" * 5000, "naïve – …".encode()]
    wanted = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)
    monkeypatch.setattr(encoding, "REMEMBERED_BYTES", 20_000)
    small = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for begin in range(0, len(texts), 40):
        ids, sizes = small.encode(texts[begin : begin + 40])
        ends = np.cumsum(wanted[1])
        first = ends[begin - 1] if begin else 0
        assert sizes.tolist() == wanted[1][begin : begin + 40].tolist() and ids.tolist() == wanted[0][first : first + len(ids)].tolist()
    assert len(small.known) < 300
