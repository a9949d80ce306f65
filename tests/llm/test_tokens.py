import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Regex, Tokenizer, pre_tokenizers

from sablegrid.llm import bpe, flat, fst, library, packing, pretoken, session, tokenfile

ALPHABET = list("aaaabcdeZé9'  \n\tsretvldm.! 漢٣ 　'thingİΣ́") + ["<|endoftext|>", "ation", " the", "\r\n", "𝒳", "😀"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return made + [None, "", "a" * 3000, "ab" * 500, " " * 99, "\n" * 50, "!" * 300, "it's we've I'll 'said ''s x's", "word " * 5000, made[3], made[3]]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long").repartition(5)


def test_byte_bpe_equals_library_and_round_trips(table):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in bpe.encode_decode(table, path, keep_ids=True).collect()}
    assert len(found) == len(texts())
    for i, text in enumerate(texts()):
        ids = library.encode_ordinary(text or "")
        row = found[i]
        raw = np.array(ids, "<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert bytes(row.ids) == raw and bytes(row.decoded) == (text or "").encode()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def ids_of(name, end):
    library = Tokenizer.from_file(P.path(name))
    return {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for i, t in enumerate(texts())}


def test_token_files_read_back(table):
    expected = ids_of("byte_bpe_50k.json", 0)
    start = 0
    found = {r.doc_id: r for r in tokenfile.token_files(table, P.path("byte_bpe_50k.json")).collect()}
    for i in range(len(texts())):
        row = found[i]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(expected[i]), zlib.crc32(expected[i]))
        start += len(expected[i])


@pytest.mark.parametrize("window", [16, 4096])
def test_packing_cuts_without_loss(table, window):
    expected = ids_of("word_bpe_49k.json", 2)
    rows = packing.pack(table, P.path("word_bpe_49k.json"), window=window, keep_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in expected.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes()
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in pieces)
    total = sum(map(len, expected.values()))
    assert sorted(by_sequence) == list(range(-(-total // window)))
    for k, pieces in by_sequence.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert sum(r.length for r in pieces) == pieces[0].sequence_length == min(window, total - k * window)


def test_empty_tables(spark, table):
    none = table.limit(0)
    assert bpe.encode_decode(none, P.path("byte_bpe_multi_50k.tiktoken")).collect() == []
    assert packing.pack(none, P.path("word_bpe_49k.json")).collect() == []
    assert tokenfile.token_files(none, P.path("byte_bpe_50k.json")).collect() == []


def test_shared_folder_is_read_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def multi_library():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_both_libraries_class_all_code_points_alike():
    groups, everything = flat.char_groups(), "".join(POINTS)
    for name, group in ((r"\p{L}", flat.LETTER), (r"\p{N}", flat.NUMBER), (r"\s", flat.SPACE)):
        split = pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True)
        assert "".join(x for x, _ in split.pre_tokenize_str(everything)) == "".join(c for c in POINTS if groups[ord(c)] == group)


def test_every_code_point_as_the_libraries_do():
    made = ["".join(f"a{c}1{c} {c}b's" for c in POINTS[i : i + 64]) for i in range(0, len(POINTS), 64)]
    path, tik = multi_library()
    parts = [made[i : i + 1500] for i in range(0, len(made), 1500)]
    split = lambda ids, bounds: [x.tolist() for x in np.split(ids, bounds[1:-1])]
    encoder = bpe.PieceCache(bpe.Ranks.load(path).replay, np.uint32)
    for part in parts:
        assert split(*encoder.tokens(flat.Texts(part), pretoken.spaced_pieces)) == [tik.encode_ordinary(t) for t in part]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, counter = library.LibraryTokens(P.path(name)), fst.MergeTransducer(P.path(name)) if name.startswith("byte") else None
        for part in parts:
            expected = [e.ids for e in own.library.encode_batch(part, add_special_tokens=False)]
            assert split(*own.tokens(pa.array(part))) == expected
            if counter:
                assert counter.counts(pa.array(part)).tolist() == [len(e) for e in expected]


def test_long_texts_are_cut_where_pieces_begin(monkeypatch):
    monkeypatch.setattr(pretoken.chunks, "__defaults__", (64,))
    monkeypatch.setattr(pretoken, "WINDOW", 24)
    rng = random.Random(8)
    made = ["".join(rng.choice(ALPHABET) for _ in range(3000)) for _ in range(12)]
    made += ["".join(rng.choice("漢字語、。") for _ in range(900)), "x" * 1000, "a1" * 400, " " * 500 + "end", "it's " * 300, "word " * 300, "é" * 300]
    path, tik = multi_library()
    encoder, own = bpe.PieceCache(bpe.Ranks.load(path).replay, np.uint32), [library.LibraryTokens(P.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
    counter = fst.MergeTransducer(P.path("byte_bpe_50k.json"))
    for t in made:
        assert encoder.tokens(flat.Texts([t]), pretoken.spaced_pieces)[0].tolist() == tik.encode_ordinary(t)
        for o in own:
            assert o.tokens(pa.array([t]))[0].tolist() == o.library.encode(t, add_special_tokens=False).ids
        assert counter.counts(pa.array([t])).tolist() == [len(own[0].library.encode(t, add_special_tokens=False).ids)]
    assert sum(1 for _ in pretoken.chunks(flat.Texts(["word " * 300]), 64)) > 20


def test_pieces_that_share_a_hash_are_told_apart(monkeypatch):
    path, tik = multi_library()
    monkeypatch.setattr(bpe, "hash_ranges", lambda words8, starts, lengths, seed=0: flat.hash_ranges(words8, starts, lengths, seed) & np.uint64(2**64 - 1 if seed else 3))
    encoder = bpe.PieceCache(bpe.Ranks.load(path).replay, np.uint32)
    for t in ("many words share a first hash here", "words many here again", "and others come too, many of them"):
        assert encoder.tokens(flat.Texts([t]), pretoken.spaced_pieces)[0].tolist() == tik.encode_ordinary(t)


def test_repeated_and_null_ids(spark):
    rows = [(None, "one text"), (None, "two texts"), (4, "same id"), (4, "another"), (4, "same id"), (1, None), (2, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = sorted((repr(i), len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(t or "").ids)) for i, t in rows)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in fst.count_tokens(table, P.path("byte_bpe_50k.json")).collect()) == expected
    found = tokenfile.token_files(table, P.path("byte_bpe_50k.json")).collect()
    assert sorted((repr(r.doc_id), r.n_tokens - 1) for r in found) == expected
    assert len(bpe.encode_decode(table, P.path("byte_bpe_multi_50k.tiktoken")).collect()) == 7
    packed = packing.pack(table, P.path("word_bpe_49k.json"), window=8).collect()
    assert sum(r.length for r in packed) == sum(len(Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
