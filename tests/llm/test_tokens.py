"""Encoding by pieces equals encoding whole texts; packing and token files on small tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import packing, token_files
from tidewatch.llm.tokens import Encoder, tokenizer_file

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ALPHABET = list("abzZÉéßÿ÷ñ .,;:!?%#$&*|'’\"-_@0123\n\t\r\x0b\x0c\x1c\x85\xa0　ΣσАя中😀‍́<>=()")
ODD = [*ALPHABET, "'s", "'t", " 're", "<|endoftext|>", "İ", "ﬁ"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    json = tokenizer_file(public_tokenizers.path(request.param))
    return Encoder(json), Tokenizer.from_str(json)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(ODD), max_size=25).map("".join), max_size=8))
def test_pieces_give_the_ids_of_whole_texts(both, texts):
    fast, plain = both
    got = [np.frombuffer(b, "<u4").tolist() for b in fast.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_equal_bytes_are_told_apart(both):
    fast, plain = both
    texts = ["\r ", "\u200d", "-N", "\u4e2d", "\u200d", "\r ", "x -N \u4e2d"]
    got = [np.frombuffer(b, "<u4").tolist() for b in fast.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


TEXTS = [(1, "The cat sat. " * 700), (2, None), (3, ""), (4, "Short text."), (4, "Short text."),
         (None, "no id"), (5, "one two three " * 90), (6, "x"), (7, "a b c d e f g " * 300)]


def frame(spark, rows=TEXTS):
    # Extra columns with names the operators use themselves.
    return spark.createDataFrame([(i, t, "junk", 7) for i, t in rows],
                                 "doc_id long, text string, part string, length int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("window", [16, 64, 1024])
def test_packing_places_every_token_once(spark, window):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(frame(spark), path, window).collect()
    ids = {}
    for i, t in TEXTS:
        ids.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(len(x) == r.doc_tokens and crc(x[r.start:r.start + r.length]) == r.ids_crc32
                   for x in ids[r.doc_id])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    short = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    assert short <= 1  # only the last residual window may be padded


def test_least_squares_repeats_fit_the_histogram():
    histogram = np.zeros(65, np.int64)
    histogram[[10, 54, 32, 20, 22]] = [50, 50, 30, 10, 20]
    slots, sequences, line = packing.plan(histogram, 64)
    used = {}
    for length, lo, hi, *_ in slots:
        used[length] = used.get(length, 0) + hi - lo
    assert used == {10: 50, 54: 50, 32: 30, 20: 10, 22: 20}
    assert sequences >= 50 + 15 and line < 64 * 15


def test_empty_tables(spark):
    empty = frame(spark).limit(0)
    assert packing.pack(empty, public_tokenizers.path(FILES[0])).count() == 0
    assert token_files.tokens_in_files(empty, public_tokenizers.path(FILES[1])).count() == 0


def test_token_files_round_trip_and_prune(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    where = str(tmp_path / "ids")
    token_files.write_tokens(frame(spark), where, path)
    rows = token_files.read_tokens(spark, where).collect()
    expected = sorted(((-1 if i is None else i), plain.encode(t or "", add_special_tokens=False).ids + [1])
                      for i, t in TEXTS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in rows) == expected
    digests = sorted(token_files.token_digests(spark, where).collect(), key=lambda r: r.start)
    at = 0
    assert [-1 if r.doc_id is None else r.doc_id for r in digests] == [i for i, _ in expected]
    for r in digests:
        assert r.start == at
        at += r.n_tokens
    one = token_files.read_tokens(spark, where).filter("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def test_a_worker_keeps_little_of_what_loading_and_learning_took(monkeypatch):
    """Memory freed while the vocabulary is read goes back, and few pieces' results are held at once."""
    from tidewatch.llm import tokens

    given, sizes = [], []
    monkeypatch.setattr(tokens, "give_back", lambda: given.append(1))
    made = tokens.Encoder(tokens.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert given == [1]
    library = made.tokenizer

    class Watched:
        def encode_batch_fast(self, pieces, **how):
            sizes.append(len(pieces))
            return library.encode_batch_fast(pieces, **how)

    made.tokenizer = Watched()
    texts = [" ".join(f"w{n}x{k}" for n in range(400)) for k in range(16)]
    ids = [np.frombuffer(b, "<u4").tolist() for b in made.encode(texts)]
    assert max(sizes) <= tokens.AT_ONCE and sum(sizes) > 3 * tokens.AT_ONCE
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]
