import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from lexarium.llm import bpe, packing
from lexarium.llm.bpe import WordTokenizer, bpe_encode
from lexarium.llm.packing import BestFit, ByteTokenizer, best_fit_packing, token_pieces

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word():
    with open(WORD, encoding="utf-8") as f:
        return WordTokenizer(f.read()), tokenizers.Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    with open(BYTE, encoding="utf-8") as f:
        return ByteTokenizer(f.read()), tokenizers.Tokenizer.from_file(BYTE)


TEXT = st.one_of(st.text(max_size=60), st.text("aAbeiTh's.,ÉéñΣ \n\t\x1c<|>12½", max_size=60), st.lists(st.sampled_from(["the", "Thing", "<|endoftext|>", " ", "  ", "\n", "don't", "x.,", "²", "日本"]), max_size=12).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_words_as_the_library(word, text):
    own, library = word
    ids, decoded = own.block([text])
    expected = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids[0], "<i4").tolist() == expected
    assert decoded[0] == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bytes_as_the_library(byte, text):
    own, library = byte
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", "\n " * 60_000, "a" * 60_000 + "\n" * 60_000, "<|endoftext|>" * 3])
def test_bytes_of_long_runs_and_special_tokens(byte, text):
    own, library = byte
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_trie_is_plain_merging(word):
    encoder = word[0].encoder
    words = ["a", "ab", "abc", "thing", "things", "thinging", "lowest", "lower", "qqqqqq" * 30]
    for w, tokens in encoder.encode(words).items():
        assert tokens == encoder.merged([*w[:-1], w[-1] + encoder.word_end])


def test_bpe_encode(frame, odd, word):
    df = frame([(i, t, 1) for i, t in odd], "doc_id long, text string, ids int")
    rows = bpe_encode(df, WORD).collect()
    assert sorted((r.n_tokens, r.ids) for r in rows) == sorted((len(x), x) for x in (word[1].encode(t or "", add_special_tokens=False).ids for _, t in odd))
    assert bpe_encode(frame([]), WORD).count() == 0


def test_occurrences_of_words_cost_no_objects(word):
    text = "some words, again " * 100_000
    expected = word[1].encode(text, add_special_tokens=False).ids
    word[0].block([text])
    tracemalloc.start()
    ids, decoded = word[0].block([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.frombuffer(ids[0], "<i4").tolist() == expected and decoded[0] == word[1].decode(expected)
    assert peak < 50 * 300_000  # bytes; a string and a list entry for each word take more


def test_next_task_merges_no_pair_again(word, monkeypatch):
    with open(WORD, encoding="utf-8") as f:
        definition = f.read()
    texts = ["reorntou thheessh. laqueeuxè, enkeitheitkeit", "avecenqueêé"]
    tokenizer = bpe.word_tokenizer(definition, "a")
    first = tokenizer.block(texts)
    monkeypatch.setattr(bpe.TrieEncoder, "merged", lambda *_: pytest.fail("merged again"))
    assert bpe.word_tokenizer("".join([*definition]), "a").block(texts) == first
    other = bpe.word_tokenizer(definition, "b")
    assert not other.known and not other.encoder._follows


def test_blocks_hold_every_row(frame, odd, word, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 8)
    texts = [t or "" for _, t in odd]
    for size in (1, 4, len(texts)):
        found = list(bpe.blocks(np.array([len(t.encode()) for t in texts[:size]])))
        assert [i for a, b in found for i in range(a, b)] == list(range(size))
        assert all(b - a == 1 or sum(len(t.encode()) for t in texts[a:b]) <= 8 for a, b in found)
    assert list(bpe.blocks(np.zeros(0, np.int64))) == []
    whole = word[0].block(texts)
    parts = [word[0].block([t]) for t in texts]
    assert [[x for (x,), _ in parts], [x for _, (x,) in parts]] == [*whole]


def test_white_space_and_folding_of_joined_chunks(word):
    own, library = word
    texts = ["a%sb %s c" % (c, c) for c in map(chr, [0, *range(9, 14), *range(28, 33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])]
    texts += ["ΑΣ Σ", "e \u0301x e\u0301", "\ufa6c x\ufacf", "İI", "a🙂b 𐐀c", "<|ENDOFTEXT|> <|endoftext|>a<|startoftext|>", "\n\n", ""]
    for some in (texts, *[[t] for t in texts]):
        ids, decoded = own.block(some)
        for t, i, d in zip(some, ids, decoded, strict=True):
            expected = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(i, "<i4").tolist() == expected and d == library.decode(expected, skip_special_tokens=False), ascii(t)


def packed(df, capacity):
    rows = best_fit_packing(df, capacity).collect()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return rows, len(bins)


def test_packing(frame, odd, byte):
    pieces = token_pieces(frame(odd), BYTE, 128)
    rows, bins = packed(pieces, 128)
    total = sum(r.length for r in rows)
    assert bins <= -(-total // 128) + 2
    expected = sorted(len(byte[1].encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd)
    assert sum(expected) == total
    whole = np.array(byte[1].encode(odd[8][1], add_special_tokens=False).ids + [0], "<u4")
    for r in rows:
        if r.doc_id == 8:
            assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.length == 128 or r.piece == 0
    assert packed(token_pieces(frame([]), BYTE), 128) == ([], 0)


def test_packing_merges_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 50)
    rows, bins = packed(spark.range(0, 400, 1, 40).selectExpr("id", "1 + id % 30 AS length"), 100)
    assert len(rows) == 400 and bins <= 1.15 * sum(r.length for r in rows) / 100 + 1


def test_packing_many_small_partitions(spark):
    df = spark.range(0, 400, 1, 40).selectExpr("id", "1 + id % 60 AS length")
    rows, bins = packed(df, 100)
    assert len(rows) == 400 and bins <= 1.03 * sum(r.length for r in rows) / 100 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(sizes):
    bins, places, fills = BestFit(50, 0).pack(sizes)
    assert sum(fills) == sum(sizes) and all(f <= 50 for f in fills)
    assert sum(f <= 25 for f in fills) <= 1
    assert len({(b, p) for b, p in zip(bins, places, strict=True)}) == len(sizes)
