import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groundwork.llm import bpe_count, pieces
from tests.llm.conftest import by_id

WORDS = bpe_count.counter(public_tokenizers.path("word_bpe_49k.json"))
PIECES = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY.no_truncation()
LIBRARY.no_padding()
MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

TRICKY = ["", " ", "a", "  a  b ", "<|endoftext|>x<|startoftext|>", "<|endof", "don't WON'T ’s", "ΣΑΣ", "İ", "éé", "a\x1cb\x85c d e", "\U0001f600\U0001f468‍\U0001f469", "aaaaaaaaaaaaaaaa", "1234567890", "▁ x▁y", "<s></s><unk>", "<0x41>", "\x00\x01", "﻿", "ab\n\n\ncd\t", "你好世界", "!!!???...", "x" * 3000]
texts = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from("abc ABC'.,\n\t<|>_▁éΣ")), max_size=60)


def same_count(text):
    assert WORDS.counts([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def same_ids(text):
    want = MODEL.encode(text, add_bos=True, add_eos=True)
    assert PIECES.encode(text) == want
    assert PIECES.coded(text)[1] == PIECES.decode(want) == MODEL.decode(want)


@pytest.mark.parametrize("text", TRICKY)
def test_tricky(text):
    same_count(text)
    same_ids(text)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_any_text_counts(text):
    same_count(text)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_any_text_encodes(text):
    same_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeilnorst ▁", max_size=200))
def test_backtracking(text):
    same_ids(text)


def test_whole_table(documents):
    docs = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    counts, coded = by_id(bpe_count.token_counts(documents)), by_id(pieces.round_trip(documents))
    assert set(counts) == set(coded) == set(docs)
    for i, text in docs.items():
        n = len(LIBRARY.encode(text, add_special_tokens=False).ids)
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len(text.encode()), n, n > 2048)
        ids = MODEL.encode(text, add_bos=True, add_eos=True)
        assert coded[i]["n_tokens"] == len(ids)
        assert coded[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert coded[i]["decoded_sha256"] == hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, empty):
    docs = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe_count.token_counts(odd).collect())
    assert got == sorted((i, len(LIBRARY.encode(t, add_special_tokens=False).ids)) for i, t in docs)
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in pieces.round_trip(odd).collect())
    assert got == sorted((i, len(MODEL.encode(t)) + 2) for i, t in docs)
    assert bpe_count.token_counts(empty).count() == pieces.round_trip(empty).count() == 0


def test_small_caches_do_not_change_results(documents, monkeypatch):
    monkeypatch.setattr(bpe_count, "CACHE", 10)
    monkeypatch.setattr(pieces, "CACHE", 10)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    words, codec = bpe_count.TokenCounter(public_tokenizers.path("word_bpe_49k.json")), pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    some = [r["text"] or "" for r in documents.limit(40).collect()]
    assert [words.counts([t])[0] for t in some] == WORDS.counts(some)
    assert all(codec.encode(t) == MODEL.encode(t, add_bos=True, add_eos=True) for t in some)


def test_words_met_again_stay_in_a_small_cache(monkeypatch):
    """Rare words fill the cache again and again; a frequent word is learned once."""
    monkeypatch.setattr(bpe_count, "CACHE", 100)
    counter, learned = bpe_count.TokenCounter(public_tokenizers.path("word_bpe_49k.json")), []
    plain = counter.learn
    monkeypatch.setattr(counter, "learn", lambda fresh: (learned.extend(fresh), plain(fresh)))
    texts = [f"the h\u00e9lice, {' '.join(f'w{i}x{k}' for k in range(30))} the" for i in range(40)]
    assert [counter.counts([t])[0] for t in texts] == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]
    assert learned.count("the") == learned.count("h\u00e9lice,") == 1 and len(learned) == 40 * 30 + 2
    assert len(counter.cache) + len(counter.cache.older) <= 100 + 2 * 32


def test_words_learned_together():
    """Letters only, marks, empty words, letters that compose or grow in lower case, in one pass."""
    text = "a \x1cb\x1c\x1c c, ,,d'll e\u0301\u0301x \u0130\u0307i \u212b\u212b. \u0958\u0959 12\u00b2 \u0301\u0338 \u1e9b\u0323! x'S's'' \U0001f600\u200d\U0001f600 \u03a3\u0391\u03a3"
    texts = [text, *text.split(" "), text.replace(" ", ""), "", " ", None]
    assert bpe_count.TokenCounter(public_tokenizers.path("word_bpe_49k.json")).counts(texts) == [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]
