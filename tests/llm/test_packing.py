import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from thermalake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
INNER, CODER = Tokenizer.from_file(PATH), packing.WordCachedTokenizer(PATH, max_words=50)


@settings(max_examples=2500, deadline=None)
@given(st.lists(st.text(alphabet="ab 'sé1!\n\t  \x1c日", max_size=30), min_size=1, max_size=4))
def test_cached_ids_equal_the_tokenizer(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in map(CODER.encode, texts)]
    assert got == [INNER.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_token_text():
    text = "a <|endoftext|> b<|endoftext|>"
    assert np.frombuffer(CODER.encode(text), "<u4").tolist() == INNER.encode(text, add_special_tokens=False).ids


def test_long_words_are_not_held():
    text = "日本語" * 3000 + " " + "x" * 5000
    assert np.frombuffer(CODER.encode(text), "<u4").tolist() == INNER.encode(text, add_special_tokens=False).ids
    assert all(len(key) <= 48 for known in (CODER.parts, CODER.first, CODER.later) for key in known)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 20))
def test_bins_hold_everything_without_gaps(lengths, max_open):
    bins = packing.SumOfSquares(64, max_open)
    closed = []
    for doc, n in enumerate(lengths):
        if n == 64:
            closed.append([(doc, 0, np.arange(n), n)])
        else:
            closed += bins.place((doc, 0, np.arange(n), n))
        assert bins.n_open <= max_open
    closed += bins.close()
    held = {}
    for window in closed:
        size = sum(len(p[2]) for p in window)
        assert size == 64 or size & (size - 1) == 0
        for doc, start, ids, _ in window:
            assert len(ids) and ids[0] == start
            held.setdefault(doc, []).extend(ids.tolist())
    assert {d: sorted(v) for d, v in held.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}


def test_round_trip(spark):
    rows = [(i, f"word {i} " * (i * 37 % 900)) for i in range(200)] + [(500, None), (501, ""), (None, "x"), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS start")
    got = packing.pack_documents(docs).collect()
    windows, tokens = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id not in (3, None):
            tokens.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for spans in windows.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
        size = sum(n for _, n in spans)
        assert size == 2048 or size & (size - 1) == 0
    for doc, text in rows:
        if doc in tokens:
            ids = np.frombuffer(b"".join(x[1] for x in sorted(tokens[doc])), "<u4").tolist()
            assert ids == INNER.encode(text or "", add_special_tokens=False).ids + [1] and tokens[doc][0][2] == len(ids)
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("max_open", [1, 5, 1000])
def test_bins_by_key_hold_everything_apart_and_bounded(max_open):
    draws, bins, out, put = np.random.default_rng(3), packing.Bins(64, max_open), [], {}
    for i in range(300):
        n, key = int(draws.integers(1, 64)), "abc"[i % 3] if i % 7 else None
        out += bins.place(key, (i, 0, np.arange(n, dtype="<u4"), n))
        put[i] = (key, n)
        assert bins.n_open == sum(b.n_open for b in bins.of.values()) <= max_open
    out += bins.close()
    held = {}
    for window in out:
        assert len({put[p[0]][0] for p in window}) == 1
        assert (total := sum(len(p[2]) for p in window)) == 64 or total & (total - 1) == 0
        for doc, start, ids, _ in window:
            held.setdefault(doc, []).extend(range(start, start + len(ids)))
    assert {k: sorted(v) for k, v in held.items()} == {k: list(range(n)) for k, (_, n) in put.items()}


def ids(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_new_words_are_not_kept():
    coder = packing.WordCachedTokenizer(PATH)
    text = " ".join(f"thoner{i:x}ble" for i in range(5000))
    assert ids(coder, text) == INNER.encode(text, add_special_tokens=False).ids
    assert not (coder.parts or coder.first or coder.later)


BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=BLANKS + "ab 's!1é\x1c\x1f\u180e\u200b\ufeff½", max_size=30))
def test_blanks_of_all_kinds(text):
    assert ids(CODER, text) == INNER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" + " " * 1_200_000 + "b", " \n" * 600_000, "a  <|endoftext|>  b", "'LL we'll 'sé'S " * 3, "x" * 30_000])
def test_long_and_odd_texts(text):
    assert ids(CODER, text) == INNER.encode(text, add_special_tokens=False).ids


def test_every_letter_and_number_is_cut_alike():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isalnum() or c < 0x3000)]
    for at in range(0, len(points), 5000):
        text = "".join(f"a{c}1{c} {c}!{c}" for c in points[at : at + 5000])
        assert ids(CODER, text) == INNER.encode(text, add_special_tokens=False).ids


def test_words_are_kept_without_tiktoken(monkeypatch):
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    coder = packing.WordCachedTokenizer(PATH)
    for text in ["the eder.\nEranth the  ontheahe", "a <|endoftext|> b", "", " \t x"]:
        assert ids(coder, text) == INNER.encode(text, add_special_tokens=False).ids
    assert coder.ranked is None and coder.later


def test_merges_that_ranks_do_not_tell_are_left_to_the_tokenizer(tmp_path):
    # "abc" is made of "ab" and "c", but "bc" is joined first: the ids are "a" and "bc", where ranks alone would find "abc"
    made = [("b", "c"), ("a", "b"), ("ab", "c")]
    vocab = {letter: i for i, letter in enumerate([*packing._byte_letters().values(), *map("".join, made)])}
    inner = Tokenizer(models.BPE(vocab, made))
    inner.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    inner.save(path := str(tmp_path / "odd.json"))
    coder = packing.WordCachedTokenizer(path)
    assert coder.ranked is None
    assert ids(coder, "abc ab bc") == inner.encode("abc ab bc").ids
    assert ids(coder, "abc") == [vocab["a"], vocab["bc"]]
