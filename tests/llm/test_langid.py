import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from thermalake.llm import langid, queries

v = lambda *x: np.array(x, np.float32)


def lexicon(langs, longest, grams):
    return langid.Lexicon(langs, longest, {size: langid.Table.of(rows, len(langs)) for size, rows in grams.items()})


def test_backoff_uses_words_then_longest_grams():
    model = lexicon(["a", "b"], 2, {0: {"zug": v(-1, -3)}, 1: {"z": v(-1, -2), "x": v(-2, -1)}, 2: {"<x": v(-4, -1), "q>": v(-1, -4)}})
    assert model.words(["zug", "xq", "az", "日"]).tolist() == [[-1, -3], [-2.5, -2.5], [-1, -2], [0, 0]]
    assert model.text("Zug zug!")[0] == "a" and model.text(" 12 ?") == ("und", 0.0)
    assert model.text("x" * 500)[0] == "b" and len(model.memo) == 1


def test_a_full_memo_and_long_texts_change_nothing(monkeypatch):
    rows = {f"{a}{b}": v(-(ord(a) % 5), -(ord(b) % 7)) for a in "abcdefgh" for b in "abcdefgh"}
    model = lexicon(["p", "q"], 1, {0: rows, 1: {}})
    text = " ".join(rows) + " " + "z" * 99
    want = (np.sum(list(rows.values()), 0)) / 65
    assert model.mean(text) == pytest.approx(want)
    monkeypatch.setattr(langid, "_MEMO", 64)
    small = lexicon(["p", "q"], 1, {0: rows, 1: {}})
    assert [small.mean(text).tolist() for _ in range(3)] == [pytest.approx(want)] * 3 and len(small.table) == 64


def test_letters_are_those_of_unicode():
    assert langid.letters("² ½ ① 12 _ ٣") == []
    assert langid.letters("x² Straße١ Éa½b 日本_") == ["x", "straße", "éa", "b", "日本"]


def test_odd_rows(spark):
    rows = [(i, f"the cat sat {i}", "en") for i in range(40)] + [(100 + i, f"die katze saß {i}", "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", None), (502, "12 !", "de"), (None, "the die", None), (3, "the cat", "en"), (3, "the cat", "en"), (700, "katze " * 50000, "de")]
    rows += [(503, "²", None), (504, "½ ① 12", None)] + [(None, f"the cat {i}", "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "'x' AS lang_pred", "1 AS n", "2 AS size", "3 AS _lang", "4 AS _share", "5 AS _draw", "true AS kept_out")
    model = langid.learn(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == "en" and by[110].lang_pred == "de" and by[700].lang_pred == "de"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (500, 501, 502, 503, 504))
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5
    empty = docs.limit(0)
    assert langid.predict(empty, langid.learn(empty)).count() == 0 and langid.accept(empty, model).count() == 0
    assert langid.predict(docs, langid.learn(empty)).first().lang_pred == "und"


def test_texts_are_kept_if_nothing_could_be_learned(spark):
    docs = spark.createDataFrame([(1, "the cat", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.accept(docs, langid.learn(docs)).collect()] == [1]


def test_many_languages_are_learned_and_predicted(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(1000 * i + k, f"{name(i)}o {name(i)}ka{k % 3} {name(i)}u", name(i)) for i in range(600) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.langs) == 600 and sum(len(t.above) for t in model.grams.values()) <= 1_500_000
    got = langid.predict(docs, model).collect()
    assert np.mean([r.lang_pred == name(r.doc_id // 1000) for r in got]) > 0.98
    assert langid.accept(docs, model).count() == len(rows)


def brute_letters(text):
    clean = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
    return clean.split()


def draws(spark, grams):
    """The number from 0 to 1 that a hash gives each entry."""
    table = spark.createDataFrame([(g,) for g in sorted(grams)], "gram string")
    return {r.gram: (r.h % (1 << 64) >> 11) / 2**53 for r in table.selectExpr("gram", "xxhash64(gram, 21) AS h").collect()}


def brute_model(spark, rows, entries, longest):
    """Scores by language, size and entry of rows (text, lang)."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for word in brute_letters(text):
            counts[lang, 0][word] += 1
            for size in range(1, longest + 1):
                counts[lang, size].update(f"<{word}>"[i : i + size] for i in range(len(word) + 3 - size))
    langs = sorted({lang for lang, _ in counts})
    kept, draw = {}, draws(spark, {g for c in counts.values() for g in c})
    for key, c in counts.items():
        held = Counter(c.values())
        above = lambda n: sum(h for m, h in held.items() if m > n)  # noqa: B023, E731
        kept[key] = {g: n for g, n in c.items() if draw[g] < (entries - above(n)) / held[n]}
    score = {}
    for size in range(longest + 1):
        known = {g for lang in langs for g in kept.get((lang, size), ())}
        for g in known:
            score[size, g] = [math.log10(kept.get((x, size), {}).get(g, 0.25) / sum(counts[x, size].values())) for x in langs]
    return langs, score


def brute_mean(text, langs, score, longest):
    rows = []
    for word in brute_letters(text):
        if (0, word) in score:
            rows.append(score[0, word])
            continue
        for size in range(longest, 0, -1):
            padded = f"<{word}>"
            hits = [score[size, padded[i : i + size]] for i in range(len(padded) - size + 1) if (size, padded[i : i + size]) in score]
            if hits:
                rows.append(np.mean(hits, axis=0))
                break
        else:
            rows.append([0.0] * len(langs))
    return np.mean(rows, axis=0) if rows else None


@pytest.mark.parametrize("entries", [10_000, 60])
def test_learning_and_prediction_against_brute_force(spark, entries):
    rng = np.random.default_rng(4)
    stems = {"en": ["the", "of", "ing", "cat", "run"], "de": ["der", "die", "ung", "katze", "läuf"], "fr": ["le", "la", "eux", "chat", "cour"]}
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join("".join(rng.choice(stems[lang], rng.integers(1, 3))) + ("" if rng.random() < 0.8 else "x²") for _ in range(rng.integers(1, 12)))
        rows.append((i, text, lang if rng.random() < 0.9 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.labelled_sample(docs, 1000).collect()
    assert Counter((r.text, r.lang) for r in sample) == Counter((t, x) for _, t, x in rows if x)
    assert 5 < sum(r.kept_out for r in sample) < 50
    langs, score = brute_model(spark, [(r.text, r.lang) for r in sample if not r.kept_out], entries, 4)
    model = langid.learn(docs, entries=entries)
    level = {
        s: sum(s * m[langs.index(r.lang)] - np.log(np.exp(s * (m - m.max())).sum()) - s * m.max() - 1e-4 * s for r in sample if r.kept_out and (m := brute_mean(r.text, langs, score, 4)) is not None)
        for s in langid.SLOPES
    }
    assert model.langs == langs and model.slope == pytest.approx(max(level, key=level.get))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for doc, text, _ in rows:
        mean = brute_mean(text, langs, score, 4)
        share = np.exp(model.slope * (mean - mean.max()))
        share /= share.sum()
        assert got[doc].score == pytest.approx(share.max(), abs=1e-4)
        assert share[langs.index(got[doc].lang_pred)] == pytest.approx(share.max(), abs=1e-4)


def test_words_seen_once_fill_the_bound(spark):
    """A language of many different words, each once, keeps as many as there is room for, and is found by them."""
    rows = [(i, " ".join(f"aa{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(100)), "aa") for i in range(200)]
    rows += [(1000 + i, "the dog and the cat ran", "en") for i in range(200)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), entries=5000)
    words = [w for w in model.grams[0].at if w.startswith("aa")]
    assert 4600 < len(words) < 5400


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op8_langid_word_backoff(spark, sf).collect()
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(truth) and np.mean(right) > 0.97
    assert np.mean([r.score for r in got]) == pytest.approx(1, abs=0.05)
    assert all(re.fullmatch(r"[a-z]+", r.lang_pred) for r in got)
