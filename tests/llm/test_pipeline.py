import itertools
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_fp

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stages(spark, docs, tmp_path):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{tmp_path}/{name}")
        out.append(spark.read.parquet(f"{tmp_path}/{name}"))
    return out


def check(before, found, line, near, mixed, packed):
    columns = before.columns
    assert all(df.columns == columns for df in (found, line, near, mixed))
    rows = [df.collect() for df in (before, found, line, near, mixed, packed)]
    ids = [[r.doc_id for r in x] for x in rows]

    def has_letters(r):
        return any(unicodedata.category(c)[0] == "L" for c in r.text or "")

    gone = Counter(rows[0]) - Counter(rows[1])
    assert not Counter(rows[1]) - Counter(rows[0])
    assert all(not has_letters(r) for r in gone) and all(has_letters(r) for r in rows[1])
    want = {d: h for d, _, _, h in brute_lines([(r.doc_id, r.text) for r in rows[1]])}
    got = {d: h for d, _, _, h in brute_lines([(r.doc_id, r.text) for r in rows[2]])}
    assert Counter(ids[1]) == Counter(ids[2]) and want.keys() == got.keys()
    changed = {r.doc_id: r.text for r in rows[1]}
    assert all(r.text == changed[r.doc_id] or r.n_chars == len(r.text) for r in rows[2] if r.doc_id is not None)

    named = [r for r in rows[2] if r.doc_id is not None]
    fps = [brute_fp(r.text) for r in named]
    group = list(range(len(named)))
    for i, j in itertools.combinations(range(len(named)), 2):
        if group[i] != group[j] and (fps[i] ^ fps[j]).bit_count() <= 2:
            group = [group[i] if g == group[j] else g for g in group]
    low = {}
    for r, g in zip(named, group, strict=True):
        low[g] = min(low.get(g, r.doc_id), r.doc_id)
    assert sorted(d for d in ids[3] if d is not None) == sorted(low.values())
    assert ids[3].count(None) == ids[2].count(None)

    copies = Counter(rows[4])
    assert set(copies) <= set(rows[3]) and max(copies.values(), default=0) <= 2
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in rows[4]:
        tokens[r.doc_id] += len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed_tokens = Counter()
    for r in rows[5]:
        packed_tokens[r.doc_id] += r.length
        assert len(np.frombuffer(r.ids, "<u4")) == r.length
    assert packed_tokens == tokens


def test_stages_on_whole_tables(spark, tmp_path):
    check(*stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path))


def test_stages_on_odd_rows(spark, tmp_path):
    line = "a line that many documents have in common, all of them"
    rows = [Row(i, f"{line}\nthe text number {i} has words of its own {i * i}", "en", f"s{i % 3}", 5) for i in range(12)]
    rows += [Row(20, None, None, None, None), Row(21, "", "en", "s", 0), Row(22, "12 345 !", "en", "s", 8), Row(23, "² ½ ①", "en", "s", 5), Row(None, "no id but letters", "en", None, None)]
    rows += [rows[3], Row(30, "word " * 30000, "en", "s1", 1), Row(31, rows[5][1], "en", None, None)]
    check(*stages(spark, spark.createDataFrame(rows, COLUMNS), tmp_path))


def test_stages_on_an_empty_table(spark, tmp_path):
    assert [df.count() for df in stages(spark, spark.createDataFrame([], COLUMNS), tmp_path)] == [0] * 6


def test_run_equals_the_stages(spark, tmp_path):
    last = stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)[-1]
    total = lambda df: Counter({r.doc_id: r.n for r in df.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()})
    assert total(corpus_pipeline.run(spark, SF)) == total(last)


def test_the_language_found_decides_what_stays_and_what_shares_a_sequence(spark, tmp_path):
    words = {"en": "the cat sat with thing", "de": "die katze saß und läuft"}
    rows = [Row(i, f"{words[x]} {'abc'[i % 3]} {words[x][: 5 + i % 7]} {words[x]}", x, "s", 1) for i in range(300) for x in [("en", "de")[i % 2]]]
    rows += [Row(500, "это не латинский текст, хотя в нем есть буквы", None, "s", 1), Row(501, "日本語の文章", "en", "s", 1)]
    rows += [Row(502, words["de"] * 2, None, "s", 1), Row(503, words["de"] * 3, "en", "s", 1), Row(504, words["en"] + " это", "en", "s", 1)]
    found = stages(spark, spark.createDataFrame(rows, COLUMNS), tmp_path)
    lang = {r.doc_id: r.lang for r in found[1].collect()}
    assert lang == {**{i: ("en", "de")[i % 2] for i in range(300)}, 502: "de", 503: "de", 504: "en"}
    mixed = {r.doc_id: r.lang for r in found[4].collect()}
    sequences = {}
    for r in found[5].collect():
        sequences.setdefault(r.sequence_id, set()).add(mixed[r.doc_id])
    assert set().union(*sequences.values()) == {"en", "de"} and all(len(x) == 1 for x in sequences.values())
