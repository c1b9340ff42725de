from zlib import crc32

import numpy as np
import xxhash

from thermalake.llm import nbsvm, queries


def test_odd_rows(spark):
    rows = [(i, f"A calm line of words number {i}.") for i in range(60)] + [(100 + i, f"BUY!! NOW!! CHEAP{i}!!") for i in range(60)]
    rows += [(500, None), (501, ""), (None, "x"), (3, rows[3][1]), (502, "word " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS quality", "0.5 AS score")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(None, 1), (7, None), (8, 5), (9999, 1), (100, 0)], "doc_id long, quality int")
    model = nbsvm.learn(docs, labels)
    got = nbsvm.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert min(by[i] for i in range(60)) > 0.5 > max(by[100 + i] for i in range(60))
    assert by[500] == by[501]
    assert nbsvm.score(docs.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.filter("quality = 1")):
        only = nbsvm.score(docs, nbsvm.learn(docs, none)).collect()
        assert len({r.score for r in only}) == 1 and 0 < only[0].score < 1


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(80)]
    labels = np.array([int(0 in r) ^ int(rng.random() < 0.1) for r in rows])
    scale = rng.normal(size=12)
    weights, bias = nbsvm.dual_descent(rows, scale, labels, np.full(80, 0.5), epochs=400)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    x[:, 12] = 1
    y = labels * 2 - 1
    loss = lambda w: w @ w / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w)).sum()
    own = np.r_[weights / scale, bias]
    best = loss(own)
    assert all(loss(own + rng.normal(size=13) * 10.0 ** -rng.integers(1, 5)) > best - 1e-3 for _ in range(300))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op10_quality_nbsvm(spark, sf).collect() if r.held_out and truth.get(r.doc_id) is not None]
    right = np.array([r.predicted == truth[r.doc_id] for r in got])
    ones, zeros = [r.score for r in got if truth[r.doc_id]], [r.score for r in got if not truth[r.doc_id]]
    auc = np.mean([a > b for a in ones for b in zeros])
    print("accuracy", right.mean(), "auc", auc)
    assert right.mean() > 0.9 and auc > 0.9


def brute_features(text, bits=nbsvm.BITS):
    """Features by whole-number arithmetic, one n-gram at a time."""
    full = (1 << 64) - 1

    def mix(v):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            v = (v ^ (v >> 33)) * factor & full
        return v ^ (v >> 33)

    words = (text or "").split()
    out = {mix(len(words).bit_length())}
    for of in (lambda w: xxhash.xxh64_intdigest(w.rstrip(nbsvm._PUNCTUATION).lower().encode(), 1), lambda w: xxhash.xxh64_intdigest(nbsvm.word_form(w).encode(), 2)):
        h = [of(w) for w in words]
        for i in range(len(h)):
            one = mix(h[i])
            out.add(one)
            if i + 1 < len(h):
                two = mix((one * 3 + h[i + 1]) & full)
                out.add(two)
                if i + 2 < len(h):
                    out.add(mix((two * 5 + h[i + 2]) & full))
    return sorted({v & ((1 << bits) - 1) for v in out})


def test_features_against_brute_force(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [None, "", "One", "a b", "The end, of IT. the end!", " ".join(f"w{int(k)}{'.' * int(k % 3)}" for k in rng.integers(0, 50, 300)), "x" * 500 + " y " + "x" * 500]
    for memo in (nbsvm._MEMO, 7):
        monkeypatch.setattr(nbsvm, "_MEMO", memo)
        make = nbsvm.Features()
        assert all(make.text(t).tolist() == brute_features(t) for t in texts * 2)
        assert len(make.memo) <= 2 * memo and all(len(w) <= 48 for w in make.memo)
    small = nbsvm.Features(6)  # long texts are marked instead of gathered
    assert all(small.text(t).tolist() == brute_features(t, 6) for t in texts)


def test_word_order_counts():
    make = nbsvm.Features()
    assert make.text("good dogs like cats").tolist() != make.text("cats like good dogs").tolist()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.quality in (0, 1) and r.doc_id in docs:
            quality[r.doc_id] = max(r.quality, quality.get(r.doc_id, 0))
    held = {d: crc32(str(d).encode()) % 3 == 1 for d in docs}
    train = sorted(d for d in quality if not held[d])
    model = nbsvm.fit([np.array(brute_features(docs[d])) for d in train], np.array([quality[d] for d in train]), 1 << nbsvm.BITS)
    got = {r.doc_id: r for r in queries.op10_quality_nbsvm(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        margin = model.weights[brute_features(text)].sum() + model.bias
        chance = 1 / (1 + np.exp(-(margin * model.slope + model.offset)))
        assert got[d].held_out == held[d] and abs(got[d].score - chance) < 1e-9 and got[d].predicted == (chance >= 0.5)


def test_the_features_sent_to_the_driver_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 5000, 300)) + (" great" if i % 2 else " awful") * 40) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    sent = []
    plain = nbsvm.fit
    monkeypatch.setattr(nbsvm, "fit", lambda held, *a: sent.append(sum(map(len, held))) or plain(held, *a))
    whole, small = nbsvm.learn(docs, labels), nbsvm.learn(docs, labels, most_features=60_000)
    assert sent[0] > 200_000 and 30_000 < sent[1] < 90_000
    for model in (whole, small):
        got = nbsvm.score(docs, model).collect()
        assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95
