import hashlib
import random

import pytest

from thermalake.llm import suffixes


def brute(rows):
    """The contract, by dictionaries of all 50-byte strings."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - 49):
            w = data[s : s + 50]
            if doc is not None:
                first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 49):
            if doc is not None and first[data[s : s + 50]] < doc:
                gone[s : s + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß漢\n ") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [make(n) for n in (8, 9, 10, 12, 30, 300)] + ["x" * 49, "y" * 50, "z" * 51, "ab" * 70, "\0" * 60]
    rows = []
    for i in range(160):
        parts = [make(rng.randint(0, 40)) for _ in range(3)]
        for p in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, len(p) // 2)
            parts.insert(rng.randint(0, 3), p[cut:] if rng.random() < 0.5 else p)
        rows.append((i * 3 - 60, "".join(parts)))
    base = make(200)
    for i in range(40):  # a group of near copies, and one of exact copies
        at = rng.randint(0, len(base))
        rows.append((1000 + i, base[:at] + "#" + base[at + 1 :]))
        rows.append((2000 + i, base))
    rows += [(5000, None), (5001, ""), (5002, "short"), (5003, "q" * 3000), (5004, "q" * 3000 + "r"), (5005, make(20000))]
    rows += [(5006, rows[-1][1][100:]), (None, base), (7, base), (7, base[:500]), (1000, rows[0][1]), rows[3]]
    rng.shuffle(rows)
    return rows


def digested(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, copy int").repartition(5)
    out = suffixes.digest(suffixes.drop_repeated_passages(table))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    assert digested(spark, rows) == brute(rows)


def test_many_ranges_and_blocks(spark, monkeypatch):
    """Leading tokens that cross ranges, small blocks and chunks give the same."""
    monkeypatch.setattr(suffixes, "_ROWS_PER_RANGE", 60)
    monkeypatch.setattr(suffixes, "_BLOCK_BYTES", 9000)
    monkeypatch.setattr(suffixes, "_SEEDS_PER_BUCKET", 900)
    rows = corpus(6)[::2]
    assert digested(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert suffixes.drop_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [0, 49, 50, 51, 400])
def test_every_window_has_a_seed(size, monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffixes, "_CHUNK", 64)
    data = np.random.default_rng(size).integers(0, 3, 2 * size).astype(np.uint8)
    places, _ = suffixes.seeds(data, np.array([0, size, 2 * size]))
    assert list(places) == sorted(set(places.tolist()))
    for s in [*range(size - 49), *range(size, 2 * size - 49)]:
        assert any(s <= p <= s + 26 for p in places)
