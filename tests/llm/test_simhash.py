import itertools
import re

import numpy as np
import xxhash

from thermalake.llm import simhash
from thermalake.llm.components import connected_components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprint():
    for text in (None, "", "a", "A b", "É x y z É x y z", "w " * 50000 + "v"):
        assert simhash.text_fingerprint(text) == brute_fp(text)


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2 and part[i] != part[j]:
            part = [part[i] if p == part[j] else p for p in part]
    low = {p: min([d for (d, _), q in zip(rows, part, strict=True) if q == p and d is not None], default=None) for p in set(part)}
    return [(d, f"{f:016x}", low[p]) for (d, _), f, p in zip(rows, fps, part, strict=True)]


def test_against_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(base)) for i in range(50, 60)]
    for i in range(100, 260):
        words = list(base)
        for k in rng.integers(0, 60, rng.integers(1, 4)):
            words[k] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(1, None), (2, ""), (3, " \n"), (None, " ".join(base)), (None, "alone in the world"), (55, " ".join(base)), (9, "long " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component_id")
    got = [tuple(r) for r in simhash.digest(simhash.near_duplicates(docs)).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_pairs_find_all():
    rng = np.random.default_rng(3)
    fps = (np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64)).sum(1).astype(np.uint64)
    group = rng.integers(0, 3, 400)
    got = {tuple(sorted(p)) for i, j in simhash.near_pairs(group, fps, simhash.references()) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i, j in itertools.combinations(range(400), 2) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1000, 2000 + i) for i in range(200)] + [tuple(map(int, rng.integers(3000, 3100, 2))) for _ in range(60)]
    part = {x: x for p in pairs for x in p}
    for _ in range(len(part)):
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: p for x, p in part.items() if x in got} and {x for x, p in part.items() if any(x in q and q[0] != q[1] for q in pairs)} == set(got)


def test_pivot_cells_bring_near_fingerprints_together():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    pivots = simhash.references(12)
    cells = [{} for _ in range(2)]
    for held, side in zip(cells, (fps, near), strict=True):
        for at, cell in zip(*map(np.ndarray.tolist, simhash.pivot_cells(side, pivots)), strict=True):
            held.setdefault(at, set()).add(cell)
    assert all(cells[0][i] & cells[1][i] for i in range(300))
    assert sum(len(c) for c in cells[0].values()) < 300 * 20


def test_links_do_not_depend_on_how_cells_are_split(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) for _ in range(4)]]))
    table = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long")
    want = None
    for cell, full in ((1 << 30, 1 << 30), (8, 1 << 30), (8, 4), (1 << 30, 4)):
        got = sorted(map(tuple, connected_components(simhash.near_links(table, cell=cell, full=full)).collect()))
        want = want or got
        assert got == want and len(got) == len({n for n, _ in got})


def test_clashing_columns(spark):
    names = ("row", "_id", "_hash", "_text_hash", "text_hash", "fp", "component_id", "cell", "node", "choice", "bits", "members")
    rows = [(1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, "other words are here"), (3, "other words are here"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"7 AS {n}" for n in names])
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect() if r.doc_id is not None) == [(1, "a b c d", *[7] * 12), (3, "other words are here", *[7] * 12), (4, None, *[7] * 12)]
    assert kept.count() == 4 and simhash.one_of_each_group(docs.limit(0)).count() == 0
