import hashlib

from pyspark.sql import functions as F

from thermalake.llm import linededup

BLANKS = " \t\n\v\f\r"


def brute(rows):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and doc is not None:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if doc is None or len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


CLASHES = ("key", "n_dropped", "row", "_id", "_hash", "_n", "_keep", "_text_hash", "text_hash", "keep_bitmap", "hit", "cut", "number", "part", "positions")


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"7 AS {c}" for c in CLASHES])
    got = linededup.drop_repeated_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_lines"}
    assert all(set(r) == {7} for r in got.select(*[c for c in CLASHES if c != "n_dropped"]).distinct().collect())
    plain = linededup.drop_repeated_lines(docs, counts=False)
    assert plain.columns == docs.columns and plain.count() == len(rows)
    return sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()), key=str)


def test_against_brute_force(spark):
    hot, other, short = "Ä common Line that is Longer than forty characters", "x" * 40, "y" * 39
    rows = [(i, f"{hot}\nown {i}\n \t{hot.swapcase() if i % 2 else hot.upper()}\r\n{short}") for i in range(300)]
    rows = [(d, t.replace("ä", "Ä")) for d, t in rows]
    rows += [(1000 + i, f"{other}\n{other}\n") for i in range(4)] + [(5000, None), (5001, ""), (None, hot), (None, None)]
    rows += [(7, rows[7][1])] * 900 + [(8, "another text\n" + hot)] + [(9000, hot + "\nz" * 20000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keys_across_partition_edges():
    rows = [("k", d, 0, b"") for d in range(9, -1, -1)]
    edges, parts = [], [rows[:4], rows[4:5], rows[5:]]
    for part, own in enumerate(parts):
        docs = [r[1] for r in own]
        edges.append((part, "k", len(docs), docs[0], docs[-1]))
    known = linededup.join_edges(edges)
    assert known == {"k": (10, 9)}
    dropped = [r[0] for own in parts for r in linededup.stream_repeats(iter(own), known, 5)]
    assert dropped == list(range(8, -1, -1))
    assert linededup.join_edges([(0, "k", 2, 9, 8), (1, "k", 2, 8, 7)]) == {"k": (3, 9)}
