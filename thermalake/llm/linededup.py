"""Line dedup over range-partitioned line hashes.

Every long line becomes one row (key hash, document, positions). The rows are
range-partitioned by hash, then document from largest to smallest, so that a
very common line spreads over as many partitions as it needs, and are sorted
inside the partitions. One stream over a partition sees the occurrences of a
key in order, keeps those of the first document and marks the rest. Only a key
that crosses a partition boundary needs more than its partition: at most two
edge records per partition, however large the input, meet on the driver.
The result is a compressed bitmap per document, not text.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import BLANKS, carried, cut, shuffle_partitions

_LINES = pa.schema(
    [("key", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("positions", pa.binary())]
)
_MARKED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("positions", pa.binary())])


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id, text_hash, positions) for each distinct long line of each row with an id.

    key is a 128-bit hash of the stripped line with A-Z lower-cased; positions
    are little-endian 32-bit line numbers.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, ids, hashes, places = [], [], [], []
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: dict[bytes, list[int]] = {}
                for place, line in enumerate(text.split("\n")):
                    line = line.strip(BLANKS)
                    if len(line) >= min_chars:
                        held.setdefault(xxhash.xxh3_128_digest(line.encode().lower()), []).append(place)
                keys += held
                ids += [doc_id] * len(held)
                hashes += [text_hash] * len(held)
                places += [np.array(p, "<i4").tobytes() for p in held.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip((keys, ids, hashes, places), _LINES, strict=True)], schema=_LINES
            )

    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return named.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        explode, "key binary, doc_id long, text_hash long, positions binary"
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a partition: number of documents, largest and smallest of them."""
    first = last = None
    for part, key, doc in _rows(batches):
        if last is None or last[1] != key:
            last = [part, key, 1, doc, doc]
            first = first or last
        else:
            last[2] += doc != last[4]
            last[4] = doc
    found = [] if first is None else [first] if first is last else [first, last]
    schema = pa.schema(
        [("part", pa.int32()), ("key", pa.binary()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]
    )
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], f.type) for i, f in enumerate(schema)], schema=schema)


def join_edges(edges: list[tuple]) -> dict[bytes, tuple[int, int]]:
    """Documents in all and the largest of them, for the keys at partition boundaries."""
    known: dict[bytes, tuple[int, int]] = {}
    for key, runs in itertools.groupby(sorted(edges, key=lambda e: (e[0], e[1])), key=lambda e: e[1]):
        total, high, low = 0, None, None
        for _, _, n, run_high, run_low in runs:
            total += n - (low is not None and low == run_high)
            high, low = run_high if high is None else high, run_low
        known[key] = (total, high)
    return known


def stream_repeats(rows: Iterator[tuple], known: dict, min_docs: int) -> Iterator[tuple]:
    """(doc_id, text_hash, positions) of each sorted row (key, doc_id, text_hash, positions) to drop, once for equal ones.

    Rows wait until their key has enough documents, so never more than those of
    `min_docs` documents do.
    """
    for key, run in itertools.groupby(rows, key=lambda r: r[0]):
        total, keeper = known.get(key, (0, None))
        seen, last, before, waiting = 0, None, None, []
        for _, doc, text_hash, positions in run:
            if before == (doc, text_hash):
                continue
            before = doc, text_hash
            if keeper is None:
                keeper = doc  # the first occurrence has the largest id
            seen += doc != last
            last = doc
            if doc != keeper:
                waiting.append((doc, text_hash, positions))
            if max(total, seen) >= min_docs:
                yield from waiting
                waiting = []


def repeated_line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep_bitmap) for each document that loses lines.

    Lines whose key (stripped, A-Z lower-cased) has at least `min_chars` code
    points and lies in at least `min_docs` documents go everywhere but in the
    largest doc_id that holds them. keep_bitmap is zlib-compressed, one bit per
    line, most significant bit first; lines past its end are kept. text_hash
    (xxhash64 of the text) tells rows of one doc_id with different texts apart;
    they count as one document. Rows without an id or a text are not compared
    and lose nothing. Extra columns are not read.
    """
    # a number per row lets equal rows lie in several ranges; the rows are made once, for the sample of the ranges and for the shuffle
    rows = cut(line_rows(docs, min_chars).withColumn("number", F.monotonically_increasing_id()))
    order = [F.col("key"), F.col("doc_id").desc(), F.col("text_hash"), F.col("number")]
    dealt = (
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .drop("number")
        .withColumn("part", F.spark_partition_id())
    )
    dealt = cut(dealt)
    edges = dealt.select("part", "key", "doc_id").mapInArrow(
        _edges, "part int, key binary, n long, high long, low long"
    )
    known = join_edges([(e.part, bytes(e.key), e.n, e.high, e.low) for e in edges.collect()])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = stream_repeats(_rows(batches), known, min_docs)
        while chunk := list(itertools.islice(found, 20_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*chunk, strict=True), _MARKED, strict=True)], schema=_MARKED
            )

    marked = dealt.select("key", "doc_id", "text_hash", "positions").mapInArrow(
        mark, "doc_id long, text_hash long, positions binary"
    )

    @F.pandas_udf("n_dropped long, keep_bitmap binary")
    def bitmap(lists: pd.Series) -> pd.DataFrame:
        out = []
        for places in lists:
            dropped = np.unique(np.frombuffer(b"".join(places), "<i4"))
            keep = np.ones(-(-(dropped[-1] + 1) // 8) * 8, bool)
            keep[dropped] = False
            out.append((len(dropped), zlib.compress(np.packbits(keep).tobytes())))
        return pd.DataFrame(out, columns=["n_dropped", "keep_bitmap"])

    packed = marked.groupBy("doc_id", "text_hash").agg(F.collect_list("positions").alias("places"))
    return packed.select("doc_id", "text_hash", bitmap("places").alias("b")).select("doc_id", "text_hash", "b.*")


def _kept(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    out = []
    for text, packed in zip(texts, bitmaps, strict=True):
        if text is None or packed is None:
            out.append(None)
            continue
        keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
        lines = text.split("\n")
        out.append("\n".join(itertools.chain(itertools.compress(lines, keep), lines[len(keep) :])))
    return pd.Series(out, dtype=object)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, counts: bool = True) -> DataFrame:
    """The input rows and columns with `text` cut to its kept lines, and n_chars, if there, to their length.

    With `counts` the columns n_lines and n_dropped come in addition, in place
    of columns of these names. Null text stays null and counts as one empty
    line. A text that loses all its lines becomes empty. Rows without an id
    lose nothing; repeated rows lose the same lines. An empty table gives an
    empty one. Extra columns of any name are carried along. Of the texts, only
    those that lose a line go through Python.
    """
    bitmaps = repeated_line_bitmaps(docs, min_chars, min_docs)
    # the text crosses the join once, inside the row
    rows = carried(docs, _id=F.col("doc_id").cast("long"), _hash=F.xxhash64("text"))
    met = rows.join(bitmaps, (F.col("_id") == F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    hit, text = F.col("keep_bitmap").isNotNull(), F.col("row.text")
    kept = F.pandas_udf(_kept, "string")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    made = {"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long")} if counts else {}
    met = met.select(
        "row", hit.alias("hit"), F.when(hit, kept(F.when(hit, text), F.col("keep_bitmap"))).otherwise(text).alias("cut"), *[c.alias(n) for n, c in made.items()]
    )
    new = {"text": F.col("cut"), "n_chars": F.when(F.col("hit"), F.length("cut").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    same = [new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return met.select(*same, *made)
