"""Repeated passages over a distributed suffix array.

A suffix starts at a seed: the position with the smallest hash of its leading
tokens (three of 8 bytes) among all those that a window of `LENGTH` bytes can
hold. Equal windows choose equal seeds, so two documents that share a window
share a seed, whatever stands around it. Three steps follow.

1. Leading tokens that only one document has are put aside by their hashes.
2. The suffixes of the others, with what stands before them, are
   range-partitioned by leading tokens, then document, between sampled
   splitters. Every bucket sorts its suffixes by multikey quicksort, and equal
   windows find the smallest document that holds them.
3. Leading tokens that cross a boundary of buckets compare their distinct
   windows across it.

Bytes are compared, not hashes, so what is removed is repeated for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import discard, shuffle_partitions, stored

LENGTH = 50  # bytes of a repeated passage at least
LEAD = 24  # bytes of the leading tokens
_BEFORE = LENGTH - LEAD
_CHUNK = 1 << 17  # window starts hashed at a time
_HELD = 1_500_000  # seeds that a task compares before it sends them
_GATHERED = 16_384  # suffixes cut out of texts at a time
_STEPS = np.arange(-_BEFORE, LENGTH)
_SEEDS_PER_BUCKET, _BLOCK_BYTES, _ROWS_PER_RANGE = 2_000_000, 8_000_000, 150_000
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_CHUNK + LENGTH, _BASE, np.uint64)])
_INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(_CHUNK + LENGTH, pow(_BASE, -1, 1 << 64), np.uint64)])

_SEEN = pa.schema([("key", pa.int32()), ("block", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("leads", pa.binary()), ("shared", pa.binary())])
_CANDIDATES = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("leads", pa.binary())])
_SUFFIXES = pa.schema([("suffix", pa.binary()), ("before", pa.binary()), ("doc_id", pa.int64()), ("places", pa.binary())])
_FOUND = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary()), ("part", pa.int32()), ("lead", pa.binary()), ("suffix", pa.list_(pa.binary())), ("before", pa.list_(pa.binary())), ("doc_id", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} " + (f"array<{names[f.type.value_type]}>" if pa.types.is_list(f.type) else names[f.type]) for f in schema)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each value begins, with the end of the last."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return raw.cast(pa.binary())


def _over(values: np.ndarray, width: int, smallest: bool) -> np.ndarray:
    """The smallest or largest of each run of `width` values."""
    pick, reach = (np.minimum if smallest else np.maximum), 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    return pick(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def seeds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of the leading tokens) of the seeds of all windows that lie in one text; ascending, once each."""
    places, hashes = [], []
    width, ends = LENGTH - LEAD + 1, offsets[1:]
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        part = data[at : at + _CHUNK + LENGTH - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * _POWERS[: len(part)], out=sums[1:])
        h = (sums[LEAD:] - sums[:-LEAD]) * _INVERSES[: len(part) - LEAD + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = _over(h, width, smallest=True)
        near = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(part) + LENGTH, "right")] - at
        across = (near[:, None] - np.arange(1, LENGTH)).ravel()
        low[across[(across >= 0) & (across < len(low))]] = 0  # windows across the end of a text choose nothing
        none = np.zeros(width - 1, np.uint64)
        best = _over(np.concatenate([none, low, none]), width, smallest=False)
        chosen = np.flatnonzero(h == best)
        places.append(chosen + at)
        hashes.append(h[chosen])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _short(values: np.ndarray) -> np.ndarray:
    """The low 40 bits of each value as 5 bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _long(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel().astype(np.uint64)


def _firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before it."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _packed(key: np.ndarray, doc: np.ndarray, lead: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(key, documents, number of leads of each, leads) for every key."""
    order = np.lexsort((lead, doc, key))
    key, doc, lead = key[order], doc[order], lead[order]
    cuts = np.r_[np.flatnonzero(_firsts(key)), len(key)]
    new = np.flatnonzero(_firsts(key, doc))
    counts = np.diff(np.r_[new, len(key)]).astype("<u4")
    short, docs = _short(lead), doc[new].astype("<i8")
    within = np.searchsorted(new, cuts)
    for a, b, i, j in zip(cuts[:-1], cuts[1:], within[:-1], within[1:], strict=True):
        yield int(key[a]), docs[i:j].tobytes(), counts[i:j].tobytes(), short[a:b].tobytes()


def _unpacked(docs: list[bytes], counts: list[bytes], leads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.frombuffer(b"".join(docs), "<i8"), np.frombuffer(b"".join(counts), "<u4"))
    return doc, _long(b"".join(leads))


def _seen(batches: Iterator[pa.RecordBatch], buckets: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Leading tokens by bucket of their hash; those that several documents of the task have go out once, with the documents beside them."""

    def sent(lead: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, lead))
        lead, doc = lead[order], doc[order]
        once = _firsts(lead, doc)
        lead, doc = lead[once], doc[once]
        group = np.cumsum(_firsts(lead)) - 1
        many = np.bincount(group)[group] > 1
        bucket = ((lead & np.uint64(0xFFFFFF)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        lead >>= np.uint64(24)
        rows = [(k, -1, d, c, v, b"") for k, d, c, v in _packed(bucket[~many], doc[~many], lead[~many])]
        shared = many & _firsts(lead, bucket)
        rows += [(k, -1, b"", b"", b"", v) for k, _, _, v in _packed(bucket[shared], doc[shared], lead[shared])]
        rows += [(k % buckets, k, d, c, v, b"") for k, d, c, v in _packed(doc[many] % blocks, doc[many], lead[many])]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _SEEN, strict=True)], schema=_SEEN)

    held, size = [], 0
    for batch in batches:
        data, offsets = _bytes(batch.column(1))
        places, lead = seeds(data, offsets)
        held.append((lead, batch.column(0).to_numpy()[np.searchsorted(offsets, places, "right") - 1]))
        size += len(lead)
        if size >= _HELD:
            yield sent(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield sent(*map(np.concatenate, zip(*held, strict=True)))


def _recurring(table: pa.Table, blocks: int) -> pa.Table:
    """(block, documents, leads) of the leading tokens of one bucket that several documents have."""
    known = np.array(table["block"]) >= 0
    column = lambda name, mask: table[name].filter(pa.array(mask)).to_pylist()
    doc, lead = _unpacked(*(column(c, ~known) for c in ("docs", "counts", "leads")))
    shared = _long(b"".join(column("shared", ~known)))
    every = np.concatenate([lead, shared])
    order = np.argsort(every, kind="stable")
    group = np.empty(len(every), np.int64)
    group[order] = np.cumsum(_firsts(every[order])) - 1
    n = int(group.max(initial=-1)) + 1
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group[: len(lead)], doc)
    np.maximum.at(high, group[: len(lead)], doc)
    many = low < high
    many[group[len(lead) :]] = True
    hit = many[group[: len(lead)]]
    rows = [*_packed(doc[hit] % blocks, doc[hit], lead[hit]), *zip(*(column(c, known) for c in _CANDIDATES.names), strict=True)]
    columns = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _CANDIDATES, strict=True)], schema=_CANDIDATES)


def _copies(table: pa.Table) -> set[tuple[int, bytes]]:
    held = table.filter(pc.is_valid(table["copy"]))
    return set(zip(held["copy"].to_pylist(), held["text_hash"].to_pylist(), strict=True))


def _suffixes(texts: pa.Table, candidates: pa.Table) -> pa.Table:
    """The suffixes of one block's texts whose leading tokens recur, with up to `_BEFORE` bytes before them, nearest first."""
    copies = _copies(candidates)
    rows = candidates.filter(pc.is_valid(candidates["docs"]))
    doc, lead = _unpacked(*(rows[c].to_pylist() for c in ("docs", "counts", "leads")))
    if copies:
        texts = texts.filter(pa.array([k not in copies for k in zip(texts["doc_id"].to_pylist(), texts["text_hash"].to_pylist(), strict=True)]))
    ids = texts["doc_id"].to_numpy()
    data, offsets = _bytes(texts["text"])
    names = np.unique(ids)
    known = np.isin(doc, names)
    wanted = np.unique((np.searchsorted(names, doc[known]).astype(np.uint64) << np.uint64(40)) | lead[known])
    places, h = seeds(data, offsets)
    text = np.searchsorted(offsets, places, "right") - 1
    own = (np.searchsorted(names, ids).astype(np.uint64)[text] << np.uint64(40)) | (h >> np.uint64(24))
    hit = np.isin(own, wanted)
    places, text = places[hit], text[hit]
    begin, end = offsets[text], offsets[text + 1]
    # what a document repeats in itself is one row: equal bytes around, at several places
    reach = np.minimum(places - begin, _BEFORE), np.minimum(end - places, LENGTH)
    around, mark = np.zeros((len(places), _BEFORE + LENGTH), np.uint8), np.zeros(len(places), np.uint64)
    for i in range(0, len(places), _GATHERED):
        part = slice(i, i + _GATHERED)
        at = places[part, None] + _STEPS
        at[(_STEPS < -reach[0][part, None]) | (_STEPS >= reach[1][part, None])] = -1
        around[part] = np.where(at >= 0, data[at], 0)
        mark[part] = around[part] @ _POWERS[1 : LENGTH + _BEFORE + 1]
    order = np.lexsort((places, reach[0], reach[1], mark, text))
    new = np.flatnonzero(_firsts(text[order], mark[order], reach[0][order], reach[1][order]))
    one = order[new]
    counts = np.diff(np.r_[new, len(order)])
    inner = (places - begin)[order].astype("<i8")
    suffix = around[one, _BEFORE:][np.arange(LENGTH) < reach[1][one, None]]
    before = around[one, :_BEFORE][:, ::-1][np.arange(_BEFORE) < reach[0][one, None]]
    return pa.Table.from_arrays(
        [_binary(suffix, reach[1][one]), _binary(before, reach[0][one]), pa.array(ids[text[one]]), _binary(inner.view(np.uint8), counts * 8)], schema=_SUFFIXES
    )


def _padded(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Values as rows of `width` bytes, zeros after their ends."""
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width), np.uint8)
    out[np.arange(width) < lengths[:, None]] = data
    return out


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes: by one token of 8 bytes after the other, each only among rows that tie so far."""
    tokens = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(tokens[:, 0], kind="stable")
    new = _firsts(tokens[order, 0])
    for t in range(1, tokens.shape[1]):
        tied = ~new | ~np.r_[new[1:], True]  # rows that equal a neighbour
        if not tied.any():
            break
        where = np.flatnonzero(tied)
        group = np.cumsum(new)[where]
        inner = np.lexsort((tokens[order[where], t], group))
        order[where] = order[where][inner]
        new[where] |= _firsts(group, tokens[order[where], t])
    return order


def _common(rows: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each row and the one before it; -1 for the first."""
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if len(rows) else np.empty(0, np.int64)
    return np.r_[np.full(min(len(rows), 1), -1), same]


class Bucket:
    """The suffixes of one range, sorted, and the smallest document of every window that lies around a seed."""

    def __init__(self, table: pa.Table):
        self.after, self.left = (_bytes(table[c]) for c in ("suffix", "before"))
        self.reach = np.diff(self.after[1]), np.diff(self.left[1])
        self.right, self.left = _padded(*self.after, 56), _padded(*self.left, 32)
        self.doc = table["doc_id"].to_numpy()
        n = len(self.doc)
        self.order = multikey_order(self.right)
        self.right_step = _common(self.right[self.order])
        self.left_order = multikey_order(self.left)
        self.left_step = _common(self.left[self.left_order])
        lead = np.empty(n, np.int64)
        lead[self.order] = np.cumsum(self.right_step < LEAD)
        self.lead = lead
        # equal rows share their windows: they are compared once, by their smallest document
        keys = self._class(LENGTH, _BEFORE) * np.int64(LENGTH + 1) * (_BEFORE + 1) + self.reach[0] * (_BEFORE + 1) + self.reach[1]
        _, self.kind = np.unique(keys, return_inverse=True)
        self.rows = np.full(int(self.kind.max(initial=-1)) + 1, -1)
        self.rows[self.kind] = np.arange(n)
        self.low = np.full(len(self.rows), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.kind, self.doc)

    def _class(self, after: int, before: int) -> np.ndarray:
        """A number for each row, equal for those that agree in `after` bytes from the seed and `before` bytes before it."""
        n = len(self.doc)
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[self.order] = np.cumsum(self.right_step < after)
        left[self.left_order] = np.cumsum(self.left_step < before)
        _, combined = np.unique(right * (n + 1) + left, return_inverse=True)
        return combined.astype(np.int64)

    def windows(self, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (one of each kind) with a window that begins `before` bytes before the seed, and the class of that window."""
        able = np.flatnonzero((self.reach[1][self.rows] >= before) & (self.reach[0][self.rows] >= LENGTH - before))
        n = len(self.doc)
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[self.order] = np.cumsum(self.right_step < LENGTH - before)
        left[self.left_order] = np.cumsum(self.left_step < before) if before else 0
        at = self.rows[able]
        return able, right[at] * (n + 1) + left[at]

    def bytes_of(self, kind: np.ndarray, before: int) -> np.ndarray:
        """The bytes of the windows that begin `before` bytes before the seed."""
        at = self.rows[kind]
        return np.concatenate([self.left[at, :before][:, ::-1], self.right[at, : LENGTH - before]], axis=1)

    def repeated(self, elsewhere: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, most, least): rows with windows that a smaller document holds, and the bytes before the seed at which the first and last begin.

        `elsewhere` has the smallest documents of windows in other buckets.
        """
        most, least = np.full(len(self.doc), -1), np.full(len(self.doc), LENGTH)
        for before in range(_BEFORE + 1):
            able, key = self.windows(before)
            smallest = np.full(len(self.rows), np.iinfo(np.int64).max)
            order = np.argsort(key, kind="stable")
            if len(order):
                cuts = np.flatnonzero(_firsts(key[order]))
                low = np.minimum.reduceat(self.low[able[order]], cuts)
                smallest[able[order]] = np.repeat(low, np.diff(np.r_[cuts, len(order)]))
            if elsewhere and len(able):
                there = [elsewhere.get(w.tobytes()) for w in self.bytes_of(able, before)]
                known = np.array([t is not None for t in there])
                smallest[able[known]] = np.minimum(smallest[able[known]], np.array([t for t in there if t is not None], np.int64))
            hit = smallest[self.kind] < self.doc
            most[hit] = before
            least[hit & (least == LENGTH)] = before
        found = np.flatnonzero(most >= 0)
        return found, most[found], least[found]


def _spans(table: pa.Table, bucket: Bucket, blocks: int, elsewhere: dict[bytes, int] | None = None) -> list[dict]:
    row, most, least = bucket.repeated(elsewhere)
    places = table["places"].take(pa.array(row)).to_pylist()
    n = np.array([len(p) // 8 for p in places], np.int64)
    at = np.frombuffer(b"".join(places), "<i8")
    doc = np.repeat(bucket.doc[row], n)
    start, end = at - np.repeat(most, n), at + LENGTH - np.repeat(least, n)
    order = np.lexsort((start, doc, doc % blocks))
    doc, start, end = doc[order], start[order], end[order]
    cuts = np.r_[np.flatnonzero(_firsts(doc % blocks)), len(doc)]
    return [
        {"block": int(doc[a] % blocks), "docs": doc[a:b].tobytes(), "starts": start[a:b].tobytes(), "ends": end[a:b].tobytes()} for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def _found(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_FOUND)


def _compared(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Spans that one range's own suffixes show, and the suffixes of its first and last leading tokens for those across its boundaries."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        bucket = Bucket(table)
        rows = _spans(table, bucket, blocks)
        for group in {int(bucket.lead[bucket.order[0]]), int(bucket.lead[bucket.order[-1]])}:
            own = bucket.kind[np.flatnonzero(bucket.lead == group)]
            members = table.take(pa.array(np.flatnonzero(bucket.lead == group)))
            row = {"part": TaskContext.get().partitionId(), "lead": bucket.right[bucket.rows[own[0]], :LEAD].tobytes()}
            rows.append(row | {c: members[c].to_pylist() for c in ("suffix", "before", "doc_id", "places")})
        yield from _found(rows).to_batches()


def _pending(table: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([table[c].combine_chunks().flatten() for c in _SUFFIXES.names], schema=_SUFFIXES)


_WINDOWS = pa.schema([("part", pa.int32()), ("lead", pa.binary()), ("slot", pa.int32()), ("windows", pa.binary()), ("lows", pa.binary())])


def _windows_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([],) * len(_WINDOWS)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _WINDOWS, strict=True)], schema=_WINDOWS)


def _distinct_windows(table: pa.Table) -> pa.Table:
    """The distinct windows around one boundary's seeds and their smallest documents, packed by a hash of the window.

    The number of slots follows that of the buckets which the leading tokens
    span, so a slot that gathers what all of them have stays as small as one.
    """
    bucket, windows, lows = Bucket(_pending(table)), [], []
    for before in range(_BEFORE + 1):
        able, key = bucket.windows(before)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(_firsts(key[order]))
        if len(cuts):
            windows.append(bucket.bytes_of(able[order[cuts]], before))
            lows.append(np.minimum.reduceat(bucket.low[able[order]], cuts))
    if not windows:
        return _windows_table([])
    windows, lows = np.concatenate(windows), np.concatenate(lows)
    h = windows @ _POWERS[1 : LENGTH + 1]
    slot = ((h ^ h >> np.uint64(32)) % np.uint64(4 * table["parts"][0].as_py())).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    cuts = np.r_[np.flatnonzero(_firsts(slot[order])), len(slot)]
    part, lead = table["part"][0].as_py(), table["lead"][0].as_py()
    return _windows_table([(part, lead, int(slot[order[a]]), windows[order[a:b]].tobytes(), lows[order[a:b]].astype("<i8").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _lower_elsewhere(table: pa.Table) -> pa.Table:
    """For each bucket the windows of one slot that a smaller document of another bucket holds, and that document."""
    held, lows = table["windows"].to_pylist(), table["lows"].to_pylist()
    sizes = np.array([len(w) // LENGTH for w in held])
    windows = np.frombuffer(b"".join(held), f"V{LENGTH}")
    low = np.frombuffer(b"".join(lows), "<i8")
    _, group = np.unique(windows, return_inverse=True)
    lowest = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, low)
    better, ends = lowest[group] < low, np.cumsum(sizes)
    rows = []
    for part, a, b in zip(table["part"].to_pylist(), ends - sizes, ends, strict=True):
        hit = np.flatnonzero(better[a:b]) + a
        if len(hit):
            rows.append((part, table["lead"][0].as_py(), 0, windows[hit].tobytes(), lowest[group[hit]].astype("<i8").tobytes()))
    return _windows_table(rows)


def _across(table: pa.Table, known: pa.Table, blocks: int) -> pa.Table:
    """Spans of one boundary's suffixes, given the smallest documents of their windows in the other buckets."""
    if not table.num_rows or not known.num_rows:
        return _found([])
    members = _pending(table)
    windows, lows = (b"".join(known[c].to_pylist()) for c in ("windows", "lows"))
    elsewhere = dict(zip((windows[i : i + LENGTH] for i in range(0, len(windows), LENGTH)), np.frombuffer(lows, "<i8").tolist(), strict=True))
    return _found(_spans(members, Bucket(members), blocks, elsewhere))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs that overlap or touch as one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[new], end[np.r_[new[1:] - 1, len(end) - 1]]


def _kept(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """Each text of a block without its repeated runs."""
    copies = _copies(spans)
    rows = spans.filter(pc.is_valid(spans["docs"]))
    doc, start, end = (np.frombuffer(b"".join(rows[c].to_pylist()), "<i8") for c in ("docs", "starts", "ends"))
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    out = []
    for doc_id, text_hash, text in zip(*(texts[c].to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
        text = (text or "").encode()
        if (doc_id, text_hash) in copies and len(text) >= LENGTH:
            out.append((doc_id, len(text), [(0, len(text))], b""))
            continue
        a, b = np.searchsorted(doc, [doc_id, doc_id], side="left")[0], np.searchsorted(doc, doc_id, side="right")
        runs = list(zip(*(x.tolist() for x in _merged(start[a:b], end[a:b])), strict=True))
        edges = [0, *[x for run in runs for x in run], len(text)]
        out.append((doc_id, len(text), runs, b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    columns[2] = [[{"start": a, "end": b} for a, b in runs] for runs in columns[2]]
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _KEPT, strict=True)], schema=_KEPT)


def _prime(least: int) -> int:
    n = max(2, least)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text without the bytes that 50-byte strings of smaller doc_ids cover.

    Texts count as UTF-8 bytes, null ones as empty; matches never cross texts,
    are judged on the input, and those within a document count for nothing.
    spans are the maximal removed runs (start, end exclusive), kept the other
    bytes, which need not be valid UTF-8. Rows that repeat a doc_id are one
    document to each other: they never remove from one another. Rows without a
    doc_id are not compared and lose nothing. An empty table gives an empty one;
    extra columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.filter("doc_id IS NOT NULL").withColumn("text_hash", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    long_enough = F.octet_length("text") >= LENGTH
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, blocks = max(shuffle_partitions(spark), -(-total // (13 * _SEEDS_PER_BUCKET))), _prime(-(-total // _BLOCK_BYTES))
    in_block = F.pmod("doc_id", F.lit(blocks)).cast("int").alias("block")

    # whole copies of a text with a smaller id need no comparison
    hashes = named.filter(long_enough).select("doc_id", "text_hash")
    firsts = hashes.groupBy(F.col("text_hash").alias("_hash")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = hashes.join(firsts, F.col("text_hash") == F.col("_hash")).filter("doc_id > first").select(in_block, F.col("doc_id").alias("copy"), "text_hash")
    copies, copies_path = stored(copies.distinct())

    seen = named.filter(long_enough).select("doc_id", "text").mapInArrow(lambda batches: _seen(batches, buckets, blocks), _ddl(_SEEN))
    candidates, candidates_path = stored(seen.groupBy("key").applyInArrow(lambda t: _recurring(t, blocks), _ddl(_CANDIDATES)))
    seeds_left = candidates.agg(F.sum(F.octet_length("leads"))).first()[0] or 0
    told = candidates.unionByName(copies, allowMissingColumns=True)
    texts = named.filter(long_enough).withColumn("block", in_block)
    suffixes = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_suffixes, _ddl(_SUFFIXES))
    ranges = max(shuffle_partitions(spark), -(-seeds_left // (5 * _ROWS_PER_RANGE)))
    dealt = suffixes.repartitionByRange(ranges, "suffix", "before", "doc_id")
    found, _ = stored(dealt.mapInArrow(lambda batches: _compared(batches, blocks), _ddl(_FOUND)))
    discard(spark, candidates_path)

    own = found.filter("part IS NULL").select("block", "docs", "starts", "ends")
    edges = found.filter("part IS NOT NULL").select("part", "lead", *_SUFFIXES.names)
    split = edges.groupBy(F.col("lead").alias("_lead")).agg(F.count("*").alias("parts")).filter("parts > 1")
    edges = edges.join(split, F.col("lead") == F.col("_lead")).drop("_lead")
    windows = edges.groupBy("part", "lead").applyInArrow(_distinct_windows, _ddl(_WINDOWS))
    known, windows_path = stored(windows.groupBy("lead", "slot").applyInArrow(_lower_elsewhere, _ddl(_WINDOWS)))
    across, _ = stored(
        edges.groupBy("part", "lead").cogroup(known.groupBy("part", "lead")).applyInArrow(lambda t, k: _across(t, k, blocks), _ddl(_FOUND)).select("block", "docs", "starts", "ends")
    )
    discard(spark, windows_path)

    told = own.unionByName(across).unionByName(copies, allowMissingColumns=True)
    kept = named.withColumn("block", in_block).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _kept, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
    text = F.coalesce("text", F.lit(""))
    alone = rows.filter("doc_id IS NULL").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), text.cast("binary").alias("kept")
    )
    return kept.unionByName(alone.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))))


def digest(kept: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what `drop_repeated_passages` returns."""
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
