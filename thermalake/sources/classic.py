"""The classic binary grid format (CDF-1, CDF-2 and CDF-5): headers, rows of variables, and files.

A file is a header, then each fixed variable's values, then the records, in
which the variables of the unlimited dimension take turns; all is big-endian.
Only the header and the rows that are asked for are read.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: types by number, and the marks of the header's lists.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: What stands for a missing value where no attribute names one.
FILL = {"i1": -127, ">i2": -32767, ">i4": -2147483647, ">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, "u1": 255, ">u2": 65535, ">u4": 4294967295, ">i8": -9223372036854775806, ">u8": 18446744073709551614}
_HEAD = 1 << 16


@dataclass(frozen=True)
class Variable:
    """One variable: its shape (without the record dimension's length if `record`), type, place and attributes."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    record: bool
    attributes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Header:
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    record_bytes: int
    order: tuple[str, ...]  # of the dimensions in the file


class _Short(Exception):
    """The header goes on behind what was read."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, wide: bool = False) -> int:
        return int.from_bytes(self.take(8 if wide else 4), "big")


def _padded(n: int) -> int:
    return -(-n // 4) * 4


def parse(data: bytes) -> Header:
    """The header of a file that begins with `data`; raises `ValueError` for another format."""
    r = _Reader(data)
    magic = r.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a file of the classic grid format")
    long_counts, long_places = magic[3] == 5, magic[3] in (2, 5)
    count = lambda: r.number(long_counts)

    def name() -> str:
        n = count()
        return r.take(_padded(n))[:n].decode()

    def items(mark: int) -> range:
        found, n = r.number(), count()
        if found not in (0, mark) or (found == 0 and n):
            raise ValueError("a list of the header is damaged")
        return range(n)

    def attributes() -> dict:
        out = {}
        for _ in items(ATTRIBUTES):
            key, kind, n = name(), TYPES[r.number()], count()
            size = n * np.dtype(kind).itemsize
            raw = r.take(_padded(size))[:size]
            values = raw.decode(errors="replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind)
            out[key] = values if isinstance(values, str) else values[0].item() if n == 1 else values.tolist()
        return out

    records = count()
    lengths = [(name(), count()) for _ in items(DIMENSIONS)]
    shared = attributes()
    variables, record_sizes = {}, []
    for _ in items(VARIABLES):
        key = name()
        ids = [count() for _ in range(count())]
        own, kind = attributes(), TYPES[r.number()]
        count()  # the size that the file states; it follows from shape and type
        begin = r.number(long_places)
        record = bool(ids) and lengths[ids[0]][1] == 0
        shape = tuple(lengths[i][1] for i in ids)
        variables[key] = Variable(key, tuple(lengths[i][0] for i in ids), shape[1:] if record else shape, kind, begin, record, own)
        if record:
            record_sizes.append(math.prod(shape[1:]) * np.dtype(kind).itemsize)
    # a single record variable is not padded
    step = record_sizes[0] if len(record_sizes) == 1 else sum(map(_padded, record_sizes))
    dims = {n: length or records for n, length in lengths}
    return Header(dims, shared, variables, step, tuple(n for n, _ in lengths))


def read_header(file) -> Header:
    """The header of an open file, however long it is."""
    size = _HEAD
    while True:
        file.seek(0)
        data = file.read(size)
        try:
            return parse(data)
        except _Short:
            if len(data) < size:
                raise ValueError("the file ends within its header") from None
            size *= 4


def length(header: Header, name: str) -> tuple[int, ...]:
    """The full shape of a variable."""
    return tuple(header.dims[d] for d in header.variables[name].dims)


def read_rows(file, header: Header, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Rows start to stop of a variable's first dimension, as they are stored; all of a scalar."""
    v = header.variables[name]
    item = np.dtype(v.kind).itemsize
    if not v.dims:
        file.seek(v.begin)
        return np.frombuffer(file.read(item), v.kind)[0]
    rows = length(header, name)[0]
    stop = rows if stop is None else min(stop, rows)
    start = min(start, stop)
    if v.record:
        width = math.prod(v.shape) * item
        parts = []
        for i in range(start, stop):
            file.seek(v.begin + i * header.record_bytes)
            parts.append(file.read(width))
        raw, shape = b"".join(parts), v.shape
    else:
        width, shape = math.prod(v.shape[1:]) * item, v.shape[1:]
        file.seek(v.begin + start * width)
        raw = file.read((stop - start) * width)
    if len(raw) != (stop - start) * width:
        raise ValueError(f"{name} ends before row {stop}")
    return np.frombuffer(raw, v.kind).reshape(stop - start, *shape)


def decoded(values: np.ndarray, attributes: dict, kind: str) -> np.ndarray:
    """Stored values as doubles: missing and out of range ones NaN, then scaled and shifted as the attributes say."""
    out = np.asarray(values).astype(np.float64)
    gone = np.isnan(out)
    if kind != "S1":
        for fill in np.atleast_1d([attributes.get("_FillValue", FILL[kind]), *np.atleast_1d(attributes.get("missing_value", []))]):
            gone |= out == float(np.asarray(fill).astype(kind))
    low, high = attributes.get("valid_range", (attributes.get("valid_min"), attributes.get("valid_max")))
    if low is not None:
        gone |= out < low
    if high is not None:
        gone |= out > high
    out = out * attributes.get("scale_factor", 1.0) + attributes.get("add_offset", 0.0)
    return np.where(gone, np.nan, out)


def encode(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None, records: str | None = None, version: int = 2) -> bytes:
    """A file of fixed variables, and of record variables if `records` names the unlimited dimension."""
    numbers = {np.dtype(kind).str.replace("|", ""): n for n, kind in TYPES.items()}
    wide = version == 5
    out = io.BytesIO()
    put = lambda n, long=wide: out.write(int(n).to_bytes(8 if long else 4, "big"))

    def text(value: str) -> None:
        data = value.encode()
        put(len(data))
        out.write(data.ljust(_padded(len(data)), b"\0"))

    def block(mark: int, n: int) -> None:
        put(mark if n else 0, False)
        put(n)

    def attribute_list(held: dict) -> None:
        block(ATTRIBUTES, len(held))
        for key, value in held.items():
            text(key)
            array = np.frombuffer(value.encode(), "S1") if isinstance(value, str) else np.atleast_1d(np.asarray(value))
            if array.dtype.kind in "iu" and array.dtype.itemsize == 8 and not wide:
                array = array.astype(">i4")
            array = array.astype(array.dtype.newbyteorder(">"))
            put(numbers[array.dtype.str.replace("|", "")], False)
            put(array.size)
            data = array.tobytes()
            out.write(data.ljust(_padded(len(data)), b"\0"))

    names = list(dims)
    out.write(b"CDF" + bytes([version]))
    put(dims[records] if records else 0)
    block(DIMENSIONS, len(names))
    for n in names:
        text(n)
        put(0 if n == records else dims[n])
    attribute_list(attributes or {})
    block(VARIABLES, len(variables))
    arrays, places = {}, {}
    for key, (own, values, held) in variables.items():
        array = np.asarray(values)
        arrays[key] = array = array.astype(array.dtype.newbyteorder(">"))
        if array.shape != tuple(dims[d] for d in own):
            raise ValueError(f"{key} has another shape than its dimensions")
        text(key)
        put(len(own))
        for d in own:
            put(names.index(d))
        attribute_list(held)
        put(numbers[array.dtype.str.replace("|", "")], False)
        put(_padded(array[0].nbytes if own and own[0] == records and len(array) else array.nbytes))
        places[key] = out.tell()
        put(0, version > 1)
    at = out.tell()
    fixed = [k for k in variables if not (variables[k][0] and variables[k][0][0] == records)]
    moving = [k for k in variables if k not in fixed]
    body = []
    for key in fixed:
        data = arrays[key].tobytes()
        body.append((key, at, data.ljust(_padded(len(data)), b"\0")))
        at += _padded(len(data))
    pad = (lambda b: b) if len(moving) == 1 else lambda b: b.ljust(_padded(len(b)), b"\0")
    for i in range(dims[records] if records else 0):
        for key in moving:
            data = pad(arrays[key][i : i + 1].tobytes())  # a slice keeps the order of bytes
            body.append((key if i == 0 else None, at, data))
            at += len(data)
    for key, begin, data in body:
        out.write(data)
        if key is not None:
            end = out.tell()
            out.seek(places[key])
            put(begin, version > 1)
            out.seek(end)
    return out.getvalue()
