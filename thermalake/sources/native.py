"""Native image files as a Spark data source: one task per file and slab of rows.

    enable(spark)
    spark.read.format("grids").schema("day int, y int, x int, Rad double").option("rows", 512).load("/data/*.nc")

Columns are found by name. `day`, `sat`, `channel` and `path` come from the
file's name, `y` and `x` are places in the whole image, and any other column is
a variable: a double for one over (y, x), an array for one with more dimensions,
and the same value in every row for a scalar or a small table. Only variables of
the schema are read. Filters on day, satellite and channel leave files unopened,
those on y leave slabs unread.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from thermalake.sources import classic
from thermalake.sources.tables import PIXELS, SATELLITES, conform

#: The places of the spectral channels among the nine of a gridded file (8 to 16).
SPECTRAL = (0, 3, 4, 6, 7, 8)
#: How the parts of a file's name are found, as in `tables.catalogue`.
NAME = {"sat": (r"(G1[0-9])", str), "channel": (r"(?i)c(?:h)?([0-9]{2})", int), "day": (r"(?:_s[0-9]{4}|_day)([0-9]{1,3})", int)}
_PLACES = ("y", "x")
_DIMS = {"y": ("y", "row", "rows", "lat"), "x": ("x", "column", "columns", "lon")}
_COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def opened(path: str):
    """A file for reading at places, in any store that has a URI."""
    if "://" in path or path.startswith("file:"):
        store, inner = pafs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


def files(path: str) -> list[str]:
    """The files that a folder holds, or that a pattern in the last part of a path fits; in order of name."""
    uri = "://" in path or path.startswith("file:")
    folder, last = posixpath.split(path.rstrip("/"))
    pattern = last if any(c in last for c in "*?[") else None
    base = folder if pattern else path
    store, inner = pafs.FileSystem.from_uri(base) if uri else (pafs.LocalFileSystem(), base)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [base]
    found = [f.base_name for f in store.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return [f"{base.rstrip('/')}/{n}" for n in sorted(found) if pattern is None or fnmatch(n, pattern)]


def named_parts(path: str) -> dict:
    """day, sat and channel as the file's name states them, null where it doesn't."""
    name, out = posixpath.basename(path), {"path": path}
    for part, (pattern, kind) in NAME.items():
        m = re.search(pattern, name)
        out[part] = kind(m[1]) if m else None
    return out


class Slab(InputPartition):
    """Rows of one file."""

    def __init__(self, path: str, start: int, stop: int, first: int):
        self.path, self.start, self.stop, self.first = path, start, stop, first


class GridReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.path, self.rows, self.stride = options["path"], int(options.get("rows", 512)), int(options.get("stride", 1))
        self.variables = [f.name for f in schema if f.name not in (*NAME, "path", *_PLACES)]
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Comparisons of a file's parts and of places are taken over whole; all others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _COMPARED and column in (*NAME, "path", *_PLACES):
                self.filters.append((column, type(f).__name__, f.value))
            else:
                yield f

    def _fits(self, column: str, values) -> np.ndarray:
        """Which values of a column all its filters let through; null fits none."""
        by_name = {k.__name__: v for k, v in _COMPARED.items()}
        values = list(values)
        fits = np.ones(len(values), bool)
        for name, kind, bound in self.filters:
            if name == column:
                fits &= [v is not None and bool(by_name[kind](v, bound)) for v in values]
        return fits

    def partitions(self) -> Sequence[InputPartition]:
        """Slabs of whole strides, of the files and rows that the filters leave; headers alone are read here."""
        out = []
        for path in files(self.path):
            parts = named_parts(path)
            if not all(self._fits(c, [v])[0] for c, v in parts.items()):
                continue
            with opened(path) as file:
                header = classic.read_header(file)
            height, _ = image_shape(header, self.variables)
            first, step = int(header.attributes.get("first_row", 0)), max(self.stride, self.rows // self.stride * self.stride)
            for start in range(0, height, step):
                stop = min(start + step, height)
                if self._fits("y", range(first + start, first + stop)).any():
                    out.append(Slab(path, start, stop, first))
        return out

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        if slab is None:
            return
        parts = named_parts(slab.path)
        with opened(slab.path) as file:
            header = classic.read_header(file)
            _, width = image_shape(header, self.variables)
            y = np.arange(slab.start, slab.stop)
            wanted = self._fits("y", (y + slab.first).tolist()) & ((y + slab.first) % self.stride == 0)
            x = np.flatnonzero(self._fits("x", range(width)) & (np.arange(width) % self.stride == 0))
            if not wanted.any() or not len(x):
                return
            low, high = int(y[wanted][0]), int(y[wanted][-1]) + 1
            rows = y[wanted] - low
            n = len(rows) * len(x)
            columns = {**{k: pa.array([v] * n) for k, v in parts.items()}, "y": pa.array(np.repeat(rows + low + slab.first, len(x))), "x": pa.array(np.tile(x, len(rows)))}
            for name in self.variables:
                v = header.variables[name]
                over = len(v.dims) >= 2 and _is(v.dims[0], "y") and _is(v.dims[1], "x")
                values = classic.decoded(classic.read_rows(file, header, name, *((low, high) if over else ())), v.attributes, v.kind)
                if over:
                    values = values[rows][:, x]
                    columns[name] = _nested(values.reshape(n, *values.shape[2:]))
                else:
                    one = _nested(np.atleast_1d(values)[None] if values.ndim else values.reshape(1))
                    columns[name] = one.take(pa.array(np.zeros(n, np.int64)))
        arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in self.schema])
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.StringType: pa.string(), T.FloatType: pa.float32(), T.DoubleType: pa.float64()}[type(kind)]


def _nested(values: np.ndarray) -> pa.Array:
    """Rows of an array as doubles or nested lists of them, NaN as null."""
    flat = values.ravel()
    out = pa.array(flat, mask=np.isnan(flat))
    for size in values.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, size), pa.int32()), out) if size else pa.array([[]] * len(values), pa.list_(out.type))
    return out


def _is(dim: str, axis: str) -> bool:
    return dim.lower() in _DIMS[axis]


def image_shape(header: classic.Header, variables: Sequence[str] = ()) -> tuple[int, int]:
    """Rows and columns of a file's images; raises if a variable is missing or images differ in shape."""
    missing = [v for v in variables if v not in header.variables]
    if missing:
        raise ValueError(f"missing variables: {', '.join(missing)}")
    found = {classic.length(header, n)[:2] for n in (variables or header.variables) if len(d := header.variables[n].dims) >= 2 and _is(d[0], "y") and _is(d[1], "x")}
    if len(found) != 1:
        raise ValueError("no image" if not found else "images of different shapes")
    return found.pop()


class Grids(DataSource):
    """Format "grids"; options: rows (of a slab), stride (every n-th row and column)."""

    @classmethod
    def name(cls) -> str:
        return "grids"

    def schema(self) -> T.StructType:
        """The file's parts, the places, and all variables over (y, x) of the first file."""
        with opened(files(self.options["path"])[0]) as file:
            header = classic.read_header(file)
        fields = [T.StructField("path", T.StringType()), T.StructField("day", T.IntegerType()), T.StructField("sat", T.StringType()), T.StructField("channel", T.IntegerType())]
        fields += [T.StructField(c, T.IntegerType(), False) for c in _PLACES]
        for v in header.variables.values():
            if len(v.dims) >= 2 and _is(v.dims[0], "y") and _is(v.dims[1], "x"):
                kind: T.DataType = T.DoubleType()
                for _ in v.dims[2:]:
                    kind = T.ArrayType(kind)
                fields.append(T.StructField(v.name, kind))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> GridReader:
        return GridReader(schema, self.options)


def enable(spark: SparkSession) -> None:
    """Registers the format and lets Spark hand filters to it."""
    spark.dataSource.register(Grids)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_grids(spark: SparkSession, path: str, schema: str | None = None, rows: int = 512, stride: int = 1) -> DataFrame:
    enable(spark)
    reader = spark.read.format("grids").option("rows", rows).option("stride", stride)
    return (reader.schema(schema) if schema else reader).load(path)


def read_channels(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """(day, sat, channel, y, x, rad, planck) of raw files of one channel each; planck holds fk1, fk2, bc1 and bc2."""
    names = ("fk1", "fk2", "bc1", "bc2")
    df = read_grids(spark, path, "day int, sat string, channel int, y int, x int, Rad double, " + ", ".join(f"planck_{n} double" for n in names), stride=stride)
    return df.select("day", "sat", "channel", "y", "x", F.col("Rad").alias("rad"), F.struct(*[F.col(f"planck_{n}").alias(n) for n in names]).alias("planck"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """(sat, channel, fk1, fk2, bc1, bc2), one row per satellite and channel of raw files; raises if files of a channel differ.

    One pixel of each file is read.
    """
    one = read_channels(spark, path).filter("y = 0 AND x = 0")
    held = one.groupBy("sat", "channel").agg(F.min("planck").alias("p"), F.max("planck").alias("q"))
    same = F.when(F.col("p") == F.col("q"), F.col("p")).otherwise(F.raise_error(F.lit("the calibration of a channel changes")).cast("struct<fk1:double,fk2:double,bc1:double,bc2:double>"))
    return held.select("sat", "channel", same.alias("p")).select("sat", "channel", "p.*")


def gridded_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(day, sat, channel, fk1, fk2, bc1, bc2) of the spectral channels of gridded files."""
    out = None
    for sat in SATELLITES:
        rows = read_grids(spark, path, f"day int, y int, x int, planck_{sat} array<array<double>>, lza_{sat}_interp_corr double").filter("y = 0 AND x = 0")
        at = F.posexplode(F.array(*[F.col(f"planck_{sat}")[i] for i in SPECTRAL])).alias("i", "p")
        channels = F.array(*[F.lit(8 + i) for i in SPECTRAL])
        own = rows.select("day", F.lit(sat).alias("sat"), at).select("day", "sat", channels[F.col("i")].alias("channel"), *[F.col("p")[j].alias(n) for j, n in enumerate(("fk1", "fk2", "bc1", "bc2"))])
        out = own if out is None else out.unionByName(own)
    return out


def read_pixels(spark: SparkSession, path: str, labels: str | None = None, rows: int = 512, stride: int = 1, corrected: bool = True) -> DataFrame:
    """`tables.PIXELS` of gridded files that hold both satellites; scenes are null without `labels`, and where unidentified."""
    suffix = "_corr" if corrected else ""
    out = None
    for sat in SATELLITES:
        rad, lza = f"rad_{sat}_interp{suffix}", f"lza_{sat}_interp{suffix}"
        own = read_grids(spark, path, f"day int, y int, x int, {rad} array<double>, {lza} double", rows, stride)
        own = own.select("day", "y", "x", F.lit(sat).alias("sat"), F.array(*[F.col(rad)[i] for i in SPECTRAL]).alias("rad"), F.col(lza).alias("lza"))
        out = own if out is None else out.unionByName(own)
    if labels is None:
        return conform(out.withColumn("scene", F.lit(None).cast("int")), PIXELS)
    scenes = scene_labels(spark, labels, rows)
    return conform(out.join(scenes, ["day", "y", "x"], "left"), PIXELS)


def scene_labels(spark: SparkSession, path: str, rows: int = 512) -> DataFrame:
    """(day, y, x, scene) of label files; null where the sorted label is missing, that is, unidentified."""
    df = read_grids(spark, path, "day int, y int, x int, labels double, sorted_labels double", rows)
    return df.select("day", "y", "x", F.when(F.col("sorted_labels").isNotNull(), F.col("labels").cast("int")).alias("scene"))


def write_grids(df: DataFrame, folder: str, name: Column, first: Column, y: str, x: str, values: Sequence[str], width: int, attributes: dict | None = None) -> DataFrame:
    """Writes one file per name, each a slab of whole rows from its first one on, and returns (name, rows, bytes).

    The rows of a file meet in one task, so a name should stand for a slab of
    bounded height. Places without a row, and nulls, are missing in the file.
    The folder must be one that all executors reach.
    """
    names = list(values)

    def write(table: pa.Table) -> pa.Table:
        at = table["_first"][0].as_py()
        ys, xs = table["_y"].to_numpy() - at, table["_x"].to_numpy()
        height = int(ys.max()) + 1
        variables = {}
        for i, n in enumerate(names):
            image = np.full((height, width), np.nan)
            image[ys, xs] = table[f"_v{i}"].to_numpy(zero_copy_only=False)
            variables[n] = (("y", "x"), image, {"_FillValue": np.float64(np.nan)})
        data = classic.encode({"y": height, "x": width}, variables, {"first_row": np.int32(at), **(attributes or {})})
        uri = "://" in folder or folder.startswith("file:")
        store, inner = pafs.FileSystem.from_uri(folder) if uri else (pafs.LocalFileSystem(), folder)
        store.create_dir(inner, recursive=True)
        target = f"{inner.rstrip('/')}/{table['_name'][0].as_py()}"
        # a task that is tried again, or runs twice, replaces a whole file by an equal one
        temporary = f"{target}.{np.random.default_rng().integers(1 << 62)}.part"
        with store.open_output_stream(temporary) as out:
            out.write(data)
        store.move(temporary, target)
        return pa.table({"name": [table["_name"][0].as_py()], "rows": pa.array([height], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    rows = df.select(name.alias("_name"), first.cast("long").alias("_first"), F.col(y).cast("long").alias("_y"), F.col(x).cast("long").alias("_x"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(names)])
    return rows.groupBy("_name").applyInArrow(write, "name string, rows long, bytes long")
