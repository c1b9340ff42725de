"""Readers with declared schemas, writers, and checks that fail loudly."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Channels in their order, and satellites.
CHANNELS = ("ch08", "ch11", "ch12", "ch14", "ch15", "ch16")
SATELLITES = ("G16", "G18")

PIXELS = T.StructType(
    [
        T.StructField("day", T.IntegerType(), False),
        T.StructField("y", T.IntegerType(), False),
        T.StructField("x", T.IntegerType(), False),
        T.StructField("sat", T.StringType(), False),
        T.StructField("rad", T.ArrayType(T.DoubleType())),
        T.StructField("lza", T.DoubleType()),
        T.StructField("scene", T.IntegerType()),
    ]
)
RESPONSE = T.StructType([T.StructField("wavelength_nm", T.DoubleType()), T.StructField("response", T.DoubleType())])


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the folder `spark.checkpoint.dir`, which all executors share, and forget its lineage.

    Where the session names none, a local session gets a folder of its own; a
    cluster raises.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    present = context._jsc.sc().getCheckpointDir()
    if present.isDefined():
        return present.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema in its order and types; raises if one is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows of Parquet files; NaN radiances and angles become null."""
    df = conform(spark.read.parquet(path), PIXELS)
    clean = F.transform("rad", lambda r: F.when(~F.isnan(r), r))
    return df.withColumns({"rad": clean, "lza": F.when(~F.isnan("lza"), F.col("lza"))})


def read_response(spark: SparkSession, path: str) -> DataFrame:
    """(wavelength_nm, response) of white-space separated text; lines that don't begin with a number are headers."""
    parts = F.split(F.trim("value"), r"\s+")
    number = r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"
    lines = spark.read.text(path).select(parts.alias("p")).filter((F.size("p") >= 2) & F.col("p")[0].rlike(number) & F.col("p")[1].rlike(number))
    return conform(lines.select(F.col("p")[0].alias("wavelength_nm"), F.col("p")[1].alias("response")), RESPONSE)


def catalogue(paths: DataFrame) -> DataFrame:
    """(path, product, channel, satellite, day) from the parts of file names; the day is parsed, not searched for."""
    name = F.substring_index("path", "/", -1)
    return paths.select(
        "path",
        F.nullif(F.regexp_extract(name, r"(?i)(abi|cth|adm|nav)", 1), F.lit("")).alias("product"),
        F.nullif(F.regexp_extract(name, r"(?i)c(?:h)?([0-9]{2})", 1), F.lit("")).cast("int").alias("channel"),
        F.nullif(F.regexp_extract(name, r"(G1[0-9])", 1), F.lit("")).alias("satellite"),
        F.nullif(F.regexp_extract(name, r"(?:_s[0-9]{4}|_day)([0-9]{1,3})", 1), F.lit("")).cast("int").alias("day"),
    )


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = (), rows_per_file: int = 5_000_000) -> None:
    """Parquet, partitioned by the given columns, without tiny files or giant ones."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def finite_numbers(df: DataFrame) -> DataFrame:
    """The table with null for every number that is NaN or infinite, inside structs and arrays too."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.DoubleType | T.FloatType):
            return F.when(F.abs(c) < float("inf"), c)  # NaN compares as the largest value
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; values that are not finite become null first."""
    finite_numbers(df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def slug(name: str) -> str:
    """Lower-case letters and digits, an underscore for each other character, none at the ends."""
    return "".join(c if c.isascii() and c.isalnum() else "_" for c in name.lower()).strip("_")


def product_path(root: str, product: str, day: int, satellite: str | None = None) -> str:
    """Where a day's product lies: root/product/day=DDD, and below it the satellite's part."""
    path = f"{root.rstrip('/')}/{slug(product)}/day={day:03d}"
    return f"{path}/satellite={satellite}" if satellite else path


def row_slabs(height: int, rows: int, block: int = 1) -> list[tuple[int, int]]:
    """First and last rows + 1 of slabs of at most `rows` lines, in whole blocks; a partial block at the end is left out."""
    whole, step = height // block * block, max(block, rows // block * block)
    return [(start, min(start + step, whole)) for start in range(0, whole, step)]
