"""Readers with declared schemas and provenance, writers with counts and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


EVENT_SCHEMA = _fields(event_time=_S, order_id=_S, searchid=_S, query=_S, disp_lng=_D, disp_lat=_D, poi_id=_S)
ORDER_SCHEMA = _fields(
    order_id=_S,
    searchid=_S,
    passenger_id=_S,
    query=_S,
    poi_id=_S,
    disp_lng=_D,
    disp_lat=_D,
    birth_time=_S,
    create_time=_S,
    source_dt=_S,
    history_length=_I,
    history_sequence=T.ArrayType(EVENT_SCHEMA),
)
ENTITY_SCHEMA = _fields(poi_id=_S, displayname=_S, alias=_S, address=_S, category=_S, category_code=_S, lng=_D, lat=_D, text=_S)


def read_json(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "part-*") -> DataFrame:
    """JSON lines under a folder that its writer has completed; a malformed row is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        raise FileNotFoundError(f"{path} has no _SUCCESS: its writer has not finished")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(path)


def read_lines(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """value, file: raw lines with the file that each is from."""
    return spark.read.option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def with_row_index(lines: DataFrame) -> DataFrame:
    """row_index over files in name order and lines in file order: ranks within files, offsets by file."""
    numbered = lines.withColumn("__m", F.monotonically_increasing_id())
    own = numbered.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("__m")))
    sizes = own.groupBy("file").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(sizes.select("file", before.alias("__o")), "file").withColumn("row_index", F.col("__o") + F.col("line") - 1).drop("__m", "__o")


def quarantine(frame: DataFrame, faults) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `faults`)."""
    marked = frame.withColumn("faults", faults)
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


def write_parquet(frame: DataFrame, path: str, key: str | None = None, parts: int = 256) -> None:
    """ZSTD Parquet, by hash of a key where given; an existing folder is an error, as is a half-written one for readers."""
    out = frame.repartition(parts, key).sortWithinPartitions(key) if key else frame
    out.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_sorted(frame: DataFrame, path: str, keys: list[str], parts: int) -> None:
    frame.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").json(path)


def manifest(frame: DataFrame) -> DataFrame:
    """One row: rows and a fingerprint that does not depend on their order."""
    columns = [F.col(f"`{c}`") for c in frame.columns]
    return frame.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("fingerprint"))
