"""Shared pieces of the training-data operators: scratch tables, Arrow row maps, word hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and RE2 class of the ASCII white space that separates words.
WS = r"\x20\x09-\x0D"

#: Rows, and about so many bytes of them, that are Python objects at a time; a batch's other rows stay in Arrow's memory.
SLICE, SLICE_BYTES = 512, 8_000_000

LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir as the session has it.

    Only a session in one JVM (master local or local[n]) that names none gets a temporary folder;
    on a cluster a missing setting is an error, because executors don't share local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairnflow-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Scratch tables by application and by the owner that the writing thread had named.
_OWNED: dict[tuple[str, str], list[str]] = {}
_THREAD = threading.local()


def own_scratch(owner: str) -> None:
    """Name the owner of the scratch tables that this thread writes from now on."""
    _THREAD.owner = owner


def release(spark: SparkSession, owner: str) -> None:
    """Delete the scratch tables of an owner whose results have been written elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _OWNED.pop((spark.sparkContext.applicationId, owner), []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cairnflow-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    _OWNED.setdefault((spark.sparkContext.applicationId, getattr(_THREAD, "owner", "")), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, inputs: list[str], added: T.StructType, fn: Callable[[], Callable[..., Iterable]], keep: list[str] | None = None, rows: int = SLICE) -> DataFrame:
    """Add columns computed in Arrow batches.

    fn() is called once a task and returns a function that takes a batch's input columns as Python lists and
    returns one list for each added column. keep: the columns of df that stay (default all); an added column
    replaces a kept one of the same name (names compare without case, as Spark's do). rows: how many are lists at a time.
    """
    names = {f.name.lower() for f in added.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    types = [to_arrow(f.dataType) for f in added.fields]
    labels = [*kept, *(f.name for f in added.fields)]
    # inputs travel under names of their own, so that the kept columns may carry any name
    sent = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(inputs)])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for whole in batches:
            for batch in slices(whole, rows):
                made = work(*[batch.column(n + i).to_pylist() for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.array(v, t) for v, t in zip(made, types, strict=True)], labels)

    return sent.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    step = max(1, min(rows, SLICE_BYTES * rows // SLICE * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def set_aside(docs: DataFrame, *roles: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those of the named roles under names that clash with none, and what gives the names back.

    A role is the column of that very name, else the first that differs in case only. What is computed beside the columns
    must not begin with `col`.
    """
    own: dict[int, str] = {}
    for role in roles:
        at = [i for i, c in enumerate(docs.columns) if c == role] or [i for i, c in enumerate(docs.columns) if c.lower() == role.lower()]
        if at:
            own[at[0]] = role
    names = [own.get(i, f"col{i}") for i in range(len(docs.columns))]

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])

    return docs.toDF(*names), back


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to a bound; the bound clears the memory and changes no result."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
