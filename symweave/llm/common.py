"""What several operators share: tables in the shared folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few machine words each that a broadcast may have; beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 500

_own_folder: list[str] = []
_known_folders: set[str] = set()
_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """In a Python worker that is used again: what make() gave for key, the one thing that is held between tasks."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of what the worker holds, for operators that have no use for it, and gives free memory back."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows, so that a worker has few texts as Python strings at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_batches(spark: SparkSession) -> None:
    """Has Spark hand whole texts to Python workers in Arrow batches of at most TEXT_ROWS rows from now on: its default of
    10,000 rows of long texts would take much of a worker's and an executor's memory. Any other setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a local master, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="symweave-"))
    return f"file://{_own_folder[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        _delete(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here and lost executors cost nothing.

    forget() deletes the files; those that results still read go when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/symweave/{spark.sparkContext.applicationId}"
    if folder not in _known_folders:
        _known_folders.add(folder)
        atexit.register(_delete_at_exit, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes the files of tables made by stored() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "stored_path", None)
        if path:
            _delete(df.sparkSession, path)


def unused(name: str, *tables: DataFrame) -> str:
    """name, with as many underscores in front as no column of the tables has: for columns that are added for a while."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each node on an edge: (node, component), by alternating large and small stars; stored.

    edges: two columns of one orderable type; nulls are dropped, loops keep their node. Each round is two grouped minima
    and joins on the node; a node with very many edges is pre-aggregated, and its join is split by adaptive execution.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    given = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now, before, old = given.where("u <> v"), None, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        forget(old)
        if state == before:
            break
        old, before = now, state
    alone = given.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out = stored(named.unionByName(alone.join(named, "node", "left_anti")))
    forget(given, now)
    return out
