"""Shared pieces: materialised tables in the cluster's shared folder, and bounded broadcasts."""

from __future__ import annotations

import atexit
import pickle
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that may be broadcast, for tables of ids, hashes and numbers, and bytes, for those with texts or arrays.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a folder below the warehouse if the session runs in one
    process, as in tests; on a cluster that is an error, since other machines don't see a folder of this one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.shared"
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(found)
    found = found.rstrip("/")
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _written[path] = spark
    if len(_written) == 1:
        atexit.register(drop_all)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that materialize() wrote and that are still there. Those behind a result can only go when it has been used.
_written: dict[str, SparkSession] = {}


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files behind a table that materialize() returned."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, root)
        _written.pop(next((p for p in _written if p.rsplit("/", 1)[-1] == root.rsplit("/", 1)[-1]), None), None)


def drop_all(spark: SparkSession | None = None) -> None:
    """Deletes what materialize() wrote and nobody has dropped, of one session or all; called when the program ends, and to be
    called by programs that run on, once their results are written."""
    for path, own in list(_written.items()):
        if spark is None or own is spark:
            _written.pop(path)
            try:
                delete(own, path)
            except Exception:  # noqa: BLE001  the session may have ended before
                if spark is not None:
                    raise


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if its size is within the bound; otherwise joins with it shuffle."""
    return F.broadcast(df) if bounded(df, rows) else df


def small_bytes_or_shuffled(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """The same for rows with texts or arrays: size is a row's bytes, of which all may have so many together."""
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= most else df


def share(spark: SparkSession, value):
    """Broadcasts value, of a bounded size; returns a function that yields it in a worker, which needn't have this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def utf8(column: pa.Array):
    """The values of a string column as bytes, one at a time; None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (x.as_py() for x in column.cast(kind))


def columns_free(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of df: name, or name with underscores appended."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
