"""Tables between the steps of an operator, in the folder that all executors share.

The folder is the one named by ``spark.checkpoint.dir``. Where that is unset, a temporary folder is used, which is allowed in local
mode only. Everything written is removed when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; SparkContext's checkpoint folder is set to it if it has none."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seqspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
        _written.append((spark, sc.getCheckpointDir()))
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed with the rest."""
    path = f"{shared_folder(spark).rstrip('/')}/seqspark-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def store(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return the table: lineage ends there, and nothing is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Remove tables of :func:`store` that nothing will read again; other tables are left alone."""
    for df in stored:
        path = getattr(df, "stored_at", None)
        if path:
            _remove(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fixed(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` so that its partitions and their order stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int:
    """Stored size of the tables that ``df`` reads, as the optimizer knows it; no job is run. Tables of unknown size count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 2**60)


def small_enough(df: DataFrame, limit_mb: float = 16.0, row_bytes: int = 48) -> bool:
    """Whether a (stored) table is certain to fit a broadcast: rows times ``row_bytes`` plus the length of its text columns."""
    text = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    total = F.count(F.lit(1)) * row_bytes
    for t in text:
        total = total + t
    return (df.agg(total.alias("b")).first()["b"] or 0) <= limit_mb * 1e6


def lookup(df: DataFrame, limit_mb: float = 16.0) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows that, else as it is (a shuffled join, split by AQE where skewed)."""
    return F.broadcast(df) if small_enough(df, limit_mb) else df


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` on any executor, sent once to each; its classes travel along, so nothing need be installed there."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


@atexit.register
def clean() -> None:
    """Remove what :func:`store` and :func:`fixed` wrote; to be called once results that rest on it are no longer needed."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended; a folder on a file system is still within reach
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
