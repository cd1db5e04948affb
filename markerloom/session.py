"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIR = "spark.checkpoint.dir"
_RUN = uuid.uuid4().hex
_FOLDERS: set[str] = set()

# Rows and bytes of a table that may be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("markerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be unreachable for other executors.
    """
    folder = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR, None)
    if not folder:
        # local-cluster has executors of their own.
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_DIR} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set(_DIR, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this process that goes when the process ends in order."""
    folder = f"{shared_dir(spark).rstrip('/')}/markerloom/{_RUN}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_clean, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _clean(folder: str) -> None:
    spark = SparkSession.getActiveSession()
    # After the session was stopped nothing can be reached any more.
    if spark is not None and spark.sparkContext._jsc is not None:
        remove_path(spark, folder)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return [f.getPath().getName() for f in found]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a stored table, where it is; tables of finished calls are not kept."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table written once, marked for broadcast if it has at most max_rows rows.

    Joining a large table to a small derived one would else shuffle the large one
    before its partner's size is known. A partner with more rows or bytes gets the ordinary join.
    """
    kept = checkpointed(df)
    # 16 bytes for a field, whole lengths for texts and arrays.
    wide = [f.name for f in kept.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    length = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in wide), F.lit(16 * len(kept.columns)))
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    return F.broadcast(kept) if size.n <= max_rows and size.bytes <= BROADCAST_BYTES else kept
