"""Session helpers: a local session for tests and benches, and written intermediate tables.

Operators that read an intermediate result more than once, or that iterate, cut their lineage by writing
the result as Parquet into the folder that the cluster names in ``spark.checkpoint.dir``. All executors share
that folder, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kataloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made, which is only
    allowed on a local master: on a cluster a machine-local folder would be unreadable for other executors.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kataloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over all cores if its files have fewer row groups than there are cores; a large table is left as it is.

    A row group is read by one task, so a table of one file would be worked on by one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def staged(df: DataFrame, name: str, after: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` into the scratch folder and return it as read from there (lineage cut).

    ``after`` are staged tables that nothing but ``df`` needs any more: they are removed once it is written.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    discard(*after)
    return out


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, local or of the cluster, and the path on it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def discard(*tables: DataFrame) -> None:
    """Remove staged tables. Only for those that no result and no later step reads: what is lost with an executor is read again from them."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            fs, at = file_system(df.sparkSession, path)
            fs.delete(at, True)
            df._staged_at = None
