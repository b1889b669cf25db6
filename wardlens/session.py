"""SparkSession construction and cluster-safe helpers.

Everything here is ordinary session configuration. On a cluster the session
is usually created by the platform; ``configure`` only fills in settings that
are still unset, so cluster-level choices (shuffle partitions, checkpoint
folder) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library relies on.  ANSI mode stays on (Spark 4
# default); code uses try_* functions where bad input must become NULL.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # The derived tables carry many CASE-built columns; constraint inference
    # over them grows combinatorially at planning time (minutes, no gain).
    "spark.sql.constraintPropagation.enabled": "false",
}

# Runtime SQL settings applied to any session the library is handed.
RUNTIME_CONF = {"spark.sql.constraintPropagation.enabled": "false"}


def tune_session(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def get_session(master: str | None = None, app: str = "wardlens",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` defaults to ``local[$BENCH_CPUS or *]`` for local runs.
    """
    cpus = os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("WARDLENS_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wardlens`` importable in Python workers (pandas UDFs,
    applyInPandas) by shipping it as a zip with ``addPyFile`` — once per
    SparkContext."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="wardlens-py-"), "wardlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the platform names a shared folder (HDFS/object store) and we
    use it as is.  Only when it is unset (local tests) do we create a private
    scratch folder so that ``DataFrame.checkpoint()`` works; executors of a
    cluster could not see it, so there an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="wardlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut lineage.

    Uses ``checkpoint()`` into the shared checkpoint folder — never
    ``localCheckpoint()``, whose blocks die with their executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# (application, name, state of the inputs) -> (path, schema) of tables stored once.
_STORED: dict[tuple, tuple] = {}


def _state(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells whether files have changed: path, bytes and the latest change of each input."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        out.append((name, fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a written table is still there as a whole."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def stored_once(spark: SparkSession, name: str, inputs: list[str], build) -> DataFrame:
    """The table that ``build()`` derives from the files ``inputs``, written to the shared folder the first time it is asked for.

    Later queries of the application scan the written table, of which only
    the columns and rows they need are read; inputs that have changed are
    derived anew.  The write is complete before the table is known.
    """
    key = (spark.sparkContext.applicationId, name, _state(spark, inputs))
    if key not in _STORED or not _complete(spark, _STORED[key][0]):
        df = build()
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)
