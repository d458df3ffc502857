"""Session helpers: a sane local session for tests/bench, and the shared folder for derived tables.

Derived tables (the token corpus, its vocabulary, token statistics, postings) are written once
under ``spark.checkpoint.dir`` -- the shared folder the cluster names -- and read back by every
query. Writing a table both cuts lineage (a lost executor re-reads files instead of recomputing
the build) and lets many queries share one build, as a prebuilt index would.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan in this library relies on. They can be changed on a live
# session, so queries apply them even when the caller built the session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts and samples differ in length by a thousand times: a batch of many rows is held by the JVM and the worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Shuffle files go when the action that wrote them ends, not when the driver collects its garbage. Where a
    # DataFrame is read by another action after that, Spark runs the stages again.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "tokenlens") -> SparkSession:
    """Session for tests and the benchmark. On a cluster the caller's own session is used instead."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        # checkpoint files of intermediate results are removed once nothing references them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever they run: once per application
    its source goes to all executors as a zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_tokenlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tokenlens-ship-"), "tokenlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if not name.endswith(".pyc"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._tokenlens_shipped = True


def apply_runtime_conf(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``. A temporary folder is made only where it is
    unset and the driver runs all tasks itself (tests); executors elsewhere could not read one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="tokenlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return bool(fs.exists(p))


DONE_MARKER = "_TOKENLENS_DONE"


def is_done(spark: SparkSession, path: str) -> bool:
    """True when a derived table at ``path`` was completely written (marker written last)."""
    return path_exists(spark, f"{path}/{DONE_MARKER}")


def mark_done(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, f"{path}/{DONE_MARKER}")
    fs.create(p, True).close()


def fingerprint(spark: SparkSession, *paths: str, extra: str = "") -> str:
    """Content key of input files: path, length and modification time of every file at or below the
    paths, read through Hadoop FS. Folder times are left out: they say nothing on object stores."""
    h = hashlib.sha1(extra.encode())
    for path in paths:
        fs, p = _hadoop_path(spark, path)
        if not fs.exists(p):
            h.update(f"{path}:missing".encode())
            continue
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
        h.update("\n".join([path, *sorted(found)]).encode())
    return h.hexdigest()[:16]


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None, schema=None) -> DataFrame:
    """Write ``df`` as parquet at ``path`` unless a finished copy is there; return the table read back.

    The marker is written only after the whole job committed, so a half-written folder from a
    lost job is simply rewritten.
    """
    spark = df.sparkSession
    if not is_done(spark, path):
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        mark_done(spark, path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint into the shared folder (set first if the session names none):
    cuts lineage so a lost executor re-reads the checkpoint instead of recomputing the plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
