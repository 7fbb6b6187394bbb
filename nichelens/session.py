"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Intermediate tables of this process, until :func:`clean_up`.
_WRITTEN: list[str] = []
#: Spark's setting that deletes the shuffle files of a query when it has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    app_name: str = "nichelens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings every operator here assumes.

    UTC session time (dates and ``%W`` weeks are computed in UTC) and AQE with
    skew handling. Cluster sizing is left to the submitter. The package goes to
    the executors.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        options["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    options.update(extra or {})
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per session, so that its Python functions load there.

    Spark's file server delivers the archive; nothing has to be installed on the workers.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if any(os.path.basename(f).startswith("nichelens-code-") for f in context.listFiles):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="spark-"))
    archive = os.path.join(folder, f"nichelens-code-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)


def prepare(spark: SparkSession) -> None:
    """What a session needs that :func:`build_session` did not build: UTC and the package on the executors."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a fresh temporary folder; on a cluster
    the executors would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Survives executor loss (unlike a local checkpoint), keeps column pruning and
    gives the optimizer real sizes for what follows. The shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing will read any more. Each is one that :func:`materialize` gave."""
    for table in tables:
        names = {os.path.basename(os.path.dirname(file)) for file in table.inputFiles()}
        for path in [p for p in _WRITTEN if os.path.basename(p) in names]:
            _delete(table.sparkSession, path)
            _WRITTEN.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far; results that read them must have been used by then."""
    for path in _WRITTEN:
        _delete(spark, path)
    _WRITTEN.clear()


def spread(scan: DataFrame) -> DataFrame:
    """Give a freshly read table at least one partition per core.

    Meant for heavy per-row work over a table that arrives in fewer splits than
    there are cores (one big row group, a few files). A table with enough splits,
    which is every large one, is returned untouched and never shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: dict[str, str]) -> DataFrame:
    """A small constant table made of literals, without a Python worker behind it."""
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, schema.items(), strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
