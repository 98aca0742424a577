"""Session helpers: table reading, checkpoints, bounded collects."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Gives the workers this package, once per application, whatever their Python path is."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    # served to the executors by the driver
    sc.addPyFile(str(target))
    sc._quern_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to ``columns`` when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder named by ``spark.checkpoint.dir`` is used as it is. Only a local
    master gets a temporary folder when that setting is missing; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a result whose size is bounded by its nature.

    ``limit`` is the proven bound; one row more is asked for, and exceeding the
    bound is an error, never a silent cut.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than the bound of {limit} rows")
    return rows


def slices(spark: SparkSession, factor: int = 1) -> int:
    """Partition count that follows the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer tasks, as of one small file that is costly to compute on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
