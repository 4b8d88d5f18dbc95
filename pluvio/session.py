"""Session settings, staged tables and the size check that guards every broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count of a table that may be broadcast. Beyond it the same join runs as a shuffle join.
MAX_BROADCAST_ROWS = 100_000
_SHIPPED: set[str] = set()


def build_session(app: str = "pluvio", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application.

    The archive is packed on the driver and handed to every executor by Spark itself, so tasks can
    import the kernels wherever the driver was started.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="pluvio-ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: `spark.checkpoint.dir`, or a scratch folder in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="pluvio-stage-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)  # one machine only, as in tests
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Compute once and read back from the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A join side whose size is checked before it is broadcast.

    At most `max_rows + 1` rows are fetched. If that is all of it, the rows become a local table with a
    broadcast hint; if there are more, the table is staged and joined by a shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return stage(df)
    spark = df.sparkSession
    return F.broadcast(spark.createDataFrame(rows, df.schema) if rows.num_rows else spark.createDataFrame([], df.schema))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys in which NULL matches NULL; the keys appear once."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = one if cond is None else cond & one
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])
