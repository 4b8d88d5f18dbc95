"""Catalog of recordings: append-only Parquet parts, a manifest of commits, insert-if-absent by hash id."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_SCHEMA = T.StructType([
    T.StructField("audio_id", T.StringType()), T.StructField("file_name", T.StringType()),
    T.StructField("sample_rate", T.IntegerType()), T.StructField("file_path", T.StringType())])
MANIFEST_SCHEMA = "version long, part string, rows long"
TRIES = 20  # commits that other writers may take first


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """`version, part, rows` of the committed parts."""
    path = f"{root.rstrip('/')}/manifest"
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(path).filter("part is not null")
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def _commit(spark: SparkSession, root: str, version: int, part: str, rows: int) -> bool:
    """Take a version number for a part: its whole file is renamed to the version's name, unless another writer has that name."""
    jvm, conf, place = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
    fs = jvm.org.apache.hadoop.fs
    ready, final = fs.Path(f"{place}/parts/{part}.json"), fs.Path(f"{place}/manifest/{version:012d}.json")
    files = ready.getFileSystem(conf)
    files.mkdirs(final.getParent())
    out = files.create(ready, True)
    out.write(bytearray(json.dumps({"version": version, "part": part, "rows": rows}).encode()))
    out.close()
    try:
        fs.FileContext.getFileContext(files.getUri(), conf).rename(ready, final, spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
    except Py4JJavaError:
        if files.exists(final):
            return False
        raise
    return True


def _stored(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], BASE_SCHEMA)
    return spark.read.option("mergeSchema", True).parquet(*[f"{root.rstrip('/')}/parts/{p}" for p in parts])


def _committed(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """The last version and all parts: a line a commit."""
    rows = manifest(spark, root).orderBy("version").collect()
    return max((r["version"] for r in rows), default=0), [r["part"] for r in rows]


def load_catalog(spark: SparkSession, root: str) -> DataFrame:
    """All committed parts, or an empty table with the base columns; columns that a part lacks are NULL there."""
    return _stored(spark, root, _committed(spark, root)[1])


def _absent(samples: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """One row per id that the catalog does not have. Of the catalog only the ids are read, and of these only known ones go on."""
    one = samples.filter(F.col(key).isNotNull()).dropDuplicates([key])
    known = catalog.select(key).join(one.select(key), key, "left_semi")
    return one.join(known, key, "left_anti")


def save_catalog(df: DataFrame, root: str, key: str = "audio_id") -> int:
    """Append the rows of `df` whose id is not stored yet, as one part, and return the catalog's version.

    What is stored is not written again: n new rows write n rows, and without any the version stays. A part counts from its
    commit on; a writer that finds its version taken looks at the parts that came before it and tries the next one,
    so two writers lose no row and store no id twice. Rows without id are left out.
    """
    spark, place = df.sparkSession, root.rstrip("/")
    for _ in range(TRIES):
        last, parts = _committed(spark, root)
        part = uuid.uuid4().hex
        path = f"{place}/parts/{part}"
        fresh = _absent(df, _stored(spark, root, parts), key)
        fresh.write.mode("errorifexists").parquet(path)
        written = spark.read.schema(fresh.schema).parquet(path)
        rows = written.count()
        if not rows:
            return last
        if _commit(spark, root, last + 1, part, rows):
            return last + 1
        df = written  # what is left to do, should the other writer have had some of it
    raise RuntimeError(f"the catalog {root} was committed by others {TRIES} times")


def register(catalog: DataFrame, samples: DataFrame, key: str = "audio_id") -> DataFrame:
    """Append the samples whose id is new; columns that one side lacks are NULL there."""
    fresh = samples.dropDuplicates([key]).join(catalog.select(key), key, "left_anti")
    return catalog.unionByName(fresh, allowMissingColumns=True)
