"""Parquet artifacts: checked writes, cached builds and resumable backfills."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.contracts import key_violations


_OWN_SCRATCH: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share
    (spark.checkpoint.dir); a local one only where that is not set and the
    master is local, as executors of a cluster do not share their disks."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN_SCRATCH.setdefault(app, "file://" + tempfile.mkdtemp(prefix="panelspine-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a fresh path of the shared folder and read back: what
    follows reads it as often as it likes without computing it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_checked(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write df, read it back, and fail if keys are not unique or empty."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.isEmpty():
        raise ValueError(f"{path} has no rows")
    if not key_violations(back, keys).isEmpty():
        raise ValueError(f"{path} repeats a key of {keys}")
    return back


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def build_cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The artifact at path, built only where it is absent or to be rebuilt."""
    found = None if rebuild else read_if_there(spark, path)
    if found is None:
        build().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def unfinished(planned: DataFrame, done: DataFrame | None, unit: list[str]) -> DataFrame:
    return planned if done is None else planned.join(done.select(*unit).distinct(), unit, "left_anti")


def backfill(planned: DataFrame, path: str, unit: list[str], process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process the planned units that path lacks, and append them by unit.

    A unit without result rows leaves a hole: it is returned, and a later run
    tries it again and nothing else.
    """
    spark = planned.sparkSession
    todo = unfinished(planned, read_if_there(spark, path), unit)
    process(todo).write.mode("append").partitionBy(*unit).parquet(path)
    return unfinished(planned, read_if_there(spark, path), unit)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def edges_of(polygons: DataFrame) -> DataFrame:
    """The edge table of (poly, place, parent, ring): ring is an array of (x, y)
    whose last corner joins the first."""
    n = F.size("ring")
    k = F.explode(F.sequence(F.lit(0), n - 1))
    rows = polygons.select("poly", "place", "parent", "ring", k.alias("k"))
    a, b = F.get("ring", F.col("k")), F.get("ring", (F.col("k") + 1) % F.size("ring"))
    return rows.select("poly", "place", "parent", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


POLYGONS = T.StructType(
    [
        T.StructField("poly", T.LongType()),
        T.StructField("place", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("ring", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
    ]
)


def read_polygons(spark: SparkSession, path: str, *, poly: str = "poly", place: str = "place", parent: str = "parent", ring: str = "ring") -> DataFrame:
    """The edges of a polygon table in Parquet: its columns renamed, rings as
    arrays of (x, y). Other columns are not read; rows without a ring are left out."""
    rows = spark.read.parquet(path).where(F.size(ring) > 2)
    return edges_of(rows.select(F.col(poly).alias("poly"), F.col(place).alias("place"), F.col(parent).alias("parent"), F.col(ring).alias("ring")))


def polygon_layer(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small layer from literal (poly, place, parent, [(x, y), ...]) rows."""
    return edges_of(spark.createDataFrame(rows, POLYGONS))
