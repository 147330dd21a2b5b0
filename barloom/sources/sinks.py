"""Run results: clean, save, keep the newest runs, list and read them."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barloom.session import stage, unstage
from barloom.sources.bars import upsert_bars

KEEP_RUNS = 20


def _clean_value(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), F.round(d, 4))
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _clean_value(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: _clean_value(v, t.valueType))
    if isinstance(t, T.StructType):
        inner = F.struct(*[_clean_value(c[f.name], f.dataType).alias(f.name) for f in t.fields])
        return F.when(c.isNotNull(), inner)
    return c


def strict_clean(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, doubles to 4 digits, dates to text - also inside arrays, maps and structs."""
    return df.select(*[_clean_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, so that the rows fit a CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        (F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields])


# ---- runs ------------------------------------------------------------------------------------------------
#
# A run is published by a row in the table ``manifests``, written after its files: a save that ends half-way is never seen, and one that
# runs again stands beside the old files until its own row makes it the run. Rows are only ever added; the newest of a run counts.

MANIFEST = "run_id string, generated_at string, rows long, place string, saved_at long"


def _publish(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    if rows:
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifests")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each run that is not dropped (a dropped one has no place)."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{root}/manifests")
    except AnalysisException:
        rows = spark.createDataFrame([], MANIFEST)
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct("generated_at", "rows", "place"), "saved_at").alias("m"))
    return newest.select("run_id", "m.*").filter("place is not null")


def save_run(rows: DataFrame, root: str, run_id: str, generated_at: str) -> None:
    """Writes a run as JSON and as flat CSV and publishes it; saving it again replaces it at once."""
    spark, place = rows.sparkSession, f"data/run_id={run_id}/save={uuid.uuid4().hex}"
    clean = stage(strict_clean(rows).withColumns({"run_id": F.lit(run_id), "generated_at": F.lit(generated_at)}), "run")
    clean.write.json(f"{root}/{place}/json")
    flat_columns(clean).write.option("header", True).csv(f"{root}/{place}/csv")
    _publish(spark, root, [(run_id, generated_at, clean.count(), place, time.time_ns())])
    unstage(clean)


def list_runs(spark: SparkSession, root: str, keep: int | None = None) -> DataFrame:
    """Published runs, newest first, with their time and number of rows; with ``keep`` only so many."""
    runs = _manifests(spark, root).select("run_id", "generated_at", "rows").orderBy(F.desc("run_id"))
    return runs if keep is None else runs.limit(keep)


def read_run(spark: SparkSession, root: str, run_id: str = "latest", fmt: str = "json") -> DataFrame | None:
    """One published run; 'latest' is the greatest run id. None if there is no such run."""
    runs = _manifests(spark, root)
    wanted = runs if run_id == "latest" else runs.filter(F.col("run_id") == run_id)
    found = wanted.orderBy(F.desc("run_id")).limit(1).collect()                # one row of the manifest
    if not found:
        return None
    path = f"{root}/{found[0]['place']}/{fmt}"
    return spark.read.json(path) if fmt == "json" else spark.read.option("header", True).csv(path)


def drop_old_runs(spark: SparkSession, root: str, keep: int = KEEP_RUNS) -> list[str]:
    """Retires all but the newest ``keep`` runs, then deletes every file that no published run names; returns the retired ids.

    Saves that ended half-way go too, so none may be running.
    """
    runs = sorted(_manifests(spark, root).select("run_id", "place").collect(), reverse=True)      # one row a run
    old = runs[keep:]
    _publish(spark, root, [(r["run_id"], None, None, None, time.time_ns()) for r in old])
    Path = spark._jvm.org.apache.hadoop.fs.Path
    named = {r["place"] for r in runs[:keep]}
    base = Path(f"{root}/data")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for run in fs.listStatus(base) if fs.exists(base) else []:
        for save in fs.listStatus(run.getPath()):
            if f"data/{run.getPath().getName()}/{save.getPath().getName()}" not in named:
                fs.delete(save.getPath(), True)
    return sorted(r["run_id"] for r in old)


# ---- bars by month ------------------------------------------------------------------------------------------

def with_month(bars: DataFrame) -> DataFrame:
    return bars.withColumn("month", F.date_format("date", "yyyy-MM"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars by month: one folder per month, symbols sorted inside so scans skip row groups. Months without new rows are left alone."""
    (with_month(bars).repartition("month").sortWithinPartitions("symbol", "date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def read_bars(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Stored bars with their ``month``."""
    return (spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("month", T.StringType())]))).parquet(path)


def between(bars: DataFrame, first: Column, last: Column) -> DataFrame:
    """The bars from ``first`` to ``last``; where bars are stored by month only the months between are read."""
    inside = bars.filter(F.col("date").between(first, last))
    if "month" not in bars.columns:
        return inside
    return inside.filter(F.col("month").between(F.date_format(first, "yyyy-MM"), F.date_format(last, "yyyy-MM"))).drop("month")


def upsert_stored(fetched: DataFrame, path: str) -> list[str]:
    """Merges fetched bars into stored ones (``bars.upsert_bars``), reading and rewriting only the months they fall into; returns these."""
    spark = fetched.sparkSession
    new = stage(fetched, "fetched")
    months = sorted(r["month"] for r in with_month(new).select("month").distinct().collect())     # bounded by the calendar
    if not months:
        return []
    stored = read_bars(spark, path, new.schema).filter(F.col("month").isin(months)).select(*new.columns)
    merged = stage(upsert_bars(stored, new).select(*new.columns), "merged")                         # before its sources are replaced
    write_bars(merged, path)
    unstage(new)
    unstage(merged)
    return months
