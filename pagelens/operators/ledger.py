"""Row stores as snapshots: inserts, upserts, deletes, balances, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import in_order

STATUSES = ["queued", "running", "success", "error", "cancelled"]


def append(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """New rows get ids after the largest one, in the order; each task numbers its own range of them."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    placed, _ = in_order(rows, [order])
    return table.unionByName(placed.withColumn(key, (F.col("_n") + 1 + top).cast("long")).drop("_n"), allowMissingColumns=True)


def update(table: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def update_known(table: DataFrame, where: Column, changes: dict[str, Column], at: Column) -> DataFrame:
    """Like update, and sets updated_at of the rows it changes; an error if there is none."""
    if table.where(where).isEmpty():
        raise LookupError("no row to update")
    old = F.col("updated_at") if "updated_at" in table.columns else F.lit(None)
    return update(table.withColumn("updated_at", old.cast("timestamp")), where, changes | {"updated_at": at.cast("timestamp")})


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def upsert_latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last version of each key: an aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("_r")).select(*key, "_r.*")


def running_balance(entries: DataFrame, user: str, order: list[str], delta: Column) -> DataFrame:
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("balance", F.sum(delta).over(w))


def quota(rows: DataFrame, user: str, limit: int) -> DataFrame:
    return rows.groupBy(user).agg(F.count("*").alias("n")).withColumn("full", F.col("n") >= limit)


def fold_status(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Last status and step of each job; success sets the step to the total."""
    last = events.groupBy(job).agg(F.max_by("status", F.struct(*order)).alias("status"), F.max_by("step", F.struct(*order)).alias("step"), F.max("total").alias("total"))
    return last.withColumn("step", F.when(F.col("status") == "success", F.col("total")).otherwise(F.col("step")))


def reset_stuck(jobs: DataFrame) -> DataFrame:
    return update(jobs, F.col("status").isin("queued", "running"), {"status": F.lit("error")})


def append_log(log: Column, entry: Column, keep: int = 200) -> Column:
    return F.slice(F.concat(F.coalesce(log, F.array().cast("array<struct<at:timestamp,step:int,text:string>>")), F.array(entry)), F.greatest(F.size(log) + 2 - keep, F.lit(1)), F.lit(keep))


def migrate(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds missing columns as nulls of the given type."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def violations(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with its names."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return table.withColumn("violations", broken).where(F.size("violations") > 0)
