"""Numbers that follow a global order, without a task that sees all rows.

Rows are range-partitioned by the order and staged; the driver gets one row
of counts for each partition, and each partition numbers its own rows from
what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import staged


def placed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows with their range's number in __p. The order should be total; equal rows meet in one range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ordered")


def _lookup(values: dict[int, int]) -> Column:
    """A literal map over range numbers, of which there are as many as shuffle partitions."""
    if not values:
        return F.lit(0).cast("long")
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("__p")).cast("long")


def numbered(rows: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """rows with their number in the order, from 0."""
    p = placed(rows, order)
    before, at = {}, 0
    for r in sorted(p.groupBy("__p").count().collect()):
        before[r["__p"]] = at
        at += r["count"]
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return p.withColumn(out, (own + _lookup(before)).cast("long")).drop("__p")


def runs(rows: DataFrame, key: str, order: list[str], out: str = "run") -> DataFrame:
    """Numbers of consecutive runs of equal keys, from 0; a null always starts one."""
    p = placed(rows, order)
    w = Window.partitionBy("__p").orderBy(*order)
    same = F.lag(key).over(w) == F.col(key)
    p = p.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    ends = p.groupBy("__p").agg(F.min_by(F.struct(F.col(key)), F.struct(*order)).alias("first"), F.max_by(F.struct(F.col(key)), F.struct(*order)).alias("last"), F.sum("__new").alias("new"))
    before, at, previous = {}, -1, None
    for r in sorted(ends.collect(), key=lambda r: r["__p"]):
        first = r["first"][0]
        at += not (previous is not None and first is not None and previous == first)
        before[r["__p"]] = at
        at += r["new"]
        previous = r["last"][0]
    return p.withColumn(out, (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + _lookup(before)).cast("long")).drop("__p", "__new")


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str], number: str) -> DataFrame:
    """rows with their number within a group (from 0) and running sums (value column -> result column), for groups of any size.

    A window by group would bring the largest group to one task. Here a group
    that spans ranges is taken up by the next range from a carried count and
    carried sums; only the first group of a range can need them, so the
    carried rows are as few as ranges.
    """
    p = placed(rows, [*by, *order])
    names = list(sums)
    key = F.struct(*by)
    per = p.groupBy("__p", *by).agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(v), F.lit(0)).alias(f"__s{i}") for i, v in enumerate(names)])
    value = F.struct("__n", *[f"__s{i}" for i in range(len(names))])
    ends = per.groupBy("__p").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(value, key).alias("total"))
    carried, open_key, held = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["__p"]):
        goes_on = open_key is not None and r["first"] == open_key
        if goes_on:
            carried.append((r["__p"], *r["first"], *held))
        one = r["first"] == r["last"]
        held = tuple(a + b for a, b in zip(held, r["total"], strict=True)) if goes_on and one else tuple(r["total"])
        open_key = r["last"]
    w = Window.partitionBy("__p", *by).orderBy(*order)
    found = p.withColumn(number, (F.row_number().over(w) - 1).cast("long"))
    for v in names:
        found = found.withColumn(sums[v], F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not carried:
        return found.drop("__p")
    kinds = dict(per.dtypes)
    schema = ", ".join([f"__p {kinds['__p']}", *(f"`{b}` {kinds[b]}" for b in by), "__n long", *(f"__s{i} {kinds[f'__s{i}']}" for i in range(len(names)))])
    carry = rows.sparkSession.createDataFrame(carried, schema)
    found = found.join(F.broadcast(carry), ["__p", *by], "left")
    found = found.withColumn(number, F.col(number) + F.coalesce("__n", F.lit(0)))
    for i, v in enumerate(names):
        found = found.withColumn(sums[v], F.col(sums[v]) + F.coalesce(f"__s{i}", F.lit(0)))
    return found.drop("__p", "__n", *[f"__s{i}" for i in range(len(names))])
