"""Ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that a global order is cut into at least, and rows that a range holds on average at most.
RANGES, RANGE_ROWS = 64, 500_000


def ranges_for(df: DataFrame) -> int:
    """How many ranges a table's order takes."""
    return max(RANGES, -(-df.count() // RANGE_ROWS))


def _range_of(x: Column, edges: list[float], low: int = 0, high: int | None = None) -> Column:
    """How many edges are at most x, as a binary search written out: generated code, few comparisons."""
    high = len(edges) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x < edges[mid], _range_of(x, edges, low, mid)).otherwise(_range_of(x, edges, mid + 1, high))


def _split_ties(df: DataFrame, value: str, ids: list[str], at: Column, hot: list[float], ranges: int, descending: bool) -> Column:
    """Range numbers in the order of the rows, where each of the ``hot`` values has ranges of its own, cut by id.

    ``at``: the ranges, each starting at its least value, numbered in that order.
    """
    kind = df.schema[ids[0]].dataType if ids else None
    if not hot or not isinstance(kind, T.NumericType):
        return at
    tied = F.coalesce(F.col(value).isin(hot), F.lit(False))
    cuts = sorted(set(df.where(tied).approxQuantile(ids[0], [i / ranges for i in range(1, ranges)], min(0.01, 0.5 / ranges))))
    # A hot value is the least of its range, so the rest of that range comes after it, or before it in descending order.
    rest = F.lit(0 if descending else len(cuts) + 1)
    return at * (len(cuts) + 2) + F.when(tied, _range_of(F.col(ids[0]), cuts) + (1 if descending else 0)).otherwise(rest)


def with_running_sum(
    df: DataFrame, value: str, ids: list[str], size: Column, out: str, descending: bool = False, ranges: int | None = None, by: list[str] | None = None
) -> DataFrame:
    """Add the sum of ``size`` over rows up to and including each, in the order of value, then ids.

    Approximate quantiles cut the values into ranges; range totals give each range its start, and a
    window runs inside a range only. The result doesn't depend on where the cuts fall. Nulls come last. A value that takes several
    ranges is cut by the first of the ids, if that is a number. With ``by`` the
    sums run within each group. The number of ranges grows with the table.
    """
    by = by or []
    ranges = ranges or ranges_for(df)
    found = df.approxQuantile(value, [i / ranges for i in range(1, ranges)], min(0.01, 0.5 / ranges)) if ranges > 1 else []
    edges = sorted(set(found))
    at = _range_of(F.col(value), edges)
    at = F.when(F.col(value).isNull(), 1 if descending else len(edges) + 1).otherwise(-at if descending else at)  # nulls last, by themselves
    at = _split_ties(df, value, ids, at, [e for e in edges if found.count(e) > 1], ranges, descending)
    df = df.withColumn("_range", at).withColumn("_size", size)
    totals = df.groupBy(*by, "_range").agg(F.sum("_size").alias("_total"))
    start = F.sum("_total").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*by, "_range", F.coalesce(start, F.lit(0)).alias("_start"))  # as many rows as ranges, for each group
    order = [F.col(value).desc() if descending else F.col(value).asc(), *ids]
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = totals if by else F.broadcast(totals)
    out_df = df.join(totals, [*by, "_range"]).withColumn(out, F.col("_start") + F.sum("_size").over(within))
    return out_df.drop("_range", "_size", "_start")


def with_rank(
    df: DataFrame, value: str, ids: list[str], out: str = "rk", descending: bool = False, ranges: int | None = None, by: list[str] | None = None
) -> DataFrame:
    """Add the row's number in the order of value, then ids, counted over the whole table (or group) from 1."""
    return with_running_sum(df, value, ids, F.lit(1).cast("long"), out, descending, ranges, by)


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``(by..., q)``: exact quantiles with linear interpolation, nulls left out, as an array in the order of ``qs``.

    Equal values are counted first, then ranked by ranges, so that neither a task nor an aggregation
    buffer holds a whole column: the built-in exact percentile keeps every distinct value in one buffer.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = with_running_sum(counts, value, [], F.col("_n"), "_upto", ranges=ranges, by=by)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    rows = upto.join(sizes, by) if by else upto.crossJoin(F.broadcast(sizes))
    pos = [F.lit(q) * (F.col("_all") - 1) for q in qs]
    has = lambda p: (p >= F.col("_upto") - F.col("_n")) & (p <= F.col("_upto") - 1)
    ends = [F.max(F.when(has(e(p)), F.col(value))) for p in pos for e in (F.floor, F.ceil)]
    got = rows.groupBy(*by).agg(F.max("_all").alias("_all"), *(c.alias(f"_e{i}") for i, c in enumerate(ends)))
    mixed = [F.col(f"_e{2 * i}") + (p - F.floor(p)) * (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}")) for i, p in enumerate(pos)]
    return got.select(*by, F.array(*mixed).alias("q"))
