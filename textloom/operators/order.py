"""Order-dependent sums and numbers that don't gather a partition key's rows in one task."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.tables import written

#: Rows that a window may hold at least.
LEAST = 1000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def block(df: DataFrame, order: str = "pos") -> Column:
    """Ascending ranges of a whole-number column, about as many as each of them is wide, so that neither a window over a
    range nor one over all ranges grows with the table itself."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    return F.floor(F.col(order) / max(LEAST, isqrt((high or 0) - (low or 0))))


def positions(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with each row's rank from 0 in the order of any columns, such as ids of mixed length; ties in any order.

    Rows are dealt by ranges of the order and written once; ranges are counted and each rank is its range's offset more.
    """
    part, serial, offset = fresh(df, "part_", "serial_", "offset_")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({part: F.spark_partition_id(), serial: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(part).agg(F.count("*").alias(offset)).select(part, F.coalesce(F.sum(offset).over(earlier), F.lit(0)).alias(offset))
    # One row for each range, so small.
    return dealt.join(F.broadcast(ranges), part).withColumn(name, F.col(serial) + F.col(offset)).drop(part, serial, offset)


def sums_before(df: DataFrame, keys: list[str], order: str, bucket: Column | None = None, **values: Column) -> DataFrame:
    """df with, for each named value, the sum over the rows of the same keys that come before by ``order``.

    ``bucket`` cuts the order into ascending ranges, by default ``block`` of a whole-number column; rows are summed by
    range, ranges are summed in order, and a window runs within each range only, so a key with very many rows is shared
    by as many tasks as it has ranges.
    """
    at, other, *names = fresh(df, "bucket_", "other_", *(f"{kind}_{n}" for n in (*keys, *values) for kind in ("v", "base", "in")))
    own = {n: names[3 * k : 3 * k + 3] for k, n in enumerate((*keys, *values))}
    work = df.withColumn(at, block(df, order) if bucket is None else bucket).withColumns({own[n][0]: v for n, v in values.items()})
    totals = work.groupBy(*keys, at).agg(*[F.sum(own[n][0]).alias(own[n][0]) for n in values])
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(k).alias(own[k][0]) for k in keys], F.col(at).alias(other), *[F.coalesce(F.sum(own[n][0]).over(earlier), F.lit(0)).alias(own[n][1]) for n in values])
    inside = Window.partitionBy(*keys, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    work = work.withColumns({own[n][2]: F.coalesce(F.sum(own[n][0]).over(inside), F.lit(0)) for n in values})
    condition = F.col(at).eqNullSafe(F.col(other))
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(own[k][0]))
    out = work.join(bases, condition)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *[(F.col(own[n][2]) + F.col(own[n][1])).alias(n) for n in values])
