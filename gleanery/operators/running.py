"""Numbers and sums along an order, for groups of any size: no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.sources.tables import kept


def running_sums(rows: DataFrame, by: list[str], order: list[str | Column], values: dict[str, str | Column], name: str = "running", lasts: dict[str, str | Column] | None = None) -> DataFrame:
    """``rows`` with a column for each of ``values`` (name to long or decimal): its sum over the rows of the same ``by``, up to and with the row itself in ``order``; and one for each of ``lasts``: its last value, but null, in the rows before.

    Rows are dealt to ranges of (by, order) and written, so that every later step sees the same ranges; what a range
    holds and what the ranges before it add up to give the result. A group that fills many ranges meets in one task only as
    one row for each range. ``order`` has to be total for a defined result, and made of names of columns where there are
    ``lasts``; rows equal in all of it stay in one range. Null keys are a group; an empty table gives an empty one.
    """
    lasts = lasts or {}
    taken = {c.lower() for c in rows.columns} | {c.lower() for c in (*values, *lasts)}
    part, before = (next(n for n in (f"{'_' * k}{base}" for k in range(1, 99)) if n not in taken) for base in ("range", "before"))
    column = lambda v: F.col(v) if isinstance(v, str) else v
    ranged = rows.repartitionByRange(*by, *order) if by or order else rows
    ranged = kept(ranged.withColumns({part: F.spark_partition_id()} | {n: column(v) for n, v in (values | lasts).items()}), name)
    place = F.struct(*order) if lasts else None
    whole = [*(F.sum(n).alias(n) for n in values), *(F.max_by(n, F.when(F.col(n).isNotNull(), place)).alias(n) for n in lasts)]
    sums = ranged.groupBy(part, *by).agg(F.struct(*whole).alias(before))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = lambda n: F.col(before)[n]
    carried = [*(F.sum(held(n)).over(earlier).alias(n) for n in values), *(F.last(held(n), ignorenulls=True).over(earlier).alias(n) for n in lasts)]
    offsets = sums.select(F.col(part).alias(f"{part}_o"), *(F.col(c).alias(f"{before}_{k}") for k, c in enumerate(by)), F.count("*").over(earlier).alias(f"{before}_n"), F.struct(*carried).alias(before))
    offsets = offsets.where(F.col(f"{before}_n") > 0)  # groups begun in an earlier range: at most one for each range
    ordered = Window.partitionBy(part, *by).orderBy(*order)
    upto, prior = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({n: F.sum(n).over(upto) for n in values} | {n: F.last(n, ignorenulls=True).over(prior) for n in lasts})
    same = F.col(part) == F.col(f"{part}_o")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"{before}_{k}"))
    joined = local.join(F.broadcast(offsets), same, "left")
    out = [*((F.col(n) + F.coalesce(held(n), F.lit(0))).alias(n) for n in values), *(F.coalesce(F.col(n), held(n)).alias(n) for n in lasts)]
    return joined.select(*(c for c in rows.columns if c not in values and c not in lasts), *out)


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """``rows`` with ``row_number`` over (by, order), as a long, under ``name``."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("long")}, name)
