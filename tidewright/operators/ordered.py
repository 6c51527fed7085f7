"""Ordered-group functions (ranks, offsets, running totals, tiles) that survive hot groups.

A plain window puts a whole group into one task. That is the right plan while groups are
small. Groups above ``group_limit`` rows are instead cut into ordered slices by a range
shuffle: every slice is evaluated on its own, a small per-slice summary yields the offsets,
and the offsets are added back. Both routes give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import cut_lineage

GROUP_LIMIT = 5_000_000
GROUP_LIMIT_SETTING = "spark.tidewright.groupLimit"


@dataclass(frozen=True)
class Measure:
    """One output column. ``kind`` is one of the names handled below."""

    kind: str
    column: str | None = None
    default: object = None
    tiles: int = 0


def row_number() -> Measure:
    return Measure("row_number")


def rank() -> Measure:
    return Measure("rank")


def dense_rank() -> Measure:
    return Measure("dense_rank")


def percent_rank() -> Measure:
    return Measure("percent_rank")


def cume_dist() -> Measure:
    return Measure("cume_dist")


def ntile(tiles: int) -> Measure:
    return Measure("ntile", tiles=tiles)


def running_sum(column: str) -> Measure:
    return Measure("running_sum", column)


def lag(column: str, default=None) -> Measure:
    return Measure("lag", column, default)


def lead(column: str, default=None) -> Measure:
    return Measure("lead", column, default)


def first_value(column: str) -> Measure:
    return Measure("first_value", column)


def last_value(column: str) -> Measure:
    return Measure("last_value", column)


def ordered_measures(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    tie_break: list[str],
    measures: dict[str, Measure],
    group_limit: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``measures`` evaluated per ``keys`` group in ``order``.

    Ranks and distributions look at ``order`` only, so ties share a value; positional
    measures use ``order`` followed by ``tie_break``, which must make the order total.
    Both are column names; a leading ``-`` means descending. ``group_limit`` defaults to the
    session setting ``spark.tidewright.groupLimit``, else five million rows; 0 cuts every group
    into slices, of at most five million rows.
    """
    if group_limit is None:
        group_limit = int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING, str(GROUP_LIMIT)))
    hot = _hot_groups(df, keys, group_limit)
    if hot is None:
        return _plain(df, keys, order, tie_break, measures)
    if slices is None:  # no slice is planned above the limit, however large the hot groups are
        rows = hot.agg(F.sum("_n")).first()[0]
        slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2, -(-rows // (group_limit or GROUP_LIMIT)))
    hot = hot.drop("_n")
    if not keys:
        return _sliced(df, keys, order, tie_break, measures, slices)
    same_group = [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    on = reduce(lambda a, b: a & b, same_group)
    # At most total_rows / group_limit keys can be hot, so the list is small.
    hot = F.broadcast(hot).alias("h")
    cold_rows = df.alias("l").join(hot, on, "left_anti")
    hot_rows = df.alias("l").join(hot, on, "left_semi")
    return _plain(cold_rows, keys, order, tie_break, measures).unionByName(
        _sliced(hot_rows, keys, order, tie_break, measures, slices)
    )


def _hot_groups(df: DataFrame, keys: list[str], group_limit: int) -> DataFrame | None:
    """Keys holding more than ``group_limit`` rows and their count ``_n``, or None when there are none."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_limit)
    return None if counts.isEmpty() else cut_lineage(counts, "hot-groups")


def sort_columns(names: list[str]) -> list[Column]:
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in names]


def _plain(df, keys, order, tie_break, measures) -> DataFrame:
    order, tie_break = sort_columns(order), sort_columns(tie_break)
    group = Window.partitionBy(*keys)
    by_order = group.orderBy(*order)
    by_total = group.orderBy(*order, *tie_break)
    upto_here = by_total.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for name, m in measures.items():
        if m.kind == "row_number":
            out[name] = F.row_number().over(by_total).cast("long")
        elif m.kind == "rank":
            out[name] = F.rank().over(by_order).cast("long")
        elif m.kind == "dense_rank":
            out[name] = F.dense_rank().over(by_order).cast("long")
        elif m.kind == "percent_rank":
            out[name] = F.percent_rank().over(by_order)
        elif m.kind == "cume_dist":
            out[name] = F.cume_dist().over(by_order)
        elif m.kind == "ntile":
            out[name] = F.ntile(m.tiles).over(by_total).cast("long")
        elif m.kind == "running_sum":
            out[name] = F.sum(m.column).over(upto_here)
        elif m.kind == "lag":
            out[name] = F.lag(m.column, 1, m.default).over(by_total)
        elif m.kind == "lead":
            out[name] = F.lead(m.column, 1, m.default).over(by_total)
        elif m.kind == "first_value":
            out[name] = F.first(m.column).over(whole)
        elif m.kind == "last_value":
            out[name] = F.last(m.column).over(whole)
        else:
            raise ValueError(m.kind)
    return df.withColumns(out)


def _sliced(df, keys, order, tie_break, measures, slices) -> DataFrame:
    value_cols = sorted({m.column for m in measures.values() if m.column})
    tie_value = F.struct(*[F.col(name.lstrip("-")) for name in order])
    order, tie_break = sort_columns(order), sort_columns(tie_break)
    ranged = df.withColumn("_tie", tie_value).repartitionByRange(
        slices, *[F.col(k).asc() for k in keys], *order, *tie_break
    )
    # Partition ids are only stable within one execution: pin them on shared storage.
    rows = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()), "ordered-slices")

    local = Window.partitionBy(*keys, "_slice")
    by_order = local.orderBy(*order)
    by_total = local.orderBy(*order, *tie_break)
    upto_here = by_total.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_value = Window.partitionBy(*keys, "_slice", "_tie")
    located = rows.withColumns(
        {
            "_pos": F.row_number().over(by_total).cast("long"),
            "_rank": F.rank().over(by_order).cast("long"),
            "_dense": F.dense_rank().over(by_order).cast("long"),
            "_size": F.count(F.lit(1)).over(local),
        }
    ).withColumn("_run_end", F.max("_pos").over(same_value))
    for c in value_cols:
        located = located.withColumns(
            {
                f"_sum_{c}": F.sum(c).over(upto_here) if _is_summed(measures, c) else F.lit(None),
                f"_lag_{c}": F.lag(c, 1).over(by_total),
                f"_lead_{c}": F.lead(c, 1).over(by_total),
            }
        )
    located = cut_lineage(located, "ordered-located")

    at_head, at_tail = F.col("_pos") == 1, F.col("_pos") == F.col("_size")

    def pick(cond, col):
        return F.first(F.when(cond, F.struct(F.col(col).alias("x"))), ignorenulls=True)["x"]

    summary = located.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.max("_dense").alias("_values"),
        pick(at_head, "_tie").alias("_head"),
        pick(at_tail, "_tie").alias("_tail"),
        pick(at_head, "_run_end").alias("_head_end"),
        pick(at_tail, "_rank").alias("_tail_start"),
        *[pick(at_head, c).alias(f"_first_{c}") for c in value_cols],
        *[pick(at_tail, c).alias(f"_last_{c}") for c in value_cols],
        *[pick(at_tail, f"_sum_{c}").alias(f"_total_{c}") for c in value_cols],
    )
    # One row per (key, slice): never more than slices + number of hot keys.
    across = Window.partitionBy(*keys).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined_up = F.coalesce(F.lag("_tail").over(across) == F.col("_head"), F.lit(False)).cast("long")
    summary = summary.withColumns(
        {
            "_offset": F.coalesce(F.sum("_cnt").over(before), F.lit(0)),
            "_group": F.sum("_cnt").over(everything),
            "_joined": joined_up,
        }
    )
    summary = summary.withColumn(
        "_values_before",
        F.coalesce(F.sum(F.col("_values") - F.col("_joined")).over(before), F.lit(0)) - F.col("_joined"),
    )
    summary = summary.withColumns(
        {"_head_end": F.col("_head_end") + F.col("_offset"), "_tail_start": F.col("_tail_start") + F.col("_offset")}
    )
    extra = {}
    for c in value_cols:
        extra[f"_before_{c}"] = F.lag(f"_last_{c}").over(across)
        extra[f"_after_{c}"] = F.lead(f"_first_{c}").over(across)
        extra[f"_open_{c}"] = F.first(f"_first_{c}").over(everything)
        extra[f"_close_{c}"] = F.last(f"_last_{c}").over(everything)
        extra[f"_carry_{c}"] = F.sum(f"_total_{c}").over(before)
    summary = summary.withColumns(extra) if extra else summary
    # A value that runs over several slices starts where its first slice has it and ends
    # where its last slice has it.
    starts = summary.groupBy(*keys, F.col("_tail").alias("_v")).agg(F.min("_tail_start").alias("_v_start"))
    ends = summary.groupBy(*keys, F.col("_head").alias("_w")).agg(F.max("_head_end").alias("_w_end"))
    summary = _attach(summary, starts, keys, "_head", "_v", "left")
    summary = _attach(summary, ends, keys, "_tail", "_w", "left")
    offsets = summary.drop(
        "_cnt", "_values", "_joined", *[f"_{p}_{c}" for c in value_cols for p in ("first", "last", "total")]
    )
    offsets = cut_lineage(offsets.withColumnRenamed("_slice", "_at"), "ordered-offsets")
    located = _attach(located, F.broadcast(offsets), keys, "_slice", "_at", "inner")

    pos = F.col("_pos") + F.col("_offset")
    rank_here = F.when(
        F.col("_tie").eqNullSafe(F.col("_head")), F.coalesce(F.col("_v_start"), F.col("_offset") + 1)
    ).otherwise(F.col("_rank") + F.col("_offset"))
    end_here = F.when(
        F.col("_tie").eqNullSafe(F.col("_tail")), F.coalesce(F.col("_w_end"), F.col("_run_end") + F.col("_offset"))
    ).otherwise(F.col("_run_end") + F.col("_offset"))
    end_here = F.greatest(end_here, F.col("_run_end") + F.col("_offset"))
    n = F.col("_group")
    out = {}
    for name, m in measures.items():
        c = m.column
        if m.kind == "row_number":
            out[name] = pos
        elif m.kind == "rank":
            out[name] = rank_here
        elif m.kind == "dense_rank":
            out[name] = F.col("_dense") + F.col("_values_before")
        elif m.kind == "percent_rank":
            out[name] = F.when(n > 1, (rank_here - 1) / (n - 1)).otherwise(F.lit(0.0))
        elif m.kind == "cume_dist":
            out[name] = end_here / n
        elif m.kind == "ntile":
            out[name] = tile_of(pos, n, m.tiles)
        elif m.kind == "running_sum":
            carried = F.col(f"_carry_{c}")
            inside = F.col(f"_sum_{c}")
            out[name] = F.when(carried.isNull(), inside).otherwise(carried + F.coalesce(inside, F.lit(0)))
        elif m.kind == "lag":
            seen = F.when(F.col("_pos") > 1, F.col(f"_lag_{c}")).otherwise(F.col(f"_before_{c}"))
            out[name] = F.when(pos == 1, F.lit(m.default)).otherwise(seen)
        elif m.kind == "lead":
            seen = F.when(F.col("_pos") < F.col("_size"), F.col(f"_lead_{c}")).otherwise(F.col(f"_after_{c}"))
            out[name] = F.when(pos == n, F.lit(m.default)).otherwise(seen)
        elif m.kind == "first_value":
            out[name] = F.col(f"_open_{c}")
        elif m.kind == "last_value":
            out[name] = F.col(f"_close_{c}")
        else:
            raise ValueError(m.kind)
    return located.withColumns(out).select(*df.columns, *measures)


def _attach(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, how: str) -> DataFrame:
    """Null-safe join on ``keys`` and one more column pair, keeping the left names."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.col(left_on).eqNullSafe(F.col(right_on))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, how).drop(right_on, *[f"_r_{k}" for k in keys])


def tile_of(pos: Column, total: Column, tiles: int) -> Column:
    """Tile number of position ``pos`` out of ``total``; the first tiles take the remainder."""
    small = F.floor(total / tiles)
    bigger = total % tiles
    edge = bigger * (small + 1)
    return (
        F.when(pos <= edge, F.floor((pos - 1) / (small + 1)) + 1)
        .otherwise(bigger + F.floor((pos - edge - 1) / F.greatest(small, F.lit(1))) + 1)
        .cast("long")
    )


def _is_summed(measures, column) -> bool:
    return any(m.kind == "running_sum" and m.column == column for m in measures.values())
