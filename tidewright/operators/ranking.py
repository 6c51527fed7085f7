"""Top-N and best-row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordered import ordered_measures, row_number

SALTS = 32


def top_n_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    spread_by: list[str] | None = None,
    rank_name: str = "rn",
) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must be total.

    Spark already cuts each map partition to ``n`` rows per group before the shuffle
    (WindowGroupLimit). With ``spread_by`` a hot group is first reduced in several salted
    parts, so the last step never sees more than ``SALTS * n`` rows of one group.
    """
    if spread_by:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    group = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(rank_name, F.row_number().over(group))
    return numbered.filter(F.col(rank_name) <= n).withColumn(rank_name, F.col(rank_name).cast("long"))


def best_rows_with_ties(df: DataFrame, keys: list[str], order: list[str], rank_name: str = "rnk") -> DataFrame:
    """Every row of rank 1 by ``order`` (a leading ``-`` means descending), ties kept.

    The best value per key is an aggregate with map-side combining; the rows are found by a
    join on it. Unlike a rank window no task has to hold all tied rows of a hot key: AQE can
    split that key's rows, the other side being a single row.
    """
    best, on = df, None
    for i, name in enumerate(order):
        column = name.lstrip("-")
        pick = F.max(column) if name.startswith("-") else F.min(column)
        # Later order columns count only among rows that tie on the earlier ones.
        top = best.groupBy(*keys).agg(pick.alias(f"_best{i}"), F.count_if(F.col(column).isNull()).alias("_nulls"))
        if not name.startswith("-"):  # ascending order puts NULL first
            top = top.withColumn(f"_best{i}", F.when(F.col("_nulls") == 0, F.col(f"_best{i}")))
        top = top.drop("_nulls").withColumnsRenamed({k: f"_k_{k}" for k in keys})
        on = F.col(column).eqNullSafe(F.col(f"_best{i}"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        best = best.join(top, on).drop(f"_best{i}", *[f"_k_{k}" for k in keys])
    return best.withColumn(rank_name, F.lit(1).cast("long"))


def first_per_key(df: DataFrame, keys: list[str | Column], order_fields: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order_fields``, carrying ``keep``.

    An aggregate, not a window: map-side combining leaves one row per key and task, so a
    key holding a third of the table costs no more than any other.
    """
    picked = F.min(F.struct(*order_fields, *[c for c in keep if c not in order_fields]))
    return df.groupBy(*keys).agg(picked.alias("_pick")).select("*", "_pick.*").drop("_pick")


def bounded_lists(df: DataFrame, keys: list[str], value: str, order: list[str], limit: int) -> DataFrame:
    """Values of each group as arrays of at most ``limit`` elements: ``(keys, piece, values)``.

    A VARRAY has a declared size; a group beyond it continues in the next piece, so no group,
    however large, has to fit into one array.
    """
    placed = ordered_measures(df.select(*keys, value), keys, order, [], {"_at": row_number()})
    piece = F.floor((F.col("_at") - 1) / limit).alias("piece")
    listed = placed.groupBy(*keys, piece).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_cells"))
    return listed.select(*keys, "piece", F.transform("_cells", lambda c: c[value]).alias("values"))
