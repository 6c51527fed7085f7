"""Row-changing statements as new-state DataFrames.

Parquet tables cannot be changed in place, so each function takes the current rows and
returns the rows after the statement. Persist the result with ``write_version``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_where(df: DataFrame, predicate: Column, assignments: dict[str, Column]) -> DataFrame:
    """UPDATE .. SET .. WHERE: rows whose predicate is false or NULL keep their values."""
    changed = {c: F.when(predicate, v).otherwise(F.col(c)) for c, v in assignments.items()}
    return df.withColumns(changed)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """DELETE .. WHERE: only rows whose predicate is true go away."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def affected_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Row count the statement would report, next to the rows it leaves."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.agg(F.count_if(hit).alias("affected"), F.count_if(~hit).alias("remaining"))


def repeated_keys(source: DataFrame, keys: list[str]) -> DataFrame:
    return source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """MERGE: matched rows take the source values, unmatched source rows are inserted.

    One full outer join on the key. A key repeated in the source makes the statement
    ambiguous and is refused, as the SQL statement would be.
    """
    if check and not repeated_keys(source, keys).isEmpty():
        raise ValueError(f"source has repeated keys in {keys}")
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = source.withColumn("_in_source", F.lit(True)).alias("s")
    joined = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full")
    given = F.col("s._in_source").isNotNull()
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c))
        elif c in source.columns:
            out.append(F.when(given, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return joined.select(*out)


def apply_deltas(accounts: DataFrame, deltas: DataFrame, key: str, balance: str, delta: str) -> DataFrame:
    """Several balance changes of one transaction in a single pass; other rows stay as they are."""
    per_key = deltas.groupBy(key).agg(F.sum(delta).alias("_delta"))
    moved = accounts.join(per_key, key, "left")
    return moved.withColumn(balance, F.col(balance) + F.coalesce(F.col("_delta"), F.lit(0))).drop("_delta")


def scd2(dimension: DataFrame, incoming: DataFrame, key: str, tracked: list[str], as_of: Column) -> DataFrame:
    """Slowly changing dimension, type 2.

    ``dimension`` has the key, the tracked columns, ``valid_from``, ``valid_to`` and
    ``is_current``. Changed or new incoming rows open a version at ``as_of``; the version they
    replace is closed at the same moment. Column values are compared null-safely, not by hash,
    so two different rows can never pass as equal.
    """
    history = dimension.filter(~F.col("is_current"))
    current = dimension.filter(F.col("is_current"))
    # One join yields, per current or incoming key, both the row to close and the row to open.
    joined = current.alias("d").join(incoming.alias("n"), F.col(f"d.{key}") == F.col(f"n.{key}"), "full")
    has_old, has_new = F.col(f"d.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}"))
    changed = has_old & has_new & ~same

    def version(side, start, end, live):
        fields = [F.col(f"{side}.{c}").alias(c) for c in (key, *tracked)]
        return F.struct(*fields, start.alias("valid_from"), end.alias("valid_to"), live.alias("is_current"))

    never = F.lit(None).cast(dimension.schema["valid_to"].dataType)
    kept = F.when(
        has_old,
        version("d", F.col("d.valid_from"), F.when(changed, as_of).otherwise(F.col("d.valid_to")), ~changed),
    )
    opened = F.when(has_new & (~has_old | changed), version("n", as_of, never, F.lit(True)))
    versions = joined.select(F.explode(F.array_compact(F.array(kept, opened))).alias("v")).select("v.*")
    return history.select(*versions.columns).unionByName(versions)
