"""MERGE, DELETE and SCD 2 on stored tables, rewriting only the partitions they touch.

A table is a folder of Parquet files partitioned by one column. A statement first finds which partitions it touches: those the change set names, and those of matched rows, which a
semi-join on the key columns alone finds (map-side while the change keys are few). Only these are read, joined and replaced by a dynamic partition overwrite; the
rest of the target is neither read in full nor shuffled nor written.

New rows are written to the shared folder before the swap, so a failed swap can be repeated from them, and the counts a statement reports come from the same pass
(an observation on that write), not from another scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.changes import repeated_keys
from tidewright.operators.joins import broadcast_if_small
from tidewright.session import cut_lineage, scratch_path
from tidewright.sources.writers import overwrite_partitions

NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class StoredTable:
    """A partitioned folder; the schema is given because values in folder names have lost their type."""

    spark: SparkSession
    path: str
    schema: object
    partition: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def store(df: DataFrame, path: str, partition: str) -> StoredTable:
    """Write ``df`` as a partitioned table; a partition that holds much is spread over files."""
    df.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)
    return StoredTable(df.sparkSession, path, df.schema, partition)


def values_of(df: DataFrame, column: str) -> list:
    """The distinct partition values in ``df``: as many as folders, which the driver lists for every read."""
    return [r[0] for r in df.select(column).distinct().collect()]


def in_partitions(table: StoredTable, touched: list) -> DataFrame:
    """The rows of some partitions. A literal list, so that the others are pruned before files are listed."""
    solid = [v for v in touched if v is not None]
    wanted = F.col(table.partition).isin(solid) if solid else F.lit(False)
    if None in touched:
        wanted = wanted | F.col(table.partition).isNull()
    return table.rows().filter(wanted)


def replace_partitions(table: StoredTable, touched: list, new_rows: DataFrame, counts: dict[str, Column] | None = None) -> dict[str, int]:
    """Put ``new_rows`` in place of the rows of the ``touched`` partitions; returns ``counts`` as seen in that pass.

    Columns that only ``counts`` needs start with ``_`` and are left out of the table. A partition without new rows is removed, which a dynamic overwrite would leave as it was.
    """
    seen = Observation()
    observed = new_rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (counts or {}).items()])
    keep = F.col("_keep") if "_keep" in new_rows.columns else F.lit(True)
    pinned = scratch_path(table.spark, "touched")
    observed.filter(keep).select(*table.schema.fieldNames()).write.parquet(pinned)
    stored = table.spark.read.schema(table.schema).parquet(pinned)
    filled = values_of(stored, table.partition)
    if filled:
        overwrite_partitions(stored.hint("rebalance", table.partition), table.path, [table.partition])
    for value in touched:
        if value not in filled:
            _remove_partition(table, value)
    return {name: seen.get[name] for name in (counts or {})}


def _remove_partition(table: StoredTable, value) -> None:
    escape = table.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = table.spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/{table.partition}={NULL_FOLDER if value is None else escape(str(value))}")
    folder.getFileSystem(table.spark._jsc.hadoopConfiguration()).delete(folder, True)


def merge_into(table: StoredTable, source: DataFrame, keys: list[str], insert: bool = True, check: bool = True) -> dict[str, int]:
    """MERGE: matched rows take the source's columns, other source rows are inserted; returns rows updated and inserted.

    Columns the source lacks keep their value in matched rows and are null in inserted ones. Null keys match nothing. A key that the source
    repeats is refused. An update may move a row to another partition. While the source is small enough to broadcast, no row of the target is shuffled.
    """
    if check and not repeated_keys(source.na.drop(subset=keys), keys).isEmpty():
        raise ValueError(f"source has repeated keys in {keys}")
    columns = list(dict.fromkeys([*keys, table.partition]))
    matched = table.rows().select(*columns).join(broadcast_if_small(source.select(*keys).distinct()), keys, "left_semi")
    matched = cut_lineage(matched.distinct(), "matched")  # keys and partitions only, no more rows than keys in the source hold
    inserts = source.join(matched.select(*keys).distinct(), keys, "left_anti") if insert else source.limit(0)
    placed = source if insert else source.join(matched.select(*keys).distinct(), keys, "left_semi")
    touched = set(values_of(matched, table.partition))
    touched |= set(values_of(placed, table.partition)) if table.partition in source.columns else {None} if insert else set()
    touched = sorted(touched, key=lambda v: (v is not None, str(v)))
    new_rows = merged_rows(table, touched, source, keys).unionByName(
        inserts.select(*[F.col(c) if c in source.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.schema.fieldNames()], F.lit(False).alias("_updated"), F.lit(True).alias("_inserted"))
    )
    return replace_partitions(table, touched, new_rows, {"updated": F.count_if("_updated"), "inserted": F.count_if("_inserted")})


def merged_rows(table: StoredTable, touched: list, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the touched partitions after the update half of a merge, and whether each was updated."""
    new = broadcast_if_small(source.withColumn("_new", F.lit(True))).alias("s")
    old = in_partitions(table, touched).alias("t")
    joined = old.join(new, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "left")
    matched = F.col("s._new").isNotNull()
    taken = [F.when(matched, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in source.columns and c not in keys else F.col(f"t.{c}").alias(c) for c in table.schema.fieldNames()]
    return joined.select(*taken, matched.alias("_updated"), F.lit(False).alias("_inserted"))


def delete_from(table: StoredTable, predicate: Column) -> dict[str, int]:
    """DELETE .. WHERE with its row count: only rows whose predicate is true go, a null predicate keeps its row."""
    hit = F.coalesce(predicate, F.lit(False))
    touched = values_of(table.rows().filter(hit), table.partition)
    if not touched:
        return {"deleted": 0}
    marked = in_partitions(table, touched).withColumn("_keep", ~hit)
    return replace_partitions(table, touched, marked, {"deleted": F.count_if(~F.col("_keep"))})


def scd2_into(table: StoredTable, incoming: DataFrame, key: str, tracked: list[str], as_of: Column, place: Callable[[Column], Column]) -> dict[str, int]:
    """Slowly changing dimension, type 2, on a stored dimension; returns versions closed and opened.

    The table has the key, the tracked columns, ``valid_from``, ``valid_to``, ``is_current`` and its partition column, which ``place`` derives from the key, so that a key's
    versions lie in one partition. Keys that differ from their current version are found by a join inside partitions; only partitions with
    such keys are rewritten.
    """
    placed = incoming.select(key, *tracked).withColumn(table.partition, place(F.col(key)))
    current = table.rows().filter("is_current").select(key, *tracked, table.partition)
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"d.{c}")) for c in tracked]
    unchanged = F.col(f"n.{table.partition}") == F.col(f"d.{table.partition}")
    for condition in (F.col(f"n.{key}") == F.col(f"d.{key}"), *same):
        unchanged = unchanged & condition
    path = scratch_path(table.spark, "changed")
    placed.alias("n").join(current.alias("d"), unchanged, "left_anti").write.parquet(path)
    changed = table.spark.read.schema(placed.schema).parquet(path)
    touched = values_of(changed, table.partition)
    if not touched:
        return {"closed": 0, "opened": 0}
    keyed = changed.select(F.col(key).alias("_key")).distinct().withColumn("_changed", F.lit(True))
    old = in_partitions(table, touched)
    closes = F.col("is_current") & F.col("_changed").isNotNull()
    old = old.join(keyed, old[key] == keyed["_key"], "left").withColumn("_closes", closes)
    old = old.withColumns({"valid_to": F.when(F.col("_closes"), as_of).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~F.col("_closes")})
    opened = changed.withColumns({"valid_from": as_of, "valid_to": F.lit(None), "is_current": F.lit(True), "_closes": F.lit(False)})
    kinds = {f.name: f.dataType for f in table.schema}
    names = [c for c in table.schema.fieldNames()]

    def typed(df: DataFrame, opens: bool) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names], "_closes", F.lit(opens).alias("_opens"))

    new_rows = typed(old, False).unionByName(typed(opened, True))
    return replace_partitions(table, touched, new_rows, {"closed": F.count_if("_closes"), "opened": F.count_if("_opens")})
