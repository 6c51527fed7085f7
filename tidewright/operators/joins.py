"""Joins with a stated strategy: size-checked broadcast, salting, null guards, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import cut_lineage, fresh_name, scratch_path

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Rows of one key that a task takes; most keys that are salted; items a sketch tracks.
HOT_ROWS = 1_000_000
HOT_KEYS = 1_000
SKETCH_ITEMS = 10_000


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``limit`` rows and ``limit_bytes`` (written as JSON); reads no more than limit + 1 rows."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, written = df.limit(limit + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= limit and (written or 0) <= limit_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint after a check of rows and bytes; a larger side keeps the shuffle join."""
    return F.broadcast(df) if small_enough(df, limit, limit_bytes) else df


def small_cross_join(left: DataFrame, right: DataFrame, limit: int = 10_000) -> DataFrame:
    """Cartesian product allowed only when one side is a proven small list."""
    if small_enough(right, limit):
        return left.crossJoin(F.broadcast(right))
    if small_enough(left, limit):
        return F.broadcast(left).crossJoin(right)
    raise ValueError(f"cross join needs one side of at most {limit} rows")


def salted_join(
    big: DataFrame, other: DataFrame, key: str, row_id: list[str], salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Join on ``key`` with the big side's rows of one key spread over ``salts`` parts.

    The salt is a hash of the row's own id, so a retried task produces the same parts.
    ``other`` is repeated once per salt; only inner, left and semi/anti joins keep their
    meaning under that repetition. The join is always a shuffle join: the optimizer estimates
    ``other`` by its files, without the repetition, and would broadcast all copies.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting does not preserve a {how} join")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.hint("merge").join(right, [key, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, key: str, limit: int, most: int = HOT_KEYS) -> DataFrame:
    """Keys with more than ``limit`` rows and their exact count: ``(key, n)``, at most ``most`` rows, nulls left out.

    A sketch of fixed size per task names the candidates, so no row is shuffled to find them; only the candidates are counted. The sketch misses no key with more than
    about a thousandth of the rows at the default size; a key it misses stays an ordinary one.
    """
    sketch = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {most}, {SKETCH_ITEMS})").alias("top"))
    likely = sketch.select(F.explode("top").alias("t")).filter(F.col("t.count") > limit).select(F.col("t.item").alias(key))
    counted = df.select(key).join(F.broadcast(likely), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > limit)


def hot_key_join(big: DataFrame, other: DataFrame, key: str, row_id: list[str], limit: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """Join on ``key`` in which only the keys with more than ``limit`` rows on the big side are salted.

    Each gets as many salts as its count asks for, so its rows come in parts of about ``limit``, and only its rows of ``other`` are repeated, once per salt. All other rows
    are joined as they are. Meant for hot keys that ``other`` holds few rows of; inner, left, semi and anti joins only. A shuffle join, as in ``salted_join``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting does not preserve a {how} join")
    hot = cut_lineage(hot_keys(big, key, limit), "hot-keys")  # at most HOT_KEYS rows
    salts = F.broadcast(hot.select(key, F.ceil(F.col("n") / limit).cast("int").alias("_salts")))
    drawn = F.pmod(F.xxhash64(*row_id), F.col("_salts")).cast("int")
    left = big.join(salts, key, "left").withColumn("_salt", F.coalesce(drawn, F.lit(0))).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    right = other.join(salts, key, "left").withColumn("_salt", copies).drop("_salts")
    return left.hint("merge").join(right, [key, "_salt"], how).drop("_salt")


def null_guarded_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join whose null keys never reach the shuffle.

    Inner and semi joins drop them on both sides. A left join must keep the left rows with a
    null key, so those are set aside and added back with nulls for the right columns.
    """
    solid_left = left.filter(F.col(key).isNotNull())
    solid_right = right.filter(F.col(key).isNotNull())
    joined = solid_left.join(solid_right, key, how)
    if how in ("inner", "left_semi"):
        return joined
    if how in ("left", "left_anti"):
        return joined.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
    raise ValueError(f"no null guard for a {how} join")


def full_join_by_parts(big: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Full outer join as a left join plus the unmatched rest.

    AQE splits the rows of a hot key in a left join, but not in a full one. The rest needs only
    the distinct keys of the big side.
    """
    matched = big.join(other, key, "left")
    rest = other.join(big.select(key).distinct(), key, "left_anti")
    return matched.unionByName(rest, allowMissingColumns=True)


def write_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> str:
    """Save ``df`` as a table bucketed and sorted by ``key``; returns its name."""
    name = fresh_name(label)
    writer = df.write.bucketBy(buckets, key).sortBy(key).format("parquet")
    writer.option("path", scratch_path(df.sparkSession, name)).saveAsTable(name)
    return name


def bucketed_join(spark: SparkSession, left_table: str, right_table: str, left_key: str, right_key: str) -> DataFrame:
    """Join two tables bucketed alike on the join key: no exchange on either side."""
    left, right = spark.table(left_table), spark.table(right_table)
    return left.hint("merge").join(right, left[left_key] == right[right_key])
