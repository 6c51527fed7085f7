"""Repeatable sampling: every choice is a hash of the row's id, never a random number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ranking import top_n_per_group
from tidewright.session import cut_lineage


#: Quotas of rows that the first draw expects, and rows besides; fewer mean another draw more often.
AIM, SPARE = 1.5, 4


def hash_order(seed: str, id_column: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit("|"), F.col(id_column).cast("string")))


def keep_share(df: DataFrame, fraction: float, seed: str, id_column: str) -> DataFrame:
    """Rows whose hash falls in the first ``fraction`` of its range (steps of 2**-60): 0 keeps none, 1 keeps all."""
    return df.filter(in_share(fraction, seed, id_column))


def in_share(fraction: float, seed: str, id_column: str) -> Column:
    if not 0 <= fraction <= 1:
        raise ValueError(f"a fraction is between 0 and 1, not {fraction}")
    return place_of(seed, id_column) < F.lit(int(fraction * 2**60))


def place_of(seed: str, id_column: str) -> Column:
    """The hash of a row's id as a number below 2**60; rows sort by it as by ``hash_order``, but for ties."""
    digits = F.substring(F.coalesce(hash_order(seed, id_column), F.md5(F.lit(seed))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def quota_sample(df: DataFrame, strata: list[str], quotas: DataFrame, seed: str, id_column: str) -> DataFrame:
    """Per stratum the ``quota`` rows first in hash order; a short stratum gives all it has.

    ``quotas`` holds one row per stratum, a fixed list, so it is broadcast. A count per stratum gives the share of the hash range in which about ``AIM`` quotas of rows are
    expected. Rows beyond it are left out where they are read, so what is shuffled and ranked is a small multiple of the quotas, however large the strata. A stratum
    that chance leaves short is drawn again from twice the range, until it is full or all of it was read.
    """
    kept = [*df.columns, "quota"]
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"))
    wanted = cut_lineage(F.broadcast(quotas).join(sizes, strata).withColumn("_wanted", F.least("quota", "_size")), "quotas")
    parts, aim = [], AIM
    while True:
        chosen = cut_lineage(first_in_hash_order(df, strata, wanted, seed, id_column, aim), "sample")
        parts.append(chosen)
        short = wanted.join(chosen.groupBy(*strata).agg(F.count(F.lit(1)).alias("_got")), strata, "left")
        short = cut_lineage(short.filter(F.coalesce("_got", F.lit(0)) < F.col("_wanted")).drop("_got"), "short")
        if short.isEmpty():
            break
        parts[-1] = chosen.join(F.broadcast(short.select(*strata)), strata, "left_anti")
        wanted, aim = short, 2 * aim
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select(*kept).drop("quota")


def first_in_hash_order(df: DataFrame, strata: list[str], wanted: DataFrame, seed: str, id_column: str, aim: float) -> DataFrame:
    """The first ``quota`` rows of each stratum among those in the first part of the hash range that holds about ``aim`` quotas."""
    share = F.least(F.lit(1.0), (aim * F.col("quota") + SPARE) / F.col("_size"))
    cuts = wanted.withColumn("_cut", (share * float(2**60)).cast("long")).drop("_wanted", "_size")
    near = df.join(F.broadcast(cuts), strata).filter(place_of(seed, id_column) < F.col("_cut")).drop("_cut").withColumn("_order", hash_order(seed, id_column))
    largest = wanted.agg(F.max("quota")).first()[0] or 0
    ranked = top_n_per_group(near, strata, [F.col("_order"), F.col(id_column)], largest)
    return ranked.filter(F.col("rn") <= F.col("quota")).drop("_order", "rn")


def quota_report(df: DataFrame, strata: list[str], quotas: DataFrame) -> DataFrame:
    have = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("have"))
    filled = F.broadcast(quotas).join(have, strata, "left").fillna({"have": 0})
    return filled.withColumnRenamed("quota", "need").withColumn("taken", F.least("need", "have"))
