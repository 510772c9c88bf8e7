"""Joins to a table of keys in which a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Keys up to which their table is broadcast whole.
BROADCAST_KEYS = 100_000
#: Beyond it, keys with more than this share of all rows are hot; there are at most so many of them, whatever the size.
HOT_KEYS = 4096
#: Rows of numbers up to which a saved table that documents are looked up in is broadcast.
BROADCAST_IDS = 500_000


def looked_up(table: DataFrame) -> DataFrame:
    """A saved table of document numbers, marked for broadcast if it is small; the documents then stay where they are."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def join_keys(rows: DataFrame, keys: DataFrame, key: str, total: int, most: int | None = None) -> DataFrame:
    """``rows`` joined with ``keys``, which has one row per ``key`` and in ``n`` at least the number of its rows.

    The sum of ``n`` must not exceed ``total``, so fewer than HOT_KEYS keys are hot.  A small table of
    keys is broadcast; of a larger one the hot keys are, and their rows stay where they are, while the
    rows of all other keys are shuffled: no task gets more than a small share of them by one key.
    ``most`` is a bound of the number of keys, where one is known; else the keys are saved first, so that
    numbers that ``monotonically_increasing_id`` gives them hold.  ``n`` is dropped; rows whose key is
    null or unknown are left out.
    """
    if most is not None and most <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys.drop("n")), key)
    keys = scratch.save(keys, "keys")
    hot = F.col("n") > max(1, total // HOT_KEYS)
    sizes = keys.agg(F.count("*").alias("all"), F.count_if(hot).alias("hot")).first()
    if sizes["all"] <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys.drop("n")), key)
    if not sizes["hot"]:
        return rows.join(keys.drop("n"), key)
    most_used = F.broadcast(keys.where(hot).drop("n"))
    rest = rows.join(F.broadcast(keys.where(hot).select(key)), key, "left_anti")
    return rows.join(most_used, key).unionByName(rest.join(keys.where(~hot).drop("n"), key))


def add_least(rows: DataFrame, key: str, value: str, out: str, total: int) -> DataFrame:
    """Add the least ``value`` of each ``key`` to its rows, of which there are ``total`` at most."""
    found = rows.groupBy(key).agg(F.min(value).alias(out), F.count("*").alias("n"))
    return join_keys(rows, found, key, total, most=total)
