"""Joins between posts, authors and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .filters import search
from .keyed import cascade
from .ranking import first_per_group


def author_lookup(posts: DataFrame, users: DataFrame, order_by: list) -> DataFrame:
    """Add `username` from a users table (first row per id), `unknown` if absent.

    Users are unique after the cut, so a hot author skews the posts' side only;
    Spark splits that side at run time.
    """
    known = first_per_group(users, ["author_id"], order_by).select("author_id", "username")
    joined = posts.join(known, "author_id", "left")
    return joined.withColumn("username", F.coalesce("username", F.lit("unknown")))


def posts_with_signal(posts: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    return posts.join(signals.select(key), key, "left_semi")


def join_signals(posts: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """Posts with the columns of their signal, one to one."""
    own = [c for c in signals.columns if c == key or c not in posts.columns]
    return posts.join(signals.select(*own), key, "inner")


def search_signals(
    signals: DataFrame, posts: DataFrame, query: str, key: str,
    fields: tuple[str, ...] = ("username", "content"),
) -> DataFrame:
    """Signals whose post matches; posts are searched before the join."""
    return cascade(signals, search(posts, query, list(fields)), key)

