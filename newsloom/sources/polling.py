"""What is new in documents that are fetched again and again: changed pages, unseen items, pages still to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ordered import with_last


def changed_documents(fetches: DataFrame, *, url: str, fetched: str, body: str, tie: str) -> DataFrame:
    """Fetches whose body differs from the one fetched before from that address; the first always counts, null bodies (not modified) never.

    Bodies are compared by 128-bit digest; of fetches at one time ``tie`` gives the order.
    """
    x = with_last(fetches.where(F.col(fetched).isNotNull() & F.col(body).isNotNull()), keys=[url], time=fetched, tie=[tie], value=F.md5(F.col(body)), name="_was")
    return x.where(~F.md5(F.col(body)).eqNullSafe(F.col("_was"))).drop("_was")


def unseen_items(items: DataFrame, *, feed: str, poll: str, id_col: str, backlog: bool = False) -> DataFrame:
    """(feed, id_col, poll): each item at the first poll of its feed that shows it. The first poll of a feed only tells what is old, unless ``backlog``.

    Null feeds, polls and ids take no part. Two aggregations; no poll is compared with another.
    """
    x = items.where(F.col(feed).isNotNull() & F.col(poll).isNotNull() & F.col(id_col).isNotNull())
    seen = x.groupBy(feed, id_col).agg(F.min(poll).alias(poll))
    if backlog:
        return seen
    first = x.groupBy(feed).agg(F.min(poll).alias("_first"))
    return seen.join(first, feed).where(F.col(poll) > F.col("_first")).drop("_first")


def still_to_fetch(asked: DataFrame, pages: DataFrame, misses: DataFrame, *, url: str) -> DataFrame:
    """Distinct addresses that have neither a page nor a recorded miss."""
    return asked.select(url).where(F.col(url).isNotNull()).distinct().join(pages.select(url).unionByName(misses.select(url)).distinct(), url, "left_anti")
