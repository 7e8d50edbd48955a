"""Duplicates hidden by formatting differences.

Records are reduced to a canonical key. Keys held by more rows than one task
should see are found exactly from partial counts; their minimum is taken in two
levels over salts and broadcast back (their number is bounded by rows / limit).
All other keys go through one shuffle, in which a window finds the minimum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import cut, shuffle_partitions

#: A key with more rows than this is salted.
HOT_ROWS = 50_000


def canonical_title(c: Column) -> Column:
    """Words in order, folded and parted by one space.

    Letters, marks and digits make words; a point between digits belongs to its
    number; ``$`` and ``%`` are words of their own; all else only separates. Flat
    patterns throughout, so that a very long title cannot exhaust the stack.
    """
    x = F.lower(F.upper(c))
    x = F.regexp_replace(x, r"(?<!\p{N})\.|\.(?!\p{N})", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}.$%]+", " ")
    x = F.regexp_replace(x, r"([$%])", r" $1 ")
    return F.trim(F.regexp_replace(x, " +", " "))


def canonical_link(c: Column) -> Column:
    """Address and sorted set of query fields, folded, without doubled or closing separators."""
    x = F.regexp_replace(F.lower(F.upper(c)), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    x = F.regexp_replace(x, r"[/?&#]+$|(?<=\?)\?+", "")
    address = F.regexp_replace(F.regexp_replace(F.substring_index(x, "?", 1), "/{2,}", "/"), "/+$", "")
    query = F.when(F.locate("?", x) > 0, F.substring(x, F.locate("?", x) + 1, F.length(x))).otherwise("")
    fields = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(query, "/+$", ""), "&"), lambda f: f != "")))
    return F.concat_ws("&", F.concat(address, F.lit("?")), fields)


def keyed_copies(df: DataFrame, *, id_col: str, parts: list[tuple[Column, Column]]) -> DataFrame:
    """(id, key): 128-bit key over canonical parts; rows with a null or empty raw part, or null id, are left out.

    ``parts`` pairs each raw column with its canonical form. Forms are joined
    with their lengths, so that no two lists of parts share a key.
    """
    ok = F.col(id_col).isNotNull()
    for raw, _ in parts:
        ok = ok & F.coalesce(F.length(raw) > 0, F.lit(False))
    whole = F.concat(*(x for _, form in parts for x in (F.length(form).cast("string"), F.lit(":"), form)))
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(whole)).alias("key"))


def first_of_copies(keyed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, key, first_id, n_copies) for every row of (id, key): the smallest id and the number of rows of its key."""
    k = cut(keyed)  # canonical forms are made once; 24 bytes a row
    spark, total = k.sparkSession, k.count()
    limit = max(hot_rows, math.ceil(total / (64 * shuffle_partitions(spark))))
    hot = []
    if total > limit:
        # At most total / limit keys: a proven bound of 64 times the shuffle partitions.
        hot = [r["key"] for r in k.groupBy("key").count().where(F.col("count") > limit).select("key").collect()]
    w = Window.partitionBy("key")
    if not hot:
        return k.withColumns({"first_id": F.min("id").over(w), "n_copies": F.count(F.lit(1)).over(w)})
    keys = F.broadcast(spark.createDataFrame([(h,) for h in hot], "key binary"))
    cold = k.join(keys, "key", "left_anti").withColumns({"first_id": F.min("id").over(w), "n_copies": F.count(F.lit(1)).over(w)})
    rows = k.join(keys, "key", "left_semi")
    salted = rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(shuffle_partitions(spark))).alias("salt")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    per_key = salted.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("n_copies").alias("n_copies"))
    return cold.unionByName(rows.join(F.broadcast(per_key), "key"))


def further_copies(df: DataFrame, *, id_col: str, parts: list[tuple[Column, Column]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows ``(first_id, id_col)``: every record that repeats an earlier one, with the smallest id of its group.

    Ids are unique. Records with a null or empty part are copies of nothing. An
    empty table gives no rows. Texts of any length are keyed whole.
    """
    f = first_of_copies(keyed_copies(df, id_col=id_col, parts=parts), hot_rows)
    return f.where("id <> first_id").select("first_id", F.col("id").alias(id_col))


def collapsed(df: DataFrame, *, id_col: str, parts: list[tuple[Column, Column]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows ``(first_id, n_copies)``: one per distinct record, with the number of rows it stands for."""
    f = first_of_copies(keyed_copies(df, id_col=id_col, parts=parts), hot_rows)
    return f.where("id = first_id").select("first_id", "n_copies")
