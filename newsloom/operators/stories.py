"""Stories: which securities they speak of, replay of recorded ones, weighted rule hits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.names import normalize_company, normalize_symbol
from newsloom.operators.ordered import asof_join


def resolve_tags(stories: DataFrame, master: DataFrame, *, id_col: str, tags: str = "tags", most: int | None = None, most_unresolved: int | None = None) -> DataFrame:
    """(id_col, tickers, unresolved): tags in order, those of US venues that the master knows, and the others.

    ``master`` has a distinct ``ticker`` column. Foreign tags never resolve. The
    order of the tags is kept; with ``most`` and ``most_unresolved`` only the first so
    many are named, as in a journal row. Stories without tags get empty lists.
    """
    t = stories.select(F.col(id_col).alias("_id"), F.posexplode(tags).alias("_at", "_tag")).withColumn("ticker", F.when(F.col("_tag.venue_class") != "Foreign", normalize_symbol(F.col("_tag.symbol"))))
    known = master.select("ticker").where(F.col("ticker").isNotNull()).distinct().withColumn("_known", F.lit(True))
    x = t.join(known, "ticker", "left")
    text = F.when(F.col("_tag.venue_class") == "US", F.col("_tag.symbol")).otherwise(F.concat_ws(":", "_tag.venue", "_tag.symbol"))
    hit = F.col("_known").isNotNull()
    lists = x.groupBy("_id").agg(
        F.array_sort(F.collect_list(F.when(hit, F.struct(F.col("_at").alias("i"), F.col("ticker").alias("s"))))).alias("a"),
        F.array_sort(F.collect_list(F.when(~hit, F.struct(F.col("_at").alias("i"), text.alias("s"))))).alias("b"),
    )
    none = F.array().cast("array<string>")
    out = stories.select(F.col(id_col).alias("_id")).join(lists, "_id", "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce(first_of(F.array_distinct(F.col("a.s")), most), none).alias("tickers"), F.coalesce(first_of(F.array_distinct(F.col("b.s")), most_unresolved), none).alias("unresolved"))


def first_of(c: Column, most: int | None) -> Column:
    """The first ``most`` of an array; all if it is None."""
    return c if most is None else F.slice(c, 1, most)


def name_candidates(contributors: Column, title: Column, body: Column, most: int | None = None) -> Column:
    """Array of company names a story may be about, best first: the contributors (``most`` of them), the subject of the lead sentence, that of the headline."""
    lead = F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), r"--\s*(.{2,80}?)(?:,? \(| today| announced)", 1), F.lit(""))
    head = F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), r"^(.{2,80}?)(?: (?:Announces|Reports|Signs|Receives|Enters|Completes|Wins|Launches|Opens|Regains|Begins)\b|:)", 1), F.lit(""))
    some = first_of(F.coalesce(contributors, F.array().cast("array<string>")), most)
    return F.array_compact(F.concat(some, F.array(lead, head)))


def resolve_names(stories: DataFrame, names: DataFrame, *, id_col: str, candidates: str = "candidates") -> DataFrame:
    """(id_col, ticker): the ticker of the first candidate name that one issuer alone bears."""
    c = stories.select(F.col(id_col).alias("_id"), F.posexplode(candidates).alias("_at", "_name")).withColumn("company", normalize_company(F.col("_name")))
    return c.join(names.select("company", "ticker"), "company").groupBy("_id").agg(F.min_by("ticker", "_at").alias("ticker")).withColumnRenamed("_id", id_col)


def replayed(news: DataFrame, master: DataFrame, *, delay_ns: int = 0) -> DataFrame:
    """Recorded stories as events: tickers that the master still knows, receipt shifted by ``delay_ns`` (0 at least), in total order by (recv_ns, id).

    Rows without receipt time are left out; ``n_dropped`` counts tickers of a story that are unknown now.
    """
    n = news.where("recv_ns > 0").withColumn("recv_ns", F.greatest(F.col("recv_ns") + delay_ns, F.lit(0)))
    t = n.select("id", "recv_ns", F.posexplode_outer("tickers").alias("at", "ticker"))
    known = master.select("ticker").distinct().withColumn("known", F.lit(True))
    k = t.join(known, "ticker", "left").groupBy("id", "recv_ns").agg(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("at", "ticker"))))["ticker"].alias("tickers"), F.count_if(F.col("ticker").isNotNull() & F.col("known").isNull()).alias("n_dropped"))
    return n.drop("tickers").join(k, ["id", "recv_ns"]).orderBy("recv_ns", "id")


def during(events: DataFrame, openings: DataFrame, *, key: str, event_time: str, opened: str, length: int) -> DataFrame:
    """Events of a key that lie in ``(opened, opened + length]`` of its latest opening before them: a semi-join on intervals of one length, linear."""
    x = asof_join(events, openings, keys=[key], left_time=event_time, right_time=opened, take={opened: "_opened"})
    return x.where(F.col("_opened").isNotNull() & (F.col(event_time) - F.col("_opened") <= length)).drop("_opened")


def rule_totals(title_hits: DataFrame, body_hits: DataFrame, rules: DataFrame, *, id_col: str, sums: Mapping[str, tuple[int, int]], extremes: Mapping[str, str], bonus: int = 5) -> DataFrame:
    """Per text: best category (weight, ``bonus`` more in a title; ties to title, then the earlier end, then the longer phrase), bounded sums and extremes by kind.

    ``sums``: kind to (least, most); a rule counts once though it hits title and
    body. ``extremes``: kind to ``max`` or ``min``. What the numbers mean, and any
    blocking, is the caller's policy.
    """
    r = rules.select(F.col("rule_id").cast("int").alias("rule"), "kind", "label", "weight", F.length("phrase").alias("len"))
    hits = title_hits.withColumn("in_title", F.lit(True)).unionByName(body_hits.withColumn("in_title", F.lit(False))).join(r, "rule")
    cat = F.when(F.col("kind") == "cat", F.struct((F.col("weight") + F.when(F.col("in_title"), bonus).otherwise(0)).alias("w"), F.col("in_title").alias("t"), (-F.col("first_end")).alias("e"), F.col("len").alias("l"), (-F.col("rule")).alias("r"), F.col("label").alias("label")))
    per_rule = hits.groupBy(id_col, "rule", "kind").agg(F.max(cat).alias("cat"), F.max("weight").alias("weight"))
    aggs = [F.greatest(F.least(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0)), F.lit(hi)), F.lit(lo)).alias(k) for k, (lo, hi) in sums.items()]
    aggs += [F.coalesce({"max": F.max, "min": F.min}[how](F.when(F.col("kind") == k, F.col("weight"))), F.lit(0)).alias(k) for k, how in extremes.items()]
    g = per_rule.groupBy(id_col).agg(F.max("cat").alias("_c"), F.count(F.lit(1)).alias("n_rules"), *aggs)
    return g.select(id_col, F.col("_c.label").alias("category"), F.coalesce(F.col("_c.w"), F.lit(0)).alias("category_weight"), "n_rules", *sums, *extremes)
