"""Queries p4 to p8 and, where SQL can say them, the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.bpe_automaton import encode_corpus, vocabulary_text
from newsloom.llm.hidden_duplicates import canonical_link, canonical_title, collapsed, further_copies
from newsloom.llm.leaks import find_leaks
from newsloom.llm.nearest_time import nearest_in_time
from newsloom.llm.visible_form import look_alike_classes, look_alike_pairs
from newsloom.runtime import table

SECOND = 1_000_000_000


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    outcomes = table(spark, d, "outcomes")
    price = nearest_in_time(outcomes, table(spark, d, "tape"), entity="ticker", left_id="outcome_id", left_time="t_ns", right_id="print_id", right_time="ts_ns", tolerance_ns=5 * SECOND)
    news = nearest_in_time(outcomes, table(spark, d, "signals"), entity="ticker", left_id="outcome_id", left_time="t_news_recv_ns", right_id="signal_id", right_time="t_news_recv_ns", tolerance_ns=2 * SECOND)
    return price.withColumn("side", F.lit("price")).unionByName(news.withColumn("side", F.lit("news"))).select("outcome_id", "side", "match_id")



def _story_parts() -> dict:
    return {"id_col": "signal_id", "parts": [(F.col("title"), canonical_title(F.col("title"))), (F.col("link"), canonical_link(F.col("link")))]}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return further_copies(table(spark, d, "signals"), **_story_parts())


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(table(spark, d, "signals"), **_story_parts())


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), id_col="doc_id", text_col="text", vocabulary=vocabulary_text("byte_bpe_50k"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"), id_col="doc_id", text_col="text").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as membership: one row per document that has a look-alike."""
    return look_alike_classes(table(spark, d, "documents"), id_col="doc_id", text_col="text").select(F.col("id").alias("doc_id"), "class_id", "text_id")


def queries() -> dict:
    return {"p4_found": p4_found, "p5_found": p5_found, "p5_copies": p5_copies, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_classes": p8_classes}


# The visible form said in SQL, apart from the operator's tables: what may look like what in these texts.
LATIN = {"аеосрухіјѕԁһԛԝүѵӏАВЕКМНОРСТХЅІЈԚԜҮѴӀԌ": "aeocpyxijsdhqwyvlABEKMHOPCTXSIJQWYVIG", "οϲϳνΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ocjvABEZHIKMNOPTYXCJ", "ёѐїЁЀЇό": "ëèïËÈÏó", "ΆΈΊΌΎΪΫ": "ÁÉÍÓÝÏŸ"}
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
TWO = {"ў": "y\u0306", "Ў": "Y\u0306", "ќ": "ќ", "Ќ": "K\u0301", "Ή": "H\u0301", "ӥ": "ӥ"}


def _look(text: str) -> str:
    out = f"regexp_replace({text}, '[\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{202a}}-\\x{{202e}}\\x{{feff}}\\x{{ad}}\\x{{34f}}\\x{{61c}}\\x{{180e}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g')"
    pairs = [*LATIN.items(), ("\u00a0\u2007\u202f\u3000", "    "), (WIDE, NARROW)]
    quoted = lambda x: x.replace("'", "''")
    out = f"translate({out}, '{quoted(''.join(a for a, _ in pairs))}', '{quoted(''.join(b for _, b in pairs))}')"
    for a, b in TWO.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


def oracle_sql() -> dict[str, str]:
    def side(name: str, right: str, rid: str, rt: str, lt: str, tol: int) -> str:
        # Of equal times the smallest id; nearest before and nearest after by as-of join.
        return f"""select outcome_id, '{name}' as side, case when (n.id is null) or (p.id is not null and l.t - p.t <= n.t - l.t) then p.id else n.id end as match_id
        from (select outcome_id, ticker, {lt} as t from outcomes where ticker is not null and {lt} <> 0) l
        asof left join (select ticker, {rt} as t, min({rid}) as id from {right} where {rt} <> 0 group by all) p on l.ticker = p.ticker and l.t >= p.t
        asof left join (select ticker, {rt} as t, min({rid}) as id from {right} where {rt} <> 0 group by all) n on l.ticker = n.ticker and l.t <= n.t
        where least(l.t - p.t, n.t - l.t) <= {tol}"""

    p4 = side("price", "tape", "print_id", "ts_ns", "t_ns", 5 * SECOND) + " union all " + side("news", "signals", "signal_id", "t_news_recv_ns", "t_news_recv_ns", 2 * SECOND)
    space = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"
    marked = r"regexp_replace(regexp_replace(lower(upper(title)), '(\pN)[.](\pN)', '\1_\2', 'g'), '(\pN)[.](\pN)', '\1_\2', 'g')"
    title = rf"trim(regexp_replace(regexp_replace(regexp_replace({marked.replace('lower(upper(title))', chr(114) + 'eplace(lower(upper(title)), chr(95), chr(32))')}, '[^\pL\pM\pN_$%]+', ' ', 'g'), '([$%])', ' \1 ', 'g'), ' +', ' ', 'g'))"
    bare = rf"regexp_replace(regexp_replace(regexp_replace(lower(upper(link)), '^{space}|{space}$', '', 'g'), '[/?&#]+$', ''), '[?]{{2,}}', '?', 'g')"
    keyed = rf"""select signal_id, {title} as t, regexp_replace(regexp_replace(split_part(x, '?', 1), '/+', '/', 'g'), '/+$', '') as a,
        list_sort(list_distinct(list_filter(string_split(regexp_replace(substr(x, length(split_part(x, '?', 1)) + 2), '/+$', ''), '&'), lambda f: f <> ''))) as q
        from (select *, {bare} as x from signals) where title <> '' and link <> ''"""
    grouped = f"with k as ({keyed}), g as (select signal_id, min(signal_id) over (partition by t, a, q) as first_id, count(*) over (partition by t, a, q) as n_copies from k)"
    look = f"(select doc_id, text, {_look('text')} as v from documents where text <> '')"
    cut = lambda v: rf"list_filter(string_split(regexp_replace(lower({v}), '[^\pL\pN]+', ' ', 'g'), ' '), lambda x: x <> '')"
    runs = "unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))"
    p7 = f"""with items as (select item_id, w, least(12, len(w)) as n from (select item_id, {cut(_look('text'))} as w from eval_items where text <> '') where len(w) > 0),
    i as (select distinct item_id, n, {runs} as run from items), d as (select doc_id, {cut('v')} as w from {look}),
    r as (select doc_id, n, {runs} as run from d, (select distinct n from items) where len(w) >= n)
    select distinct doc_id, item_id from r join i using (n, run)"""
    return {
        "p7_found": p7,
        "p8_found": f"select a.doc_id as doc_a, b.doc_id as doc_b from {look} a join {look} b on a.v = b.v and a.doc_id < b.doc_id and a.text <> b.text",
        "p8_classes": f"""select doc_id, class_id, text_id from (select doc_id, min(doc_id) over (partition by v) as class_id, min(doc_id) over (partition by v, text) as text_id, min(text) over (partition by v) <> max(text) over (partition by v) as mixed from {look}) where mixed""",
        "p4_found": p4,
        "p5_found": f"{grouped} select first_id, signal_id from g where signal_id <> first_id",
        "p5_copies": f"{grouped} select first_id, n_copies from g where signal_id = first_id",
    }
