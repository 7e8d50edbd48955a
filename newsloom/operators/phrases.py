"""Many phrases over many texts: rule tables matched in one pass.

Phrases match on word boundaries, without case; punctuation counts as a space; a
trailing ``*`` matches prefixes. The rule table is small and of fixed size (its
size is checked); texts are never shuffled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import ascii_lower

MOST_RULES = 100_000
KINDS = {"cat", "spec", "tier1", "hedge", "promo", "nonbinding", "neg", "dilution", "distress", "rsplit", "spam"}


def read_rules(spark, path: str, kinds: set[str] = KINDS) -> DataFrame:
    """(rule_id, kind, label, weight, phrase) of a tab-separated file with ``#`` comments; an unknown kind fails the load."""
    lines = spark.read.text(path).withColumn("rule_id", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"^\s*(#|$)"))
    f = F.split("value", "\t")
    kind = F.split(F.trim(F.get(f, F.lit(0))), ":")
    rules = lines.select("rule_id", kind[0].alias("kind"), F.get(kind, F.lit(1)).alias("label"), F.trim(F.get(f, F.lit(1))).try_cast("int").alias("weight"), F.trim(F.get(f, F.lit(2))).alias("phrase"))
    bad = rules.where(~F.col("kind").isin(list(kinds)) | F.col("weight").isNull() | F.col("phrase").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"rule not understood: {bad[0].asDict()}")
    return rules


def padded(c: Column) -> Column:
    """Words between single spaces, with a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def pattern(phrase: str) -> str:
    p = " " + re.sub("[^a-z0-9]+", " ", re.sub(r"\*$", "", phrase).lower()).strip()
    return p if phrase.endswith("*") else p + " "


@functools.lru_cache(maxsize=8)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        a.add_word(p, (*a.get(p, ()), i))
    a.make_automaton()
    return a


def match_phrases(df: DataFrame, phrases: list[str], *, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id_col, rule, first_end, n)``: each phrase that occurs, with the end of its first match and the number of matches.

    All overlapping matches count; null and empty texts match nothing. One pass
    of an Aho-Corasick automaton over each text, without a shuffle.
    """
    if len(phrases) > MOST_RULES:
        raise ValueError(f"{len(phrases)} phrases are too many to send to every executor")
    shared = df.sparkSession.sparkContext.broadcast(tuple(pattern(p) for p in phrases))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a = _automaton(shared.value)
        for b in batches:
            ids, rules, ends, counts = [], [], [], []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits: dict[int, list[int]] = {}
                for end, which in a.iter(text):
                    for r in which:
                        hits.setdefault(r, []).append(end)
                for r, at in hits.items():
                    ids.append(id_)
                    rules.append(r)
                    ends.append(at[0])
                    counts.append(len(at))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(rules, pa.int32()), pa.array(ends, pa.int32()), pa.array(counts, pa.int32())], ["id", "rule", "first_end", "n"])

    texts = df.select(F.col(id_col).alias("id"), padded(F.col(text_col)).alias("text")).where("text <> '  '")
    return texts.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, rule int, first_end int, n int").withColumnRenamed("id", id_col)


# Venue names before a ticker tag, their class and short name.
VENUES = {
    "nasdaq global select market": ("US", "NASDAQ"), "nasdaq global market": ("US", "NASDAQ"), "nasdaq capital market": ("US", "NASDAQ"), "nyse american llc": ("US", "NYSE"),
    "nyse american": ("US", "NYSE"), "nyse mkt": ("US", "NYSE"), "nyse arca": ("US", "NYSE"), "nysearca": ("US", "NYSE"), "nyseamerican": ("US", "NYSE"), "nasdaqgs": ("US", "NASDAQ"),
    "nasdaqgm": ("US", "NASDAQ"), "nasdaqcm": ("US", "NASDAQ"), "nasdaq": ("US", "NASDAQ"), "nyse": ("US", "NYSE"), "amex": ("US", "NYSE"), "cboe bzx": ("US", "CBOE"), "cboe": ("US", "CBOE"), "bats": ("US", "CBOE"),
    "otc pink": ("OTC", "OTC"), "otc markets": ("OTC", "OTC"), "otcmkts": ("OTC", "OTC"), "otcqx": ("OTC", "OTC"), "otcqb": ("OTC", "OTC"), "otc": ("OTC", "OTC"), "pink": ("OTC", "OTC"),
    "tsx venture": ("Foreign", "TSXV"), "tsx-v": ("Foreign", "TSXV"), "tsxv": ("Foreign", "TSXV"), "tsx": ("Foreign", "TSX"), "cse": ("Foreign", "CSE"), "neo": ("Foreign", "NEO"), "cboe canada": ("Foreign", "NEO"),
    "asx": ("Foreign", "ASX"), "lse": ("Foreign", "LSE"), "aim": ("Foreign", "AIM"), "fse": ("Foreign", "FSE"), "frankfurt": ("Foreign", "FSE"), "xetra": ("Foreign", "FSE"), "hkex": ("Foreign", "HKEX"), "sgx": ("Foreign", "SGX"), "tase": ("Foreign", "TASE"),
}
_SYMBOL = r"[A-Z](?:[A-Z0-9.-]{0,8}[A-Z0-9])?"
_NAMES = "|".join(sorted((re.escape(v) for v in VENUES), key=len, reverse=True))
#: venue, colon, then symbols parted by commas or "and"; a symbol runs into no lower-case letter, and a venue with its colon is none: it begins the next tag.
_LISTED = rf"(?!(?i:{_NAMES}) *:){_SYMBOL}(?![a-z])"
TAG = rf"(?:^|[(\[ ,;/\n\t|>\"])((?i:{_NAMES})) *: *({_LISTED}(?: *(?:,|and ) *{_LISTED})*)"


def ticker_tags(c: Column) -> Column:
    """Array of ``(venue_class, venue, symbol)`` of exchange tags like ``(NYSE: A, B)``, in order, without repeats. JVM only."""
    text = F.coalesce(c, F.lit(""))
    venues = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(TAG), F.lit(2))
    kind = F.create_map(*(x for v, (k, short) in VENUES.items() for x in (F.lit(v), F.struct(F.lit(k).alias("k"), F.lit(short).alias("v")))))
    pairs = F.arrays_zip(venues.alias("v"), lists.alias("l"))
    one = F.transform(pairs, lambda p: F.transform(F.split(p["l"], r" *(?:,|and ) *"), lambda s: F.struct(kind[F.lower(p["v"])]["k"].alias("venue_class"), kind[F.lower(p["v"])]["v"].alias("venue"), s.alias("symbol"))))
    return F.array_distinct(F.flatten(one))


# Multiplier words of dollar amounts.
MULTIPLIERS = {"million": 1e6, "mm": 1e6, "mln": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "thousand": 1e3, "k": 1e3, "trillion": 1e12, "tn": 1e12}


def dollar_amount(c: Column) -> Column:
    """Largest dollar figure in dollars, 0 without one. JVM only.

    Figures followed by "per" or "/sh" are prices, and those soon followed by words
    of market size are not amounts of a deal; both are passed over.
    """
    text = F.coalesce(c, F.lit(""))
    price = r"(?:[^$]{0,8}per |[^$]{0,3}/sh)"
    size = r"[^$]{0,36}(?: market|industry|addressable| tam|opportunity| sector)"
    word = r" *(?:million|billion|thousand|trillion|mm|mln|bn|tn|m|b|k)(?![a-z])"
    # The word is not given up to pass the tests after it (a possessive group would leave its text to later matches).
    figure = rf"(?is)\$ *([0-9](?:[0-9]|,(?=[0-9]))*(?:\.[0-9]+)?)({word})?(?!{word})(?!{price}|{size})(?![0-9]|\.[0-9]|,[0-9])"
    n = F.regexp_extract_all(text, F.lit(figure), F.lit(1))
    w = F.regexp_extract_all(text, F.lit(figure), F.lit(2))
    factor = F.create_map(*(x for k, v in MULTIPLIERS.items() for x in (F.lit(k), F.lit(v))))
    values = F.zip_with(n, w, lambda a, b: F.replace(a, F.lit(","), F.lit("")).try_cast("double") * F.coalesce(F.try_element_at(factor, F.trim(F.lower(b))), F.lit(1.0)))
    return F.coalesce(F.array_max(values), F.lit(0.0))
