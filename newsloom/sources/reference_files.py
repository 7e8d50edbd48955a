"""Reference files: symbol directories, issuer map, fundamentals, baselines, short volume, filing indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.names import classify_form, normalize_symbol
from newsloom.functions.text import trimmed
from newsloom.functions.times import parse_ymd
from newsloom.operators.reference import latest_per_key

# Market tiers and exchange letters of the directory files.
TIERS = {"Q": "Nasdaq GS", "G": "Nasdaq GM", "S": "Nasdaq CM"}
EXCHANGES = {"N": "NYSE", "A": "NYSE American", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX"}


def pipe_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings by header name; the footer row is no data. Splittable, no inference."""
    df = spark.read.csv(path, sep="|", header=True, inferSchema=False)
    df = df.select(*(trimmed(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns))
    return df.where(~F.coalesce(F.col(f"`{df.columns[0]}`").rlike(r"(?i)^File Creation Time"), F.lit(False)))


def _coded(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[c], F.lit("?"))


def nasdaq_listed(spark: SparkSession, path: str) -> DataFrame:
    t = pipe_table(spark, path)
    return t.select(
        normalize_symbol(F.col("Symbol")).alias("ticker"), F.col("Security Name").alias("security_name"), _coded(F.col("Market Category"), TIERS).alias("exchange"),
        F.col("Financial Status").alias("financial_status"), F.col("Round Lot Size").try_cast("int").alias("round_lot"), (F.upper("ETF") == "Y").alias("etf"), (F.upper("Test Issue") == "Y").alias("test_issue"),
    )


def other_listed(spark: SparkSession, path: str) -> DataFrame:
    """Also an alias row for each other spelling that a symbol goes by."""
    t = pipe_table(spark, path)
    names = F.array_distinct(F.array_compact(F.array(*(F.nullif(normalize_symbol(F.col(f"`{c}`")), F.lit("")) for c in ("ACT Symbol", "CQS Symbol", "NASDAQ Symbol") if c in t.columns))))
    return t.select(
        normalize_symbol(F.col("ACT Symbol")).alias("ticker"), F.explode(names).alias("alias"), F.col("Security Name").alias("security_name"), _coded(F.col("Exchange"), EXCHANGES).alias("exchange"),
        F.col("Round Lot Size").try_cast("int").alias("round_lot"), (F.upper("ETF") == "Y").alias("etf"), (F.upper("Test Issue") == "Y").alias("test_issue"),
    )


def issuer_map(spark: SparkSession, path: str) -> DataFrame:
    """(cik, security_name, ticker, exchange) of the JSON documents with ``fields`` and ``data``, one to a file."""
    return issuer_rows(spark.read.text(path, wholetext=True))


def issuer_rows(documents: DataFrame) -> DataFrame:
    """The same of documents in a column ``value``; columns by name, not place."""
    raw = documents.select(F.from_json("value", "fields array<string>, data array<array<string>>").alias("d"))
    row = raw.select("d.fields", "d.data").select("fields", F.explode("data").alias("r"))
    at = lambda n: F.try_element_at("r", F.array_position("fields", n).cast("int"))
    return row.select(at("cik").try_cast("bigint").alias("cik"), at("name").alias("security_name"), normalize_symbol(at("ticker")).alias("ticker"), at("exchange").alias("exchange"))


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=False, mode="PERMISSIVE")


def fundamentals(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "cik bigint, shares_outstanding double, shares_asof string, public_float_usd double, float_asof string").where("cik is not null")


def baselines(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "ticker string, prev_close double, adv double, days int, asof string").where(F.col("prev_close").isNotNull() | F.col("adv").isNotNull()).withColumn("ticker", normalize_symbol(F.col("ticker")))


def short_volume(spark: SparkSession, path: str) -> DataFrame:
    t = pipe_table(spark, path)
    total = F.col("TotalVolume").try_cast("double")
    return t.select(normalize_symbol(F.col("Symbol")).alias("ticker"), F.col("Date").alias("date"), F.when(total > 0, F.col("ShortVolume").try_cast("double") / total).alias("short_ratio"))


def with_fundamentals(master: DataFrame, facts: DataFrame) -> DataFrame:
    """Shares and float by issuer on all its symbols; values at or below 0 replace nothing."""
    f = facts.select("cik", F.when(F.col("shares_outstanding") > 0, F.col("shares_outstanding")).alias("_s"), F.when(F.col("public_float_usd") > 0, F.col("public_float_usd")).alias("_f"))
    f = f.groupBy("cik").agg(F.max("_s").alias("_s"), F.max("_f").alias("_f"))
    old = lambda c: F.col(c) if c in master.columns else F.lit(None).cast("double")
    return master.join(f, "cik", "left").withColumns({"shares_outstanding": F.coalesce("_s", old("shares_outstanding")), "public_float_usd": F.coalesce("_f", old("public_float_usd"))}).drop("_s", "_f")


# Form classes that an index does not keep.
IGNORED = ["other", "10q", "10k", "def14", "s8"]


def master_index(spark: SparkSession, path: str) -> DataFrame:
    """(cik, company, form, cls, day, file) of a filing index: data rows have five fields and a numeric first one, so header text and rules drop out wherever they stand."""
    parts = F.split("value", r"\|")
    # By get, as a filter on a field may be tried on lines that have none.
    f = [F.get(parts, F.lit(i)) for i in range(5)]
    cls = classify_form(f[2])
    day = F.coalesce(F.to_date(F.try_to_timestamp(trimmed(f[3]), F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(trimmed(f[3]), F.lit("yyyyMMdd"))))
    rows = spark.read.text(path).where(r"value rlike '^\\s*[0-9]+\\|([^|]*\\|){3}[^|]*$'")
    return rows.select(trimmed(f[0]).try_cast("bigint").alias("cik"), trimmed(f[1]).alias("company"), trimmed(f[2]).alias("form"), cls.alias("cls"), day.alias("day"), trimmed(f[4]).alias("file")).where(F.col("day").isNotNull() & ~F.col("cls").isin(IGNORED))


def newest_frames(frames: DataFrame) -> DataFrame:
    """(cik, val, end) with the newest ``end`` per issuer over quarterly frames; of equal ends the first loaded."""
    return latest_per_key(frames, key=["cik"], order=[F.col("end"), -F.col("load_order")], take=["val", "end"])


FILINGS = "cik bigint, day date, cls string, items bigint"


def write_filings(filings: DataFrame, path: str) -> None:
    """(cik, day, cls, items) as tab-separated lines, one row per (cik, day, cls)."""
    filings.select("cik", "day", "cls", "items").write.mode("overwrite").options(sep="\t", dateFormat="yyyy-MM-dd").csv(path)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Filings of tab-separated lines; lines without issuer, day or class are left out, missing items are none."""
    return _tsv(spark, path, FILINGS).where("cik is not null and day is not null and cls is not null").withColumn("items", F.coalesce("items", F.lit(0).cast("bigint")))


def frame_values(documents: DataFrame, *, order: str) -> DataFrame:
    """(cik, val, end, load_order) of quarterly frames, JSON documents in ``value``; rows without issuer, value or end are left out."""
    d = documents.select(F.col(order).alias("load_order"), F.explode(F.from_json("value", "data array<struct<cik:bigint,val:double,end:string>>")["data"]).alias("x"))
    return d.select("x.cik", "x.val", parse_ymd(F.col("x.end")).alias("end"), "load_order").where("cik is not null and val is not null and end is not null")


def merged_facts(shares: DataFrame, floats: DataFrame) -> DataFrame:
    """(cik, shares_outstanding, shares_asof, public_float_usd, float_asof) of the issuers of either; newest values of each."""
    a = newest_frames(shares).select("cik", F.col("val").alias("shares_outstanding"), F.col("end").alias("shares_asof"))
    return a.join(newest_frames(floats).select("cik", F.col("val").alias("public_float_usd"), F.col("end").alias("float_asof")), "cik", "full_outer")


def candidates(index: DataFrame, listed: DataFrame, classes: list[str]) -> DataFrame:
    """Index rows of the asked form classes whose issuer is in ``listed`` (cik)."""
    return index.where(F.col("cls").isin(classes)).join(listed.select("cik").distinct(), "cik", "left_semi")
