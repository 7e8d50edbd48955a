"""Symbols, company names, forms and flag masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import ascii_lower, ascii_upper, trimmed

# Trailing words that do not tell companies apart.
SUFFIXES = "INC INCORPORATED CORP CORPORATION CO COMPANY LTD LIMITED PLC LLC LP HOLDINGS HOLDING GROUP SA NV AG SE ADR ADS THE COMMON STOCK SHARES ORDINARY CLASS A B".split()

# Items of current reports in bit order.
ITEMS = (
    "1.01 1.02 1.03 1.04 1.05 2.01 2.02 2.03 2.04 2.05 2.06 3.01 3.02 3.03 4.01 4.02 "
    "5.01 5.02 5.03 5.04 5.05 5.06 5.07 5.08 6.01 6.02 6.03 6.04 6.05 7.01 8.01 9.01"
).split()

# Titles of the items, in the same order.
ITEM_TITLES = [
    "Entry into a Material Definitive Agreement", "Termination of a Material Definitive Agreement", "Bankruptcy or Receivership", "Mine Safety", "Material Cybersecurity Incidents",
    "Completion of Acquisition or Disposition of Assets", "Results of Operations and Financial Condition", "Creation of a Direct Financial Obligation",
    "Triggering Events That Accelerate a Financial Obligation", "Costs Associated with Exit or Disposal Activities", "Material Impairments",
    "Notice of Delisting or Failure to Satisfy a Listing Rule", "Unregistered Sales of Equity Securities", "Material Modification to Rights of Security Holders",
    "Changes in Certifying Accountant", "Non-Reliance on Previously Issued Financial Statements", "Changes in Control of Registrant", "Departure/Election of Directors or Officers",
    "Amendments to Articles of Incorporation or Bylaws", "Temporary Suspension of Trading Under Employee Benefit Plans", "Amendments to the Code of Ethics", "Change in Shell Company Status",
    "Submission of Matters to a Vote of Security Holders", "Shareholder Director Nominations", "ABS Informational and Computational Material", "Change of Servicer or Trustee",
    "Change in Credit Enhancement", "Failure to Make a Required Distribution", "Securities Act Updating Disclosure", "Regulation FD Disclosure", "Other Events", "Financial Statements and Exhibits",
]

# Form class, exact form names, name prefixes; the first that fits counts.
FORMS = [
    ("s1", ["S-1", "S-1/A", "F-1", "F-1/A", "S-1MEF", "F-1MEF"], []),
    ("s3", ["S-3", "S-3/A", "F-3", "F-3/A", "S-3ASR", "F-3ASR", "S-3MEF"], []),
    ("424b", [], ["424B"]),
    ("effect", ["EFFECT"], []),
    ("pre14", ["PRE 14A", "PRE 14C"], []),
    ("def14", ["DEF 14A", "DEF 14C"], []),
    ("s8", [], ["S-8"]),
    ("8k", ["8-K", "8-K/A"], []),
    ("6k", ["6-K", "6-K/A"], []),
    ("10q", ["10-Q", "10-Q/A"], []),
    ("10k", ["10-K", "10-K/A", "20-F", "40-F"], []),
    ("nt", [], ["NT 10-", "NT 20-"]),
]


def normalize_symbol(c: Column) -> Column:
    """``brk-b``, ``BRK/B`` and ``BRK B`` become ``BRK.B``; each separator is one point."""
    return F.translate(ascii_upper(trimmed(c)), "-/ ", "...")


def normalize_company(c: Column) -> Column:
    """Upper-case words up to " - ", without legal suffixes and a leading THE; one word always stays."""
    c = F.regexp_replace(F.replace(F.substring_index(c, " - ", 1), F.lit("&"), F.lit(" AND ")), r"['.]", "")
    c = F.trim(F.regexp_replace(ascii_upper(c), "[^A-Z0-9]+", " "))
    c = F.regexp_replace(c, f"( ({'|'.join(SUFFIXES)}))+$", "")
    return F.regexp_replace(c, "^THE (.)", "$1")


def symbol_key8(c: Column) -> Column:
    """Eight characters, upper case, padded with spaces."""
    return F.rpad(ascii_upper(F.substring(c, 1, 8)), 8, " ")


def is_derivative(name: Column) -> Column:
    """Warrants, units and rights, as whole words."""
    return name.rlike(r"(?i)(^|[^A-Za-z])(warrants?|units?|rights?)([^A-Za-z]|$)")


def classify_form(c: Column) -> Column:
    form = ascii_upper(trimmed(c))
    out = None
    for name, exact, prefixes in FORMS:
        test = reduce(lambda a, b: a | b, [form.isin(exact)] * bool(exact) + [form.startswith(p) for p in prefixes])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def items_mask(c: Column) -> Column:
    """Bit mask of all ``item d.dd`` in a text, unknown items left out. Null text gives 0."""
    found = F.transform(F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(r"item\s*([0-9]\.[0-9]{2})"), F.lit(1)), lambda x: F.array_position(F.array(*map(F.lit, ITEMS)), x))
    bits = F.transform(F.filter(F.array_distinct(found), lambda i: i > 0), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), (i - 1).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def mask_names(mask: Column, names: list[tuple[int, str]]) -> Column:
    """Names of the set bits, in the order of ``names``, with commas."""
    return F.concat_ws(",", F.array_compact(F.array(*(F.when(mask.cast("bigint").bitwiseAND(F.lit(bit).cast("bigint")) != 0, F.lit(n)) for bit, n in names))))


def items_text(mask: Column) -> Column:
    return mask_names(mask, [(1 << i, label) for i, label in enumerate(ITEMS)])


def filing_headline(form: Column, company: Column, mask: Column) -> Column:
    """``8-K QUILL: title; title`` of the items in ``mask``; exhibits (9.01) are not named."""
    titles = F.array_compact(F.array(*(F.when(mask.cast("bigint").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(t)) for i, t in enumerate(ITEM_TITLES[:-1]))))
    return F.concat(form, F.lit(" "), company, F.when(F.size(titles) > 0, F.concat(F.lit(": "), F.array_join(titles, "; "))).otherwise(F.lit("")))


def distressed(status: Column) -> Column:
    """Whether a financial status is known and another than normal."""
    s = trimmed(status)
    return F.coalesce((s != "") & (s != "N"), F.lit(False))


# Names of enumerations in the order of their numbers.
TIERS = ["NONE", "WATCH", "ALERT", "HIGH", "HALT", "MOVER", "INFO"]
EXCHANGES = ["?", "Nasdaq GS", "Nasdaq GM", "Nasdaq CM", "NYSE", "NYSE American", "NYSE Arca", "Cboe BZX", "IEX", "OTC"]


def ordinal(name: Column, names: list[str]) -> Column:
    """Number of a name in an enumeration; null for others."""
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(at > 0, (at - 1).cast("int"))


def name_of(number: Column, names: list[str]) -> Column:
    """Name of a number in an enumeration; null beyond it."""
    return F.when(number >= 0, F.get(F.array(*map(F.lit, names)), number.cast("int")))
