"""Text functions over columns. JVM expressions, except where a character's value is computed (Arrow UDFs)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The whitespace that trimming and collapsing know.
SPACE = r"[ \t\n\r\f\x0B]"

# Named entities and their code points.
ENTITIES = {
    "amp": 0x26, "lt": 0x3C, "gt": 0x3E, "quot": 0x22, "apos": 0x27, "nbsp": 0xA0, "ndash": 0x2013, "mdash": 0x2014,
    "lsquo": 0x2018, "rsquo": 0x2019, "ldquo": 0x201C, "rdquo": 0x201D, "hellip": 0x2026, "trade": 0x2122, "reg": 0xAE, "copy": 0xA9,
    "bull": 0x2022, "middot": 0xB7, "deg": 0xB0, "eacute": 0xE9, "euro": 0x20AC, "pound": 0xA3, "cent": 0xA2, "sect": 0xA7,
    "para": 0xB6, "times": 0xD7, "frac12": 0xBD, "shy": 0xAD, "ensp": 0x2002, "emsp": 0x2003, "thinsp": 0x2009, "zwnj": 0x200C,
    "zwj": 0x200D, "iexcl": 0xA1, "laquo": 0xAB, "raquo": 0xBB,
}
# Tags that part blocks of text.
BLOCK_TAGS = "p br div li tr td th h1 h2 h3 h4 h5 h6 ul ol table section article blockquote hr pre title dd dt".split()

_ENTITY = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{0,8});"
_ENTITY_RE = re.compile(_ENTITY)
_TOKEN = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|(?P<code><(?P<kind>script|style)(?![\w:-])[^>]*(?:>(?:.*?</(?P=kind)[^>]*(?:>|\Z)|.*\Z)|\Z))"
    r"|</?(?P<tag>[A-Za-z0-9:-]+)[^>]*(?P<end>>|\Z)"
    rf"|(?P<entity>{_ENTITY})"
    rf"|(?P<space>{SPACE}+)",
    re.S | re.I,
)


def ascii_lower(c: Column) -> Column:
    """Only A-Z fold; other letters stay, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def headline_key(c: Column, most: int | None = None) -> Column:
    """ASCII letters and digits, folded, other runs one space; of the whole text, or its first ``most`` characters. Null stays null."""
    key = F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", " "))
    return key if most is None else F.trim(F.substring(key, 1, most))


def parse_long(c: Column) -> Column:
    """The whole trimmed-free string as an integer, else null."""
    return F.when(c.rlike(r"^-?[0-9]+$"), c.try_cast("bigint"))


def parse_double(c: Column) -> Column:
    return F.when(c.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"), c.try_cast("double"))


def truncate_utf8(c: Column, most: int) -> Column:
    """At most ``most`` bytes, cut between characters. Null stays null."""
    # Of the first `most` characters keep those whose running byte count fits; only long strings pay for it.
    head = F.substring(c, 1, most)
    short = F.octet_length(head) <= most
    cut = F.aggregate(
        F.split(head, ""),
        F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda a, x: F.when(a["full"] | (F.octet_length(a["s"]) + F.octet_length(x) > most), F.struct(a["s"].alias("s"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["s"], x).alias("s"), F.lit(False).alias("full"))),
    )["s"]
    return F.when(short, head).otherwise(cut)


def decode_entity(m: str) -> str:
    """One ``&...;``; unknown ones and those longer than 12 bytes are kept as they are."""
    name = m[1:-1]
    if len(m) > 12:
        return m
    if name[0] == "#":
        n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m
    return chr(ENTITIES[name]) if name in ENTITIES else m


def decode_text(s: str | None) -> str | None:
    return None if s is None else _ENTITY_RE.sub(lambda m: decode_entity(m[0]), s)


def html_text(s: str | None, separator: str = " ") -> str | None:
    """Text of an HTML fragment, in one pass over its tokens; null stays null, any length.

    Comments, scripts and styles go. Block tags part text by ``separator``,
    inline tags by nothing. Unicode spaces written as entities are whitespace;
    soft hyphens and joiners written as entities go. Whitespace collapses.
    """
    if s is None:
        return None
    out: list[str] = []

    def space() -> None:
        if out and out[-1] not in (" ", separator):
            out.append(" ")

    def block() -> None:
        if separator == " ":
            return space()
        while out and out[-1] == " ":
            out.pop()
        if out and out[-1] != separator:
            out.append(separator)
        return None

    at = 0
    for m in _TOKEN.finditer(s):
        if m.start() > at:
            out.append(s[at : m.start()])
        at = m.end()
        if m["space"]:
            space()
        elif m["entity"]:
            c = decode_entity(m["entity"])
            if c in "\u00a0\u2002\u2003\u2009":
                space()
            elif c not in "\u00ad\u200c\u200d":
                out.append(c)
        elif m["cdata"] is not None:
            inner = html_text(m["cdata"], separator)
            if inner:
                out.append(inner)
        elif m["code"]:
            block()
        elif m["tag"]:
            if not m["end"]:
                break
            if m["tag"].lower() in BLOCK_TAGS:
                block()
    out.append(s[at:] if at < len(s) and not s[at:].startswith("<") else "")
    return "".join(out).strip(" " + separator)


@F.pandas_udf(T.StringType())
def _decoded(c: pd.Series) -> pd.Series:
    return c.map(decode_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _html_text(c: pd.Series) -> pd.Series:
    return c.map(html_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _html_lines(c: pd.Series) -> pd.Series:
    return c.map(lambda s: html_text(s, "\n"), na_action="ignore")


def _marked_up(c: Column, marks: str, convert: Callable, plain: Column) -> Column:
    """Only texts with a mark go to Python, as the rest is null on the way there; the others stay in the JVM."""
    has = F.coalesce(c.rlike(marks), F.lit(False))
    return F.when(has, convert(F.when(has, c))).otherwise(plain)


def decode_entities(c: Column | str) -> Column:
    """All named and numeric entities, once."""
    c = F.col(c) if isinstance(c, str) else c
    return _marked_up(c, "&", _decoded, c)


def html_to_text(c: Column | str) -> Column:
    """Text of an HTML fragment, see ``html_text``; text without markup only has its whitespace collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    return _marked_up(c, "[<&]", _html_text, collapse_whitespace(c))


def html_to_lines(c: Column | str) -> Column:
    """As html_to_text, blocks parted by line breaks."""
    c = F.col(c) if isinstance(c, str) else c
    return _marked_up(c, "[<&]", _html_lines, collapse_whitespace(c))


def named_entities(c: Column) -> Column:
    """The named entities only, in the JVM; ``&amp;`` last, so that nothing is decoded twice."""
    for name, code in ENTITIES.items():
        if name != "amp":
            c = F.replace(c, F.lit(f"&{name};"), F.lit(chr(code)))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def html_core(c: Column) -> Column:
    """JVM-only html_to_text for well-formed markup with the commonest entities."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)[^>]*>", " ")
    c = F.regexp_replace(c, rf"(?i)</?({'|'.join(BLOCK_TAGS)})(/|\s[^>]*)?>", " ")
    c = F.regexp_replace(c, r"</?[A-Za-z0-9:-]+[^>]*>", "")
    for name, to in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(to))
    return collapse_whitespace(c)


def money(c: Column) -> Column:
    """12.3B, 4.5M, 6.7K or plain, rounded half up; null stays null."""
    at = lambda unit, name: F.format_string(f"%.1f{name}", F.floor(c / (unit / 10) + 0.5) / 10)
    return F.when(c.isNull(), None).when(c >= 1e9, at(1e9, "B")).when(c >= 1e6, at(1e6, "M")).when(c >= 1e3, at(1e3, "K")).otherwise(F.format_string("%.0f", F.floor(c + 0.5).cast("double")))


def split_trimmed(c: Column, sep: str) -> Column:
    return F.transform(F.split(c, re.escape(sep)), trimmed)


def share_count(c: Column) -> Column:
    """12.3M, 45.6K or plain, rounded half up; null stays null."""
    at = lambda unit, name: F.format_string(f"%.1f{name}", F.floor(c / (unit / 10) + 0.5) / 10)
    return F.when(c.isNull(), None).when(c >= 1e6, at(1e6, "M")).when(c >= 1e3, at(1e3, "K")).otherwise(F.format_string("%.0f", F.floor(c + 0.5).cast("double")))


def utf8_char(code: Column) -> Column:
    """The character of a code point; null for surrogates and beyond U+10FFFF. The UTF-8 bytes are put together in the JVM."""
    n = code.cast("int")
    low = lambda k: F.call_function("shiftright", n, F.lit(6 * k)).bitwiseAND(F.lit(63)) + 128
    head = lambda k, mark: F.call_function("shiftright", n, F.lit(6 * k)) + mark
    hexes = lambda *b: F.concat(*(F.lpad(F.hex(x), 2, "0") for x in b))
    h = F.when(n < 0x80, hexes(n)).when(n < 0x800, hexes(head(1, 0xC0), low(0))).when(n < 0x10000, hexes(head(2, 0xE0), low(1), low(0))).otherwise(hexes(head(3, 0xF0), low(2), low(1), low(0)))
    return F.when(n.between(0, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(h), "UTF-8"))


def json_escaped(c: Column) -> Column:
    """The text between the quotes of its JSON string; null stays null."""
    j = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(j, 7, F.length(j) - 8))


def hex_id(c: Column) -> Column:
    """A 64-bit id as 16 hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def mixed(c: Column) -> Column:
    """A 64-bit mix of a long, for ids made of ids; only equality is promised."""
    return F.xxhash64(c)


def json_value(c: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` (``$.a.b[0]``) of a JSON text as ``kind``; null if the text does not read, the path is absent, or the value is no such kind. 64-bit integers stay exact."""
    return F.try_variant_get(F.try_parse_json(F.regexp_replace(c, "^\\ufeff", "")), path, kind)
