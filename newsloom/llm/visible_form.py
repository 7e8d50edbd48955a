"""Visually identical text with different characters.

A transducer is compiled once, on the driver, and sent to the workers. Its table
gives each single character that has another form its visible form; its arcs lead
from a character and a joining one (a mark, a half-width sound mark, a Hangul
vowel or final) to the composed character. Text is cut into the longest clusters
(a character with the joining and invisible characters that follow it); clusters
of one character are read from the table, longer ones run over the arcs. The
compiler refuses a mapping in which a cluster has two forms: every composed
character and every spelling of it must end in the same form, and every form must
be its own. Widths, accents, spaces and look-alike letters thus become one,
characters that show nothing go.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import cut

# Spaces that look like the ordinary one (non-breaking and full-width).
SPACES = "\u00a0\u2007\u202f\u3000"

# Cyrillic and Greek letters drawn like a Latin letter in upright type, and that letter. The rule: the public
# confusables data give the letter that Latin letter, of the same case, and their upright shapes coincide (so not for alpha,
# gamma, iota, kappa, rho, sigma, tau and upsilon in small letters, whose strokes differ).
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G",
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}

# Format characters that do show (Arabic and Indic number and text signs).
SHOWN_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
# Default-ignorable characters outside the format category.
IGNORABLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
# Control characters that move the line or the column and so count.
CONTROLS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"


class ConflictError(ValueError):
    """The mapping gives a character two meanings or is not settled by one pass."""


@functools.cache
def invisible() -> frozenset[str]:
    listed = {chr(i) for a, b in IGNORABLE for i in range(a, b + 1)}
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c in listed or ((k := unicodedata.category(c)) == "Cf" and c not in SHOWN_FORMAT) or (k == "Cc" and c not in CONTROLS))


@functools.cache
def mapping() -> dict[str, str]:
    """Character to its visible form, for all characters that have another than their composed one."""
    out: dict[str, str] = {}

    def add(c: str, to: str, why: str) -> None:
        if out.setdefault(c, to) != to:
            raise ConflictError(f"{why} maps U+{ord(c):04X} to {to!r}, already {out[c]!r}")

    for c in invisible():
        add(c, "", "invisible")
    for c in SPACES:
        add(c, " ", "space")
    for i in range(0xFF01, 0xFFEF):
        c = chr(i)
        if c not in out and (to := unicodedata.normalize("NFKC", c)) != c:
            add(c, to, "width")
    for c, to in LOOK_ALIKES.items():
        add(c, to, "look-alike")
    for c, to in out.items():
        if any(x in out for x in to):
            raise ConflictError(f"the form of U+{ord(c):04X} is itself mapped")
    if any(unicodedata.normalize("NFD", c) in LOOK_ALIKES for c in map(chr, range(0x250))):
        raise ConflictError("a Latin letter decomposes into a look-alike")
    return out


def _class(chars: Iterable[str]) -> str:
    """Pattern of one of ``chars``, as ranges."""
    runs: list[list[int]] = []
    for i in sorted(map(ord, chars)):
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


# Conjoining Hangul letters as (first, how many): leading ones, vowels, finals (from one before the first).
LEADING, VOWELS, FINALS, SYLLABLES = (0x1100, 19), (0x1161, 21), (0x11A7, 28), 0xAC00
HANGUL_JOINING = [(0x1160, 0x11FF), (0xD7B0, 0xD7FB)]


class _Kept(dict):
    """Code point to code point or text; those without another form are kept as they are met."""

    def __missing__(self, c: int) -> int:
        self[c] = c
        return c


class Transducer:
    """Compiled clusters: single characters, arcs, and the patterns that find what may change."""

    def __init__(self, single: dict[str, str], spelled: dict[str, str], arcs: dict[str, str], joining: set[str]):
        """``single``: visible form of a lone character; ``spelled``: its base and marks, where they differ from it; ``arcs``: of two characters."""
        self.spelled, self.arcs, self.joining = spelled, arcs, joining
        self.table = _Kept({ord(c): to for c, to in single.items()})
        gone = {c for c, to in single.items() if not to}
        self.control = re.compile(_class(c for c in gone if c < "\x80"))
        # Whether a text may change at all, or have clusters: beyond the basic plane any character may, as there a class is slow.
        self.active, self.join = (re.compile(_class([c for c in x if c < "\U00010000"])[:-1] + "\U00010000-\U0010ffff]") for x in (set(single) | joining, joining))
        self.cluster = re.compile(f"(?s:.){_class(joining | gone)}+")
        self.kept: dict[str, str] = {}

    def _arc(self, a: str, b: str) -> str | None:
        got = self.arcs.get(a + b)
        if got is None and "\u1100" <= a <= "\ud7a3":
            x, y = ord(a), ord(b)
            if 0 <= x - LEADING[0] < LEADING[1] and 0 <= y - VOWELS[0] < VOWELS[1]:
                return chr(SYLLABLES + ((x - LEADING[0]) * VOWELS[1] + y - VOWELS[0]) * FINALS[1])
            if x >= SYLLABLES and not (x - SYLLABLES) % FINALS[1] and 0 < y - FINALS[0] < FINALS[1]:
                return chr(x + y - FINALS[0])
        return got

    def run(self, cluster: str) -> str:
        """The form of a cluster: marks in canonical order, each taken in by an arc from the character before it, or left behind it."""
        rank = unicodedata.combining
        letters = "".join(self.spelled.get(c, c) for c in cluster)
        marks: list[str] = []
        row: list[str] = []
        for c in letters:
            if rank(c):
                marks.append(c)
                continue
            row += sorted(marks, key=rank)
            marks.clear()
            row.append(c)
        row += sorted(marks, key=rank)
        out: list[str] = []
        base, last = -1, 0
        for c in row:
            r = rank(c)
            if base >= 0 and (last < r or (last == 0 and base == len(out) - 1)) and (to := self._arc(out[base], c)):
                out[base] = to
                continue
            if r == 0:
                base = len(out)
            last = r
            out.append(c)
        return "".join(out)

    def _of(self, m: re.Match) -> str:
        got = self.kept.get(m[0])
        if got is None:
            got = self.run(m[0])
            if len(m[0]) <= 16 and len(self.kept) < 1_000_000:  # only a speed matter
                self.kept[m[0]] = got
        return got

    def __call__(self, text: str) -> str:
        if text.isascii():
            return self.control.sub("", text)
        if not self.active.search(text):
            return text
        if self.join.search(text):
            text = self.cluster.sub(self._of, text)
        return text.translate(self.table)

    def __reduce__(self):
        single = {chr(c): to for c, to in self.table.items() if isinstance(to, str)}
        return Transducer, (single, self.spelled, self.arcs, set(self.joining))


@functools.cache
def transducer() -> Transducer:
    """Compiled from the mapping and the composed characters of the Unicode data, and checked for conflicts."""
    table, nfd, nfc = mapping(), functools.partial(unicodedata.normalize, "NFD"), functools.partial(unicodedata.normalize, "NFC")
    single, spelled, arcs, composed = {}, {}, {}, []
    joining = {"\uff9e", "\uff9f"} | {chr(i) for a, b in HANGUL_JOINING for i in range(a, b + 1)} | {chr(i) for i in range(0xFFA1, 0xFFDD)}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "M" and c not in invisible():
            joining.add(c)
        if SYLLABLES <= i <= 0xD7A3 or kind in ("Cn", "Co", "Cs") or not (c in table or unicodedata.decomposition(c)):
            continue
        letters = "".join(table.get(x, x) for x in nfd(table.get(c, c)))
        if letters != c:
            spelled[c] = letters
        if (to := nfc(letters)) != c:
            single[c] = to
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and nfc(c) == c:
            composed.append(c)
    for c in invisible():  # ASCII controls
        single[c] = spelled[c] = ""
    for c in composed:
        a, b = (single.get(x, x) for x in (chr(int(p, 16)) for p in unicodedata.decomposition(c).split()))
        to = single.get(c, c)
        if len(a) == len(b) == len(to) == 1 and arcs.setdefault(a + b, to) != to:
            raise ConflictError(f"{a + b!r} composes to {to!r} and to {arcs[a + b]!r}")
    out = Transducer(single, spelled, arcs, joining)
    for c in [*single, *composed]:
        form = single.get(c, c)
        for spelling in {c, nfd(c), nfd(form)}:
            if out(spelling) != form:
                raise ConflictError(f"{spelling!r}, a spelling of U+{ord(c):04X}, has the forms {form!r} and {out(spelling)!r}")
    return out


_shared: list[Transducer] = []


def adopt(compiled: Transducer) -> None:
    """Use a transducer that was compiled elsewhere (a worker takes the driver's)."""
    _shared[:] = [compiled]


def visible(text: str) -> str:
    """The visible form. Idempotent; ASCII text without control characters is its own."""
    return (_shared[0] if _shared else transducer())(text)


#: 128-bit digests as two longs each: of the raw text and of its visible form.
RAW, LOOK = ("raw_a", "raw_b"), ("look_a", "look_b")


def _halves(digest: Iterable[bytes]):
    import numpy as np
    import pyarrow as pa

    both = np.frombuffer(b"".join(digest), ">i8").reshape(-1, 2).astype(np.int64)
    return [pa.array(both[:, k].copy()) for k in (0, 1)]


def visible_classes(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, raw_a, raw_b, look_a, look_b)``: look names the class of all texts that look the same, raw that of exact copies.

    Null and empty texts and null ids are in no class. A text of invisible
    characters only looks like nothing and belongs with others of that kind. Plain
    ASCII texts are their own form and do not leave the JVM.
    """
    shared = df.sparkSession.sparkContext.broadcast(transducer())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        adopt(shared.value)
        md5 = lambda x: hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        for b in batches:
            look = [raw if t is None else md5(visible(t)) for t, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *_halves(b.column(2).to_pylist()), *_halves(look)], ["id", *RAW, *LOOK])

    t = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text <> ''")
    t = t.select("id", F.when(F.col("text").rlike(r"[^\t\n\r -~]"), F.col("text")).alias("text"), F.unhex(F.md5("text")).alias("raw"))
    return t.mapInArrow(run, "id bigint, raw_a bigint, raw_b bigint, look_a bigint, look_b bigint")


def _mixed(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Classified rows of the classes that hold at least two different texts, with the class's rows ``n`` and smallest id ``class_id``.

    Two digests differ if and only if one of their halves does, so extremes of the
    halves tell, and the aggregation hashes.
    """
    k = cut(visible_classes(df, id_col=id_col, text_col=text_col))  # 40 bytes a row
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in RAW for f in (F.min, F.max)]
    mixed = k.groupBy(*LOOK).agg(*ends, F.count(F.lit(1)).alias("n"), F.min("id").alias("class_id")).where(" or ".join(f"min_{c} <> max_{c}" for c in RAW))
    return k.join(mixed.select(*LOOK, "n", "class_id"), list(LOOK))


def look_alike_classes(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, class_id, text_id)``: one for each record of a class with different texts.

    ``class_id`` is the smallest id that looks the same, ``text_id`` the smallest with
    exactly the same text; records of one class with different ``text_id`` are pairs.
    """
    rows = cut(_mixed(df, id_col=id_col, text_col=text_col))
    first = rows.groupBy(*LOOK, *RAW).agg(F.min("id").alias("text_id"))
    return rows.join(first, [*LOOK, *RAW]).select("id", "class_id", "text_id")


def look_alike_pairs(df: DataFrame, *, id_col: str, text_col: str, hot_rows: int = 10_000) -> DataFrame:
    """Rows ``(a, b)``, a < b: all pairs of records with different texts that look the same.

    Only classes with at least two different texts reach the join. A class of more
    than ``hot_rows`` rows is salted: its left rows are spread and its right rows
    copied to each salt, which costs no more than the pairs it must give.
    """
    rows = cut(_mixed(df, id_col=id_col, text_col=text_col).select("id", *RAW, *LOOK, F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")))
    a = rows.select(*LOOK, F.col("id").alias("a"), F.struct(*RAW).alias("of_a"), F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int").alias("salt"))
    b = rows.select(*LOOK, F.col("id").alias("b"), F.struct(*RAW).alias("of_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, [*LOOK, "salt"]).where("a < b and of_a <> of_b").select("a", "b")
