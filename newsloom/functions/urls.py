"""URL parts and references against a base, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, host, port, path and query; no user info, no fragment.
URL = r"(?i)^(https?)://([^/?#@:\s]+)(?::([0-9]{1,5}))?([/?][^#]*)?(?:#.*)?$"


def url_parts(c: Column) -> Column:
    """struct(scheme, host, port, target); null unless http(s) without user info. Ports default by scheme, target to ``/``."""
    g = lambda i: F.regexp_extract(c, URL, i)
    scheme = F.lower(g(1))
    port = F.coalesce(g(3).try_cast("int"), F.when(scheme == "https", 443).otherwise(80))
    target = F.when(g(4) == "", "/").when(g(4).startswith("?"), F.concat(F.lit("/"), g(4))).otherwise(g(4))
    return F.when(c.rlike(URL) & port.between(1, 65535), F.struct(scheme.alias("scheme"), F.lower(g(2)).alias("host"), port.alias("port"), target.alias("target")))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href``: absolute, ``//host``, ``/path`` or relative to the directory of ``base``."""
    origin = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"(?i)^(https?:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.length(bare) > F.length(origin), F.regexp_replace(bare, r"[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    ref = F.regexp_replace(href, r"#.*$", "")
    out = F.when(ref.rlike(r"(?i)^https?://"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).when(ref.startswith("/"), F.concat(origin, ref)).otherwise(F.concat(folder, ref))
    return F.when(origin != "", out)


def accession(c: Column) -> Column:
    """Accession number of a filing's path: the last part without ``.txt``."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"\.txt$", "")


def session_name_date(c: Column) -> Column:
    """``2026-09-25`` of a session file's path, whose name starts with ``09252026``; null if it does not."""
    return F.when(F.substring_index(c, "/", -1).rlike("^[0-9]{8}"), F.regexp_replace(F.substring(F.substring_index(c, "/", -1), 1, 8), "(..)(..)(....)", "$3-$1-$2"))


def date_session_name(day: Column) -> Column:
    """``09252026`` of ``2026-09-25``; null for text of another length."""
    d = day.cast("string")
    return F.when(F.length(d) == 10, F.concat(F.substring(d, 6, 2), F.substring(d, 9, 2), F.substring(d, 1, 4)))
