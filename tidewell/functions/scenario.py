"""Scenario metadata from names of result files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of result files and what they hold, in order of precedence.
SUFFIXES = [
    ("_1d_Cmx.csv", "Cmx"),
    ("_1d_Nmx.csv", "Nmx"),
    ("_1d_Chan.csv", "Chan"),
    ("_1d_ccA_L.dbf", "ccA"),
    ("_Results1D.gpkg", "ccA"),
    ("_Results.gpkg", "ccA"),
    ("_RLL_Qmx.csv", "RLL_Qmx"),
    ("_1d_Q.csv", "Q"),
    ("_1d_V.csv", "V"),
    ("_1d_CF.csv", "CF"),
    ("_1d_H.csv", "H"),
    ("_PO.csv", "PO"),
    ("_POMM.csv", "POMM"),
    (".eof", "EOF"),
    (".tlf", "TLF"),
]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in text)


#: A file's name: what stands before the first suffix that fits, and the suffix.
_NAME = r"(?is)^(.*?)(" + "|".join(_literal(s) for s, _ in SUFFIXES) + ")$"


def data_type(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for s, k in SUFFIXES for x in (s.lower(), k)])
    return F.try_element_at(kinds, F.lower(F.regexp_extract(name, _NAME, 2)))


def run_code(name: Column) -> Column:
    """The file's name without its suffix, or as it is if no suffix is known."""
    return F.regexp_replace(name, _NAME, "$1")


def tokens(code: Column) -> Column:
    return F.split(F.translate(code, "+", "_"), "_")


def token_like(text: Column, pattern: str) -> Column:
    """A group of the first token between ``_`` and ``+`` that the pattern matches from its start up to a dot or its end."""
    return F.get(F.regexp_extract_all(text, F.lit(rf"(?i)(?<![^_+])(?:{pattern})(?=[._+]|$)"), F.lit(1)), 0)


def tp_text(text: Column) -> Column:
    return F.concat(F.lit("TP"), F.lpad(token_like(text, r"TP(\d{1,2})"), 2, "0"))


def tp_label(text: Column) -> Column:
    """TPnn of any text that names a pattern: by a token, else by T or TP and digits, else by one or two digits alone."""
    own = clean_text(text)
    digits = F.coalesce(token_like(own, r"TP(\d{1,2})"), found(own, r"(?i)TP?\s*(\d{1,2})"), found(own, r"\b(\d{1,2})\b"))
    return F.concat(F.lit("TP"), F.lpad(digits, 2, "0"))


def member_label(text: Column, count: int = 10) -> Column:
    """TPnn of a number from 1 to ``count``, with or without TP before it; blank for anything else."""
    number = F.regexp_replace(F.upper(F.trim(text.cast("string"))), "^TP", "").try_cast("int")
    return F.when(number.between(1, count), F.concat(F.lit("TP"), F.lpad(number.cast("string"), 2, "0"))).otherwise(F.lit(""))


def duration_text(text: Column) -> Column:
    """Minutes as ``120m``; else hours or minutes with a unit as they are written."""
    return F.coalesce(F.concat(token_like(text, r"(\d{3,5})m"), F.lit("m")), token_like(text, r"(\d+(?:\.\d+)?(?:hours?|hrs?|h|minutes?|mins?|m))"))


def duration_minutes(text: Column) -> Column:
    """Minutes of a duration's text: hours times 60, and a bare number or ``m`` as minutes; null if there is none."""
    hours = found(text, r"(?i)(\d+(?:\.\d+)?)\s*(?:hours?|hrs?|h)(?![a-z])").try_cast("double") * 60
    minutes = found(text, r"(?i)(\d+(?:\.\d+)?)\s*(?:minutes?|mins?|min|m)(?![a-z])").try_cast("double")
    return F.coalesce(hours, minutes, F.trim(text).try_cast("double"))


def aep_text(text: Column) -> Column:
    """The first token that is a number of up to two decimals and p, or PMP or PMPF."""
    return F.regexp_replace(F.upper(token_like(text, r"(\d+(?:\.\d{1,2})?p|PMPF?)")), r"(?<=\d)P$", "p")


def number_of(text: Column) -> Column:
    return found(text, r"(\d+(?:\.\d+)?)").try_cast("double")


def trim_code(code: Column, tp: Column | None = None, duration: Column | None = None, aep: Column | None = None) -> Column:
    """The run code without its tokens for pattern, duration and event, which may be given where they are known."""
    known = [tp_text(code) if tp is None else tp, duration_text(code) if duration is None else duration, aep_text(code) if aep is None else aep]
    raw = F.concat(F.lit("tp"), F.coalesce(token_like(code, r"TP(\d{1,2})"), F.lit("")))
    drop = F.array(*[F.coalesce(F.lower(p), F.lit("")) for p in known], raw)
    return F.array_join(F.filter(tokens(code), lambda t: ~F.array_contains(drop, F.lower(t))), "_")


def match_key(name: Column) -> Column:
    """Upper-case prefix and the number at the name's end, cut, not rounded, to two decimals; null without a number.

    Blanks within the prefix become one; everything else in it stays, so differently named channels don't share a key.
    """
    own = clean_text(name)
    parts = r"(?s)^(.*?)(-?\d+)(?:\.(\d+))?$"
    prefix = F.upper(F.regexp_replace(F.trim(F.regexp_extract(own, parts, 1)), r"\s+", " "))
    cents = F.rpad(F.substring(F.regexp_extract(own, parts, 3), 1, 2), 2, "0")
    return F.when(own.rlike(parts), F.concat(prefix, F.lit("|"), F.regexp_extract(own, parts, 2), F.lit("."), cents))


def clean_text(text: Column) -> Column:
    """Null for blank text and for the usual words for nothing."""
    own = F.trim(text)
    return F.when(F.lower(own).isin("", "nan", "none", "<na>", "nat"), None).otherwise(own)


def first_text(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def dms_to_degrees(text: Column) -> Column:
    """Degrees of ``D°M'S"``, 0 if it isn't one."""
    part = lambda k: found(text, "^\\s*(-?\\d+(?:\\.\\d+)?)°(\\d+(?:\\.\\d+)?)'(\\d+(?:\\.\\d+)?)\"", k).try_cast("double")
    return F.coalesce(part(1) + part(2) / 60 + part(3) / 3600, F.lit(0.0))


def kept_runs(text: Column, kept: str, fallback: str) -> Column:
    """Runs of kept characters joined by ``_``; the fallback if there are none."""
    return F.coalesce(F.nullif(F.array_join(F.regexp_extract_all(text, F.lit(f"[{kept}]+"), F.lit(0)), "_"), F.lit("")), F.lit(fallback))


def slug(text: Column, fallback: str = "item") -> Column:
    return kept_runs(text, "A-Za-z0-9", fallback)


def sheet_name(text: Column) -> Column:
    return kept_runs(text, "A-Za-z0-9_-", "Sheet")


def without_token(name: Column, k: int) -> Column:
    """The name without its k-th token (from 0) of those between ``_`` and ``+``."""
    parts = F.split(name, r"[+_]")
    return F.array_join(F.filter(parts, lambda t, i: i != k), "_")


def numbered_name(name: Column, n: Column) -> Column:
    """The name itself for the first of equal names, then name(1), name(2) and so on."""
    return F.concat(name, F.when(n > 1, F.concat(F.lit("("), (n - 1).cast("string"), F.lit(")"))).otherwise(F.lit("")))


def human_bytes(size: Column) -> Column:
    out = None
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        text = F.concat(F.format_string("%.1f", size / float(1024**power)), F.lit(f" {unit}"))
        out = F.when(size >= 1024**power, text) if out is None else out.when(size >= 1024**power, text)
    return out.otherwise(F.concat(F.format_string("%.1f", size.cast("double")), F.lit(" B")))


def signed_coordinate(text: Column, kind: str) -> Column:
    """The number in a coordinate's text: latitudes negative (south), longitudes positive (east)."""
    number = F.abs(F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double"))
    return -number if kind == "lat" else number


def csv_path(folder: Column, aep: Column, duration: Column, tp: Column) -> Column:
    dotted = lambda c: F.replace(c, F.lit("."), F.lit("p"))
    return F.concat(folder, F.lit("/aep"), dotted(aep), F.lit("_du"), dotted(duration), F.lit("tp"), tp, F.lit(".csv"))


def trimmed_number(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")


def colour_name(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("rgb_%03d_%03d_%03d", red, green, blue)


def scenario_label(**parts: Column) -> Column:
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit("Unknown"))) for k, v in parts.items()])
