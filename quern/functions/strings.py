"""Header, file-name and coordinate parsing, as Column expressions and small schema functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File-name patterns and image extensions. LDIR is asked first, as "... LDIR ..." also fits IR\b.
INSTRUMENTS = {"LDIR": "LDIR|8700", "FTIR": r"FTIR|Spotlight|infrared|IR\b|FT-IR", "Raman": "Raman"}
IMAGES = ["png", "jpg", "jpeg", "tif", "tiff", "bmp"]
# End of the fixed values.

ARTEFACTS = "[µμ²³Â]"


def normal_header(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(ARTEFACTS, "", name.lower().replace("Â", ""))).strip()


def normal_header_column(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), ARTEFACTS.lower() + "|â", ""), r"\s+", " "))


def find_column(columns: list[str], aliases: list[str]) -> str | None:
    """Alias by alias: the header that equals it, else the first that contains it; then aliases without [unit] as patterns."""
    normal = {c: normal_header(c) for c in columns}
    for alias in map(normal_header, aliases):
        hits = [c for c in columns if normal[c] == alias] or [c for c in columns if alias in normal[c]]
        if hits:
            return hits[0]
    for alias in aliases:
        bare = re.sub(r"\s*\[[^\]]*\]\s*$", "", alias)
        hits = [c for c in columns if re.search(re.escape(bare), c, re.I)]
        if hits:
            return hits[0]
    return None


def number(df: DataFrame, aliases: list[str]) -> Column:
    name = find_column(df.columns, aliases)
    return F.expr(f"try_cast(`{name}` AS double)") if name else F.lit(None).cast("double")


def coordinates(text: Column) -> tuple[Column, Column]:
    """x and y of "[x;y]"; what isn't a number is null."""
    parts = F.split(F.regexp_replace(text, r"[\[\]]", ""), ";")
    value = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return value(0), value(1)


def delimiter(header: Column) -> Column:
    count = lambda c: F.length(header) - F.length(F.replace(header, F.lit(c), F.lit("")))
    return F.when(count(";") > count(","), ";").otherwise(",")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def instrument(path: Column) -> Column:
    name, out = base_name(path), None
    for label, pattern in INSTRUMENTS.items():
        hit = name.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("UNKNOWN")


def file_type(path: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)).isin(IMAGES), "image").otherwise("tabular")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "").try_cast("double")
