"""Material names: normal form, family, category and tiered agreement, all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families in order, each with its patterns; the first that matches wins, case doesn't count.
FAMILIES: dict[str, list[str]] = {
    "PET": ["^PET$", r"Polyethylene\s*tereph", "Polyester"],
    "PP": ["^PP$", "Polypro"],
    "PE": ["^PE$", "^HDPE$", "^LDPE$", "^LLDPE$", "Polyethylene(?!.*tereph)", "High.density polyethylene", "Low.density polyethylene"],
    "PS": ["^PS$", "Polystyrene"],
    "PVC": ["^PVC$", r"Polyvinyl\s*chloride"],
    "PA": ["^PA$", r"^PA\d", "^Nylon", "^Polyamide(?!.*(natural|occurring))"],
    "PC": ["^PC$", "Polycarbonate"],
    "PMMA": ["^PMMA$", r"Polymethyl\s*methacrylate", "^Acrylic$"],
    "PU": ["^PU$", "Polyurethane"],
    "PTFE": ["^PTFE$", "Polytetrafluoroethylene", "Teflon"],
    "ABS": ["^ABS$", "Acrylonitrile.*butadiene.*styrene"],
    "Rubber": ["Rubber", "^SBR$", "^NBR$", "^EPDM$", "Tire", "Tyre"],
    "Cellulose": ["Cellulos", "^CAB$", "Rayon", "Viscose", "Lyocell"],
    "Acrylate": ["Polyacrylamide", "Polyacrylate", "Acrylamide", "Acrylate"],
    "Protein": ["Protein", "Keratin", "Silk", "^Wool$"],
    "Chitin": ["Chitin", "Chitosan"],
    "Natural": [r"naturally\s*occurring", "^Carbonate$", "^Sand$", "Cotton", "^Natural$", "^Organic$", "^Biofilm$"],
}
SYNTHETIC = ["PET", "PP", "PE", "PS", "PVC", "PA", "PC", "PMMA", "PU", "PTFE", "ABS", "Rubber"]
SEMI_SYNTHETIC = ["Cellulose", "Acrylate"]
NATURAL = ["Protein", "Chitin", "Natural"]
CATEGORIES = ["Synthetic", "Semi-synthetic", "Natural", "Unknown"]
# End of the fixed values.


def _filled(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Unknown"))


def normal_name(name: Column) -> Column:
    """The content of the first parentheses of letters, digits and blanks if there is one, without lab suffixes, upper case."""
    trimmed = F.trim(name)
    inner = F.regexp_extract(trimmed, r"\(([A-Za-z0-9 ]+)\)", 1)
    base = F.when(inner != "", inner).otherwise(trimmed)
    short = F.regexp_replace(F.regexp_replace(base, "^Polypro$", "PP"), r"(?i)\s+(Lab bench|Nylon \d+)$", "")
    return F.upper(F.trim(short))


def family(name: Column, families: dict[str, list[str]] = FAMILIES) -> Column:
    filled, out = _filled(name), None
    for label, patterns in families.items():
        hit = filled.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Unknown") if out is not None else F.lit("Unknown")


def category(of: Column) -> Column:
    return F.when(of.isin(SYNTHETIC), "Synthetic").when(of.isin(SEMI_SYNTHETIC), "Semi-synthetic").when(of.isin(NATURAL), "Natural").otherwise("Unknown")


def category_order(of: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), of)


def tier(a: Column, b: Column, families: dict[str, list[str]] = FAMILIES) -> Column:
    """Exact, Family or Disagree."""
    fa, fb = family(a, families), family(b, families)
    apart = (fa == "Unknown") | (fb == "Unknown") | (fa != fb)
    return F.when(apart, "Disagree").when(F.upper(_filled(a)) == F.upper(_filled(b)), "Exact").otherwise("Family")


def mapped(name: Column, mapping: dict[str, str] | None) -> Column:
    """By the caller's rules pattern -> name, the first that matches; without rules, the normal name."""
    if mapping is None:
        return normal_name(name)
    trimmed, out = F.trim(name), None
    for pattern, canonical in mapping.items():
        hit = trimmed.rlike(f"(?i){pattern}")
        out = F.when(hit, canonical.upper()) if out is None else out.when(hit, canonical.upper())
    return F.upper(trimmed) if out is None else out.otherwise(F.upper(trimmed))


def family_sql(name: str, families: dict[str, list[str]] = FAMILIES) -> str:
    """family() for an engine whose regular expressions have no look-ahead: A(?!.*B) is A without A.*B."""
    filled, arms = f"coalesce(nullif(trim({name}), ''), 'Unknown')", []
    for label, patterns in families.items():
        tests = []
        for p in patterns:
            if m := re.fullmatch(r"(.*)\(\?!(.*)\)", p):
                tests.append(f"(regexp_matches({filled}, '{m[1]}', 'i') AND NOT regexp_matches({filled}, '{m[1]}{m[2]}', 'i'))")
            else:
                tests.append(f"regexp_matches({filled}, '{p}', 'i')")
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{label}'")
    return f"CASE {' '.join(arms)} ELSE 'Unknown' END"


def normal_sql(name: str) -> str:
    base = f"coalesce(nullif(regexp_extract(trim({name}), '\\(([A-Za-z0-9 ]+)\\)', 1), ''), trim({name}))"
    return f"upper(trim(regexp_replace(regexp_replace({base}, '^Polypro$', 'PP'), '\\s+(Lab bench|Nylon \\d+)$', '', 'i')))"


def category_sql(of: str) -> str:
    within = lambda x: "(" + ", ".join(f"'{v}'" for v in x) + ")"
    return f"CASE WHEN {of} IN {within(SYNTHETIC)} THEN 'Synthetic' WHEN {of} IN {within(SEMI_SYNTHETIC)} THEN 'Semi-synthetic' WHEN {of} IN {within(NATURAL)} THEN 'Natural' ELSE 'Unknown' END"
