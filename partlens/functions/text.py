"""Text columns: part-number keys, vendor names, masks, mined values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def mpn_norm(x: Column) -> Column:
    """White space out, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""))


def loose_keep_plus(x: Column) -> Column:
    """Letters, digits and every plus sign: the plus tells variants apart."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"[^A-Z0-9+]", "")


def loose(x: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"[^A-Z0-9]", "")


def vendor_norm(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]", "")


def vendor_matches(stored: Column, wanted: Column) -> Column:
    """Either name holds the other, punctuation aside; empty names match nothing."""
    a, b = vendor_norm(stored), vendor_norm(wanted)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def folded(x: Column, blank: str = "(unknown)") -> Column:
    """The trimmed name, blanks under one label."""
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(blank))


def canonical(x: Column, aliases: dict[str, str], suffixes: tuple[str, ...]) -> Column:
    """The alias of a name without punctuation and legal suffixes, else the name itself."""
    plain = F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9 ]", " "))
    bare = F.trim(F.regexp_replace(plain, r"\s+(?:" + "|".join(suffixes) + r")$", ""))
    table = F.create_map(*(F.lit(v) for pair in aliases.items() for v in pair)) if aliases else None
    return F.coalesce(F.try_element_at(table, bare), x) if aliases else x


def first_rule(x: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule whose expression is found."""
    chain = reduce(lambda c, r: c.when(x.rlike(r[0]), r[1]), rules[1:], F.when(x.rlike(rules[0][0]), rules[0][1]))
    return chain.otherwise(F.lit(default))


def masked(x: Column, terms: list[str], mark: str = " ") -> Column:
    return F.regexp_replace(x, "(?i)(?:" + "|".join(terms) + ")", mark)


def weighted_score(x: Column, evidence: list[tuple[str, float]]) -> Column:
    """Weights of the expressions found, each once, clamped to 0..100; null when none is."""
    hits = [F.when(x.rlike(p), F.lit(float(w))) for p, w in evidence]
    total = reduce(lambda a, b: a + b, [F.coalesce(h, F.lit(0.0)) for h in hits])
    return F.when(F.coalesce(*hits).isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)))


def family_key(x: Column) -> Column:
    """The part number without its grade suffix."""
    return F.regexp_replace(mpn_norm(x), r"-(?:SP|SEP|EP|QV|QR)$", "")


def canonical_vendor(x: Column) -> Column:
    """One spelling for each manufacturer: without dots, commas and company words it is looked up; unknown names stay as they are."""
    plain = F.coalesce(F.trim(x), F.lit(""))
    words = F.filter(F.split(F.lower(plain), r"[\s.,]+"), lambda w: (w != "") & ~w.isin(V.COMPANY))
    bare = F.trim(F.array_join(words, " "))
    bare = F.regexp_replace(bare, "^[ -]+|[ -]+$", "")
    table = F.create_map(*(F.lit(v) for pair in V.VENDORS.items() for v in pair))
    return F.coalesce(F.try_element_at(table, bare), plain)
