"""Predicates over candidates and stored parts, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions import numbers as N
from partlens.functions import text as X
from partlens.functions import vocabulary as V

#: First letters of models that are power and variable-gain amplifiers.
POWER_MODELS = "ZHL ZVA ZVE HPA LZY TVA RFS RFE ZVM ZQL WVA ZPUL ZHG".split()
GAIN_MODELS = "DVGA PVGA MGVA LVA RVA".split()
#: Amplifier groups of subcategories; parts of different groups don't stand for each other. Others are plain gain blocks.
GROUPS = {"lna": "lna", "pa": "power", "hpa": "power", "vga": "vga"}
#: What numbers of evaluation hardware begin with, and parts of them.
BOARDS = "evb ev eval dk dvk ek ref rd".split()
KITS = "evb eval kit brd board".split()


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def says(x: Column, needle: str) -> Column:
    """Case-insensitive containment; a missing text says nothing."""
    return F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(needle.strip().lower()))


def spec_filters(filters: list[tuple[str, str, object]]) -> Column:
    """All of (key, kind, argument) over the `specs` map: range (text of the filter language or bounds), text, exact, anyof."""
    tests = []
    for key, kind, argument in filters:
        own = F.try_element_at("specs", F.lit(key))
        word = F.lower(F.trim(F.coalesce(own["text"], own["value"].cast("string"), F.lit(""))))
        if kind == "anyof":
            tests.append(word.isin([str(a).strip().lower() for a in argument]))
        elif kind == "exact":
            tests.append(word == str(argument).strip().lower())
        elif kind == "text":
            tests.append(says(F.coalesce(own["text"], own["value"].cast("string")), str(argument)))
        else:
            bounds = N.parse_filter(argument) if isinstance(argument, str) else argument
            if bounds:
                banded = own["lo"].isNotNull() & own["hi"].isNotNull()
                tests.append(F.coalesce(F.when(banded, N.band_in_range(own["lo"], own["hi"], *bounds)).otherwise(N.in_range(own["value"], *bounds)), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def amplifier_class(model: Column, nf_db: Column, power_dbm: Column) -> Column:
    """lna, high_power, vga or gain_block: by the model's letters and words, else by noise (1.5 dB) and power (33 dBm)."""
    m = F.upper(F.coalesce(model, F.lit("")))
    letters = F.regexp_extract(m, "^[A-Z]+", 0)
    # a number that W follows, not after a letter, or after a hyphen
    watts = F.rlike(m, F.lit(r"(?:^|[^A-Z.0-9])\d+(?:\.\d+)?(?: *W(?:[^A-Z0-9_]|$))")) | F.rlike(m, F.lit(r"-\d+(?:\.\d+)?W"))
    return (
        F.when(letters.isin(POWER_MODELS) | watts | F.contains(m, F.lit("HIGH POWER")), "high_power")
        .when(F.contains(m, F.lit("LN")) | F.contains(m, F.lit("LOW NOISE")), "lna")
        .when(letters.isin(GAIN_MODELS) | F.contains(m, F.lit("VARIABLE GAIN")), "vga")
        .when(nf_db <= 1.5, "lna")
        .when(power_dbm >= 33, "high_power")
        .otherwise("gain_block")
    )


def amplifier_conflict(subcategory: str, model: Column, nf_db: Column, power_dbm: Column) -> Column:
    """Whether a part is of another strong group than the subcategory asked for; gain blocks fit everywhere."""
    want = GROUPS.get(subcategory)
    if want is None:
        return F.lit(False)
    group = F.when(amplifier_class(model, nf_db, power_dbm) == "high_power", "power").otherwise(amplifier_class(model, nf_db, power_dbm))
    return group.isin("lna", "power", "vga") & (group != want)


def sibling_keep(words: Column, stored: Column, own: list[str], others: list[str], subcategory: str | None = None, siblings: list[str] = (), conflict: Column | None = None) -> Column:
    """What a subcategory's filter keeps: clear members of sibling subcategories go, named and ambiguous ones stay.

    A stored sibling decides first; then the words of the subcategory itself, then a conflict of classes, then words of siblings.
    """
    said = F.lower(F.coalesce(words, F.lit("")))
    named = lambda terms: _any([F.contains(said, F.lit(t.lower())) for t in terms])
    elsewhere = F.coalesce(stored.isin([s for s in siblings if s != subcategory]), F.lit(False)) if subcategory in siblings else F.lit(False)
    mixed = F.coalesce(conflict, F.lit(False)) if conflict is not None else F.lit(False)
    if not others:
        return ~elsewhere
    return F.when(elsewhere, False).when(named(own), True).when(mixed, False).otherwise(~named(others))


def subcategory(candidates: DataFrame, category: str, key: str, ways: Column | None = None, terms: list[str] = ()) -> DataFrame:
    """Candidates (title, text, model, subcategory, specs) that a subcategory keeps; a way count of dividers is compared as a number."""
    count = "".join(c for c in key if c.isdigit())
    if category == "divider" and count and key == f"{count}way" and ways is not None:
        return candidates.where((ways == 0) | (ways == int(count)))
    number = lambda k: F.try_element_at("specs", F.lit(k))["value"]
    clash = amplifier_conflict(key, F.coalesce(F.nullif(F.col("model"), F.lit("")), F.col("title")), F.coalesce(number("noise_nf_db"), number("nf_db")), F.coalesce(number("psat_dbm"), number("p1db_dbm"))) if category == "amplifier" else None
    keep = sibling_keep(F.concat_ws(" ", "title", "text"), F.col("subcategory"), list(terms) or V.named_by(category, key), V.excluded_by(category, key), key, [k for k, *_ in V.subcategories(category)], clash)
    return candidates.where(keep)


def vendor_excluded(vendor: Column, names: list[str]) -> Column:
    """Names without punctuation and case."""
    return X.vendor_norm(vendor).isin(["".join(c for c in n.lower() if c.isascii() and c.isalnum()) for n in names])


def vendors_for(vendors: DataFrame, category: str | None, prefer: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """vendors(name, categories): those that carry the category or everything; preferred ones first, then by name."""
    fits = F.lit(True) if category is None else F.array_contains("categories", category) | F.array_contains("categories", "*")
    return vendors.where(fits & ~F.col("name").isin(list(exclude))).orderBy(~F.col("name").isin(list(prefer)), F.lower("name"))


def space_fits(variant: Column, want: str | None) -> Column:
    """any-space, none, or one variant; nothing asked fits all."""
    blank = F.coalesce(variant, F.lit("")) == ""
    return F.lit(True) if not want else ~blank if want == "any-space" else blank if want == "none" else F.coalesce(variant == want, F.lit(False))


def allowed(category: Column, names: list[str] | None) -> Column:
    return category.isin(list(names)) if names else F.lit(True)


def part_number_shaped(x: Column) -> Column:
    """3 to 40 signs with a digit, and after the first hyphen or underscore no part that is a word of four letters or more."""
    bare = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "^[-_]+|[-_]+$", "")
    wordy = F.exists(F.slice(F.split(bare, "[-_]"), 2, 40), lambda p: F.rlike(p, F.lit("^[A-Za-z]{4,}$")))
    return F.char_length(bare).between(3, 40) & F.rlike(bare, F.lit("[0-9]")) & ~wordy


def orderable(x: Column) -> Column:
    """Evaluation boards, kits and reference designs are no parts: what a number begins with, or a later part of it, says so."""
    parts = F.split(F.lower(F.trim(F.coalesce(x, F.lit("")))), "[-_]")
    first = F.get(parts, F.lit(0))
    board = (F.size(parts) > 1) & first.isin(BOARDS) | F.startswith(first, F.lit("evb")) | F.startswith(first, F.lit("eval"))
    return ~(board | F.exists(F.slice(parts, 2, 1000), lambda p: F.regexp_extract(p, "^[a-z0-9]*", 0).isin(KITS)))


def names_any(x: Column, keywords: list[str]) -> Column:
    """Any of the keywords, case aside; without keywords everything."""
    return _any([says(x, k) for k in keywords]) if keywords else F.lit(True)


def without_lines(text: Column, boilerplate: Column) -> Column:
    """The text without the lines that, trimmed, are among the boilerplate."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(boilerplate, F.trim(line))), "\n")


def fetch_targets(parts: DataFrame, have: DataFrame, dead: DataFrame, qualified: DataFrame, patterns: list[str], limit: int, forced: list[str] = ()) -> DataFrame:
    """parts(part_id, mpn, vendor, url): those of matching vendors that aren't qualified, dead or there yet; of each vendor's order the
    first `limit` missing ones. Forced vendors pass whatever is known of their parts.
    """
    force = vendor_excluded(F.col("vendor"), list(forced)) if forced else F.lit(False)
    rows = parts.where(_any([F.col("vendor").ilike(p) for p in patterns]) | force)
    flag = lambda of, name: of.select("part_id").distinct().withColumn(name, F.lit(True))
    for of, name in ((have, "have"), (dead, "dead"), (qualified, "qualified")):
        rows = rows.join(flag(of, name), "part_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    rows = rows.where(force | ~(F.col("dead") | F.col("qualified")))
    missing = F.sum((~F.col("have")).cast("long")).over(Window.partitionBy("vendor").orderBy("mpn", "part_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("turn", missing).where(~F.col("have") & (F.col("turn") <= limit)).drop("have", "dead", "qualified")
