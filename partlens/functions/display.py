"""How values read in grids and reports, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The unit a key's ending stands for.
UNITS = {"ghz": "GHz", "dbm": "dBm", "db": "dB", "ns": "ns", "ohm": "Ω", "ma": "mA", "mhz": "MHz", "pct": "%", "w": "W", "v": "V", "c": "°C", "krad": "kRad", "mev": "MeV"}
#: Words that aren't capitalised like others.
ACRONYMS = {"vswr": "VSWR", "oip3": "OIP3", "iip3": "IIP3", "nf": "NF", "p1db": "P1dB", "psat": "Psat", "tid": "TID", "sel": "SEL", "rf": "RF", "dc": "DC", "il": "IL", "sma": "SMA", "absmax": "abs-max", "temp": "Temp", "pae": "PAE"}
#: Order and marks of criteria, words for mounts and space qualification.
CRITERIA = "category freq cutoff cryo gain noise nf p1db oip3 cl isol cpl pwr atten imp ports connector bulkhead pkg space lead".split()
MOUNTS = {"connectorized": "conn", "smt": "SMT", "die": "die", "flange": "flange"}
VARIANTS = {"space_qualified": "space-qual", "space_grade": "space-grade"}
SPACE = {"qualified": "space-qual", "hi_rel": "hi-rel", "qualifiable": "upscreen?"}


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))


def short(x: Column) -> Column:
    """A number with six significant digits at most and no zeros at its end."""
    size = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
    plain = F.format_string("%.6f", F.round(x, 6))
    trimmed = F.regexp_replace(F.regexp_replace(F.when(size >= 0, F.substring_index(plain, ".", 1)).otherwise(plain), "^$", "0"), "^$", "0")
    digits = F.coalesce(*(F.when(size == k, F.format_string(f"%.{5 - k}f", x)) for k in range(6)), F.when(size < 0, F.format_string("%.6f", x)), trimmed)
    return F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)


def band(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNotNull() & hi.isNotNull(), F.concat(short(lo), F.lit("–"), short(hi))).when(lo.isNotNull(), F.concat(F.lit("≥"), short(lo))).when(hi.isNotNull(), F.concat(F.lit("≤"), short(hi))).otherwise("")


def time_ns(x: Column) -> Column:
    """Nanoseconds in the unit that reads best."""
    return F.coalesce(F.when(x < 1e3, F.concat(short(x), F.lit(" ns"))).when(x < 1e6, F.concat(short(x / 1e3), F.lit(" µs"))).otherwise(F.concat(short(x / 1e6), F.lit(" ms"))), F.lit(""))


def label(key: Column) -> Column:
    """A key as words: its ending as a unit in brackets, known acronyms as they are written."""
    parts = F.split(key, "_")
    unit = F.when(F.size(parts) > 1, F.try_element_at(_table(UNITS), F.element_at(parts, -1)))
    words = F.when(unit.isNotNull(), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    said = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(_table(ACRONYMS), F.lower(w)), F.initcap(w)))
    return F.concat(F.array_join(said, " "), F.coalesce(F.concat(F.lit(" ("), unit, F.lit(")")), F.lit("")))


def lead(weeks: Column) -> Column:
    return F.when(weeks == 0, "in stock").when(weeks.isNotNull(), F.concat(F.lit("~"), short(weeks), F.lit(" wk"))).otherwise("?")


def price(usd: Column) -> Column:
    """Whole dollars; parts without a price are quoted on request."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(F.bround(usd), 0)), F.lit("RFQ"))


def mount(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(MOUNTS), kind), F.lit("?"))


def space(variant: Column, word: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(VARIANTS), variant), F.try_element_at(_table(SPACE), word), F.lit("—"))


def criteria(states: Column) -> Column:
    """The criteria of a map in their order, each with its mark."""
    marks = _table({"met": "✓", "miss": "✗", "unknown": "?"})
    said = F.transform(F.array(*map(F.lit, CRITERIA)), lambda c: F.concat(c, F.try_element_at(marks, F.try_element_at(states, c))))
    return F.array_join(F.filter(said, lambda x: x.isNotNull()), " ")


def space_percent(score: Column) -> Column:
    """struct(text, shade): a missing score stays blank and is not 0; shades change at 40 and 70."""
    shade = F.when(score >= 70, "high").when(score >= 40, "middle").when(score.isNotNull(), "low").otherwise("neutral")
    return F.struct(F.coalesce(F.concat(F.bround(score).cast("long").cast("string"), F.lit("%")), F.lit("")).alias("text"), shade.alias("shade"))


def cell_state(state: Column, has_value: Column) -> Column:
    return F.when(state.isin("met", "miss", "unknown"), state).when(has_value, "neutral").otherwise("na")


def interface(mount_type: Column, package: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(mount_type, F.lit("")), F.nullif(package, F.lit("")), F.lit("—")), 1, 22)


def subtype(subcategory: Column, *stated: Column) -> Column:
    """The stored subcategory, else the first stated kind."""
    first = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (subcategory, *stated)), F.lit(""))
    return F.substring(F.replace(first, F.lit("_"), F.lit(" ")), 1, 22)


def ranges(found: Column) -> Column:
    """Array of struct(key, lo, hi, n) as `key lo..hi (n vals)`, joined by semicolons."""
    return F.array_join(F.transform(found, lambda r: F.concat(r["key"], F.lit(" "), short(r["lo"]), F.lit(".."), short(r["hi"]), F.lit(" ("), r["n"].cast("string"), F.lit(" vals)"))), "; ")


def source(url: Column) -> Column:
    """Where a part comes from, by its address."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return F.when(F.contains(u, F.lit("everythingrf")), "everythingRF").when(F.contains(u, F.lit("satnow")), "SATNow").when(F.contains(u, F.lit("digikey")) | F.contains(u, F.lit("digi-key")), "DigiKey").otherwise("other")
