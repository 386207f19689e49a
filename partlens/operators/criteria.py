"""Three-valued criteria over candidates, their score, tier and order.

A criterion is met, missed or unknown. Its column is true, false or null; what isn't asked for makes no column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import vocabulary as V
from partlens.functions.requirement import Requirement

from . import resolve as R

#: Points for space qualification by variant, else by the general word.
VARIANT_POINTS = {"space_qualified": 6.0, "space_grade": 5.0}
SPACE_POINTS = {"qualified": 6.0, "hi_rel": 4.0, "qualifiable": 1.0}
#: Other names that a declared specification is stored under.
ALSO = {"nf_db": "noise_nf_db"}


def spec(key: str) -> Column:
    return F.try_element_at("specs", F.lit(key))


def number(key: str) -> Column:
    return spec(key)["value"]


def text(key: str) -> Column:
    return spec(key)["text"]


def space_points() -> Column:
    table = lambda values: F.create_map(*(F.lit(v) for pair in values.items() for v in pair))
    return F.coalesce(F.try_element_at(table(VARIANT_POINTS), text("space_variant")), F.try_element_at(table(SPACE_POINTS), text("space")), F.lit(0.0))


def cutoff(asked: Requirement) -> Column:
    """The part's cutoff: the lower edge of a high pass, else the upper one."""
    band = spec("freq_ghz")
    high = F.coalesce(F.col("subcategory"), F.lit(asked.subcategory)) == "hpf" if asked.filter_response != "highpass" else F.lit(True)
    return F.when(F.coalesce(high, F.lit(False)), band["lo"]).otherwise(band["hi"])


def connector_fits(have: Column, want: str) -> Column:
    return F.contains(F.upper(F.replace(have, F.lit(" "), F.lit(""))), F.lit(want.replace(" ", "").upper()))


def _declared(key: str, kind: str, tolerance: float, want) -> Column:
    """A declared specification against what is asked: at least, at most, about, or one of some texts (case doesn't matter)."""
    if kind == "text":
        options = [str(x).strip().lower() for x in (want if isinstance(want, (list, tuple, set)) else [want])]
        return F.lower(F.trim(text(key))).isin(options)
    have = F.coalesce(number(key), number(ALSO[key])) if key in ALSO else number(key)
    return have >= want if kind == "min" else have <= want if kind == "max" else F.abs(have - want) <= tolerance


def states(asked: Requirement) -> dict[str, Column]:
    """The criteria by name. Declared specifications that share a criterion's name share its place: the last one asked for counts."""
    found: dict[str, Column] = {}
    if asked.category:
        said = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))))
        named = reduce(lambda a, b: a | b, [F.contains(said, F.lit(w.lower())) for w in V.synonyms(asked.category)])
        known = (F.trim(said) != "") | F.col("category").isNotNull()
        found["category"] = F.when(known, F.coalesce(F.col("category") == asked.category, F.lit(False)) | named)
    if asked.freq_ghz:
        band = spec("freq_ghz")
        found["freq"] = F.when(band["lo"].isNotNull() & band["hi"].isNotNull(), (band["lo"] <= asked.freq_ghz[0]) & (band["hi"] >= asked.freq_ghz[1]))
    if asked.cutoff_ghz is not None:
        found["cutoff"] = F.abs(cutoff(asked) - asked.cutoff_ghz) <= max(0.1, 0.1 * asked.cutoff_ghz)
    if asked.temp_k is not None and asked.temp_k <= 120:
        found["cryo"] = F.when(spec("cryo").isNotNull(), F.coalesce(number("cryo") != 0, F.lower(text("cryo")).isin("yes", "true")))
    if asked.gain_db_min is not None:
        found["gain"] = number("gain_db") >= asked.gain_db_min
    if asked.noise_k_max is not None:
        found["noise"] = number("noise_k") <= asked.noise_k_max
    if asked.attenuation_db is not None:
        found["atten"] = F.abs(number("attenuation_db") - asked.attenuation_db) < 0.6
    if asked.impedance_ohm is not None:
        found["imp"] = F.abs(number("impedance_ohm") - asked.impedance_ohm) < 0.5
    if asked.ports is not None:
        found["ports"] = number("ports") == asked.ports
    if asked.connector:
        found["connector"] = connector_fits(text("connector"), asked.connector)
    if asked.mount == "bulkhead":
        found["bulkhead"] = F.when(spec("bulkhead").isNotNull(), F.coalesce(number("bulkhead") != 0, F.lower(text("bulkhead")).isin("yes", "true")))
    if asked.package:
        found["pkg"] = F.when(text("mount_type") != "unknown", text("mount_type") == asked.package)
    if asked.space:
        found["space"] = F.when(text("space") == "qualified", True)  # a page can't show that a part isn't qualified
    if asked.max_lead_weeks is not None:
        found["lead"] = number("lead_weeks") <= asked.max_lead_weeks
    for key, wanted, kind, name, tolerance in V.SPECS:
        if asked.specs.get(wanted) is not None:
            found[name] = _declared(key, kind, tolerance, asked.specs[wanted])
    return found


def ways() -> Column:
    """Outputs of a divider: as stated, one less than its ports, or `N-way` in its texts; 0 if unknown."""
    ports = number("ports")
    said = F.concat_ws(" ", "title", "description", "model", text("subcategory_hint"))
    return F.coalesce(F.when(number("no_of_ways") > 0, F.floor(number("no_of_ways"))), F.when((ports >= 3) & (ports == F.floor(ports)), ports - 1), F.nullif(F.regexp_extract(said, r"(?i)(\d+)[ -]*way\b", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def evaluate(candidates: DataFrame, asked: Requirement) -> DataFrame:
    """criteria (name -> met, miss or unknown), met, miss, unknown, space_score, fit_score, tier, and for filters cutoff_delta."""
    found = states(asked)
    word = lambda s: F.when(s, "met").when(~s, "miss").otherwise("unknown")
    named = F.create_map(*(c for name, s in found.items() for c in (F.lit(name), word(s)))) if found else F.create_map().cast("map<string,string>")
    out = candidates.withColumn("criteria", named).withColumn("space_score", space_points())
    count = lambda w: F.size(F.filter(F.map_values("criteria"), lambda x: x == w))
    out = out.withColumns({w: count(w) for w in ("met", "miss", "unknown")})
    out = out.withColumn("fit_score", R.fit(F.col("met"), F.col("unknown"), max(1, len(found)), F.col("space_score"))).withColumn("tier", R.tier(F.col("miss"), F.col("unknown")))
    if asked.cutoff_ghz is not None:
        out = out.withColumn("part_cutoff_ghz", cutoff(asked)).withColumn("cutoff_delta", F.coalesce(F.abs(cutoff(asked) - asked.cutoff_ghz), F.lit(float("inf"))))
    return out


def order(asked: Requirement) -> list[Column]:
    """Nearest cutoff if one is asked for, tier, fit, ways of dividers, unknowns, space, met, price (stated ones first), then the part."""
    by_ways = F.when(F.col("category") == "divider", F.coalesce(F.nullif(ways(), F.lit(0.0)), F.lit(1e6))).otherwise(0.0)
    first = [F.col("cutoff_delta")] if asked.cutoff_ghz is not None else []
    return [*first, F.col("tier"), F.desc("fit_score"), by_ways, F.col("unknown"), F.desc("space_score"), F.desc("met"), F.asc_nulls_last(number("price_usd")), F.col("part_id")]


def rank(candidates: DataFrame, asked: Requirement, top: int | None = None) -> DataFrame:
    """The candidates in order, with their place; with `top`, the first ones alone (which sorts no more than it keeps)."""
    out = evaluate(candidates, asked)
    out = out.where(F.try_element_at("specs", F.lit("_error")).isNull()).orderBy(*order(asked))
    return out.limit(top) if top else out


def strong(ranked: DataFrame) -> bool:
    """Whether any candidate is of tier A or B: if not, other sources are worth asking."""
    return not ranked.where(F.col("tier").isin("A", "B")).isEmpty()
