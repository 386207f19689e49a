"""Values mined from datasheet texts: the part's own band among all ranges, specifications in prose and in table rows, evidence of space use."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import parsing as P
from partlens.functions import readings as Z
from partlens.functions import text as X

#: Confidence of what is mined.
MINED = 0.45
#: Specifications as texts name them, their keys and units; a number follows within some signs.
PROSE = """
nf_db | noise figure, nf | dB
p1db_dbm | p1db, p1 db, 1 db compression, output p1db | dBm
oip3_dbm | oip3, ip3, third order intercept | dBm
psat_dbm | psat, saturated output power, output power | dBm
gain_db | small signal gain, gain | dB
isolation_db | isolation | dB
insertion_loss_db | insertion loss | dB
conversion_loss_db | conversion loss | dB
coupling_db | coupling | dB
directivity_db | directivity | dB
"""
#: Words before a range that speak for it, against it, of another port, and of loose figures.
FOR_IT = "rf, rf frequency, rf range, frequency range, operating frequency, passband, frequency, freq"
AGAINST_IT = "series, family, portfolio, key features, product line, catalog, other models, selection guide, available in, models from, model from"
OTHER_PORT = "if, lo, local oscillator, intermediate frequency"
LOOSE = "typ, typical, wide bandwidth, up to, nominal"
NO_BAND = "temperature, storage, humidity, altitude"
#: What speaks for and against space use: weight, label, phrases.
EVIDENCE = """
30 | MIL-PRF-38534 Class K | 38534 class k, class k 38534
30 | MIL-PRF-38535 Class V/QML-V | 38535, qml v, class v
28 | JANS | jans
26 | ESCC | escc, european space components
26 | radiation hardened | radiation hardened, rad hard, radhard
22 | TID rating | krad
22 | SEL/SEE rating | single event, mev cm
20 | space qualified | space qualified, qualified for space, space grade
18 | Class S | class s
12 | hermetic | hermetic, hermetically
12 | MIL-STD-883 | mil std 883, mil std883
10 | screened | screened, screening, burn in, burnin
8 | outgassing | outgassing, tml
6 | LTCC/ceramic | ltcc, ceramic, alumina
5 | GaAs | gaas, gallium arsenide
5 | GaN | gan, gallium nitride
4 | Kovar/gold | kovar, gold plated, au plated
4 | MMIC | mmic
-30 | commercial only | commercial use only, commercial grade only, not for space
-14 | plastic encapsulated | plastic encapsulated, plastic package
-10 | consumer/automotive | consumer, automotive
"""


def space_evidence(text: Column) -> Column:
    """struct(percent, why): weights of the phrases found, each once, within 0 and 100; null where nothing speaks either way."""
    rules = [tuple(c.strip() for c in line.split("|")) for line in EVIDENCE.strip().splitlines()]
    line = lambda t: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))

    def hits(said: Column) -> Column:
        every = [F.when(F.exists(F.array(*(F.lit(f" {p.strip()} ") for p in phrases.split(","))), lambda p: F.contains(said, p)), F.struct(F.lit(float(w)).alias("w"), F.lit(label if float(w) > 0 else f"NOT: {label}").alias("label"))) for w, label, phrases in rules]
        return F.filter(F.array(*every), lambda h: h.isNotNull())

    total = lambda h: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.aggregate(h, F.lit(0.0), lambda a, x: a + x["w"])))
    return P.let(P.let(line(text), hits), lambda h: F.when(F.size(h) > 0, F.struct(total(h).alias("percent"), F.array_join(F.transform(h, lambda x: x["label"]), ", ").alias("why"))))


def prose(text: Column) -> Column:
    """Entries (key, value, unit): of each specification the first number in its unit that follows one of its names in a sentence, else one that follows the unit (table rows)."""
    found = []
    for line in PROSE.strip().splitlines():
        key, names, unit = (c.strip() for c in line.split("|"))
        words = "|".join(re.sub(r" ", r"[\\s-]*", n.strip()) for n in names.split(","))
        forward = rf"(?i)\b(?:{words})\b[^.\n0-9+-]{{0,40}}?([+-]?\d+(?:\.\d+)?)\s*{unit}\b"
        row = rf"(?i)\b(?:{words})(?:\s*\((?:min|typ|max)\))?\s*{unit}\s+([+-]?\d+(?:\.\d+)?)"
        value = F.coalesce(F.nullif(F.regexp_extract(text, forward, 1), F.lit("")).try_cast("double"), F.nullif(F.regexp_extract(text, row, 1), F.lit("")).try_cast("double"))
        found.append(F.when(value.isNotNull(), Z._entry(key, value, None, unit)))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def own_band(texts: DataFrame, key: str, head: int = 6000) -> DataFrame:
    """key, lo, hi (GHz): of all ranges with a unit the one whose surroundings speak most for it; the first of equal ones; ranges in the head before all others.

    Texts are cut at their ranges, so what stands before and after each is at hand without positions.
    """
    unit, value = r"(?:THz|GHz|MHz|kHz)", r"\d+(?:\.\d+)?"
    # words and dashes between the two ends of a range
    pattern = rf"(?i)(?<![\w.])(?:DC|{value})\s*{unit}?\s*(?:-|–|—|to|through)\s*{value}\s*{unit}\b"
    rows = texts.select(key, F.col("text"))
    rows = rows.select(key, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), F.split("text", pattern, -1).alias("between"))
    rows = rows.select(key, F.posexplode("found").alias("n", "said"), "between")
    before, after = F.get("between", F.col("n")), F.get("between", F.col("n") + 1)
    at = F.aggregate(F.slice("between", F.lit(1), F.col("n") + 1), F.lit(0), lambda a, x: a + F.char_length(x))
    near = lambda x, size: F.right(x, F.lit(size))
    has = lambda x, terms: P.spoken(x, terms).cast("int")
    ahead = F.left(after, F.lit(40))
    score = (
        -6 * has(near(before, 90), AGAINST_IT) + 3 * has(near(before, 90), FOR_IT) - 5 * has(near(before, 26), OTHER_PORT)
        - 2 * F.greatest(has(near(before, 90), LOOSE), has(ahead, LOOSE)) - 8 * has(near(before, 90), NO_BAND) + (F.char_length(F.regexp_replace(ahead, "[^0-9]", "")) >= 3).cast("int")
    )
    rows = rows.select(key, "n", P.band_ghz(F.col("said")).alias("b"), score.alias("score"), (at < head).cast("int").alias("first"))
    rows = rows.where("b.hi > b.lo AND b.hi <= 500 AND b.hi >= 1e-6")
    best = F.max_by("b", F.struct("first", "score", -F.col("n")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.lo", "b.hi")


def mined(texts: DataFrame, key: str) -> DataFrame:
    """key, spec, value, text, unit: all that is mined from texts(key, text), the band also as freq_ghz would be stored."""
    told = space_evidence(F.col("text"))
    throws = P.throw_layout(F.left("text", F.lit(4000)))
    extra = F.array(F.when(told.isNotNull(), Z._entry("space_score_pct", told["percent"], None, "%")), F.when(told.isNotNull(), Z._entry("space_evidence", None, F.substring(told["why"], 1, 180))), F.when(throws != "", Z._entry("throw_config", None, throws)))
    rows = texts.select(key, F.explode(F.concat(prose(F.col("text")), F.filter(extra, lambda e: e.isNotNull()))).alias("e"))
    rows = rows.select(key, F.col("e.key").alias("spec"), F.col("e.value").alias("value"), F.col("e.text").alias("text"), F.col("e.unit").alias("unit"))
    band = own_band(texts, key)
    edges = band.select(key, F.explode(F.array(F.struct(F.lit("freq_min").alias("spec"), F.col("lo").alias("value")), F.struct(F.lit("freq_max").alias("spec"), F.col("hi").alias("value")))).alias("e"))
    return rows.unionByName(edges.select(key, "e.spec", "e.value", F.lit(None).cast("string").alias("text"), F.lit("GHz").alias("unit")))


def enriched(parts: DataFrame, library: DataFrame, texts: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Spec rows mined for parts(part_id, mpn) from their datasheets, and the new cache.

    library(key, path, identity): the file of each loose part number; texts(path, text); cache(path, identity, spec, value, text,
    unit): what was mined from the same file before is taken from there, and only other files are read.
    """
    wanted = parts.withColumn("key", X.loose(F.col("mpn"))).join(library, "key")
    files = wanted.select("path", "identity").distinct()
    fresh = files if cache is None else files.join(cache.select("path", "identity").distinct(), ["path", "identity"], "left_anti")
    new = mined(texts.join(fresh.select("path"), "path", "left_semi"), "path").join(fresh, "path")
    own = new if cache is None else new.unionByName(cache.join(files, ["path", "identity"], "left_semi"), allowMissingColumns=True)
    none = F.lit(None).cast("double")
    rows = wanted.select("part_id", "path").join(own, "path").select("part_id", F.col("spec").alias("key"), none.alias("value_min"), F.col("value").alias("value_typ"), none.alias("value_max"), F.substring("text", 1, 60).alias("value_text"), "unit", F.lit("datasheet").alias("method"), F.lit(MINED).alias("confidence"), F.concat(F.lit("mined from "), F.substring_index("path", "/", -1)).alias("snippet"))
    return rows, own.select("path", "identity", "spec", "value", "text", "unit")


def conflicts(found: DataFrame, stored: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """part_id, key, value, stored: mined and stored values that differ by more than the tolerance."""
    rows = found.join(stored.withColumnRenamed("value", "stored"), ["part_id", "key"]).where("value IS NOT NULL AND stored IS NOT NULL")
    return rows.where(F.abs(F.col("stored") - F.col("value")) / F.greatest(F.abs("stored"), F.abs("value"), F.lit(1e-9)) > tolerance)
