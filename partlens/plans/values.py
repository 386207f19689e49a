"""Values read from texts and cells: texts are made from columns in known forms, the SQL says what they state."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.functions import numbers as N
from partlens.functions import parsing as P
from partlens.functions import readings as Z
from partlens.functions import text as X

from .registry import query, r6

PART = "p_partkey AS part_id"


def made(t, *columns):
    return t("part").selectExpr(PART, "p_size", *columns)


@query("""SELECT p_partkey AS part_id, CASE p_size % 7 WHEN 0 THEN 0.0 WHEN 5 THEN 0.0 WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size / 1000.0 WHEN 3 THEN 0.5 WHEN 4 THEN (p_size + 300) / 1000.0 END AS lo,
 CASE p_size % 7 WHEN 6 THEN NULL WHEN 2 THEN (p_size + 7) / 1000.0 WHEN 3 THEN p_size::DOUBLE WHEN 4 THEN (p_size + 300) / 1000.0 WHEN 1 THEN p_size + 3.5 ELSE p_size::DOUBLE END AS hi FROM part""")
def frequency_bands(t):
    """DC and `up to`, units at either end, mixed units, bare numbers, what isn't plausible."""
    text = "CASE p_size % 7 WHEN 0 THEN 'DC-' || p_size || ' GHz' WHEN 1 THEN p_size || ' to ' || (p_size + 3) || '.5 GHz' WHEN 2 THEN p_size || ' - ' || (p_size + 7) || ' MHz' WHEN 3 THEN '500 MHz to ' || p_size || ' GHz' WHEN 4 THEN '' || (p_size + 300) WHEN 5 THEN 'up to ' || p_size || ' GHz' ELSE (p_size + 1000) || ',000 GHz' END AS text"
    band = P.band_ghz(F.col("text"))
    return made(t, text).select("part_id", band["lo"].alias("lo"), band["hi"].alias("hi"))


@query("""SELECT p_partkey AS part_id, CASE p_size % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 1e3 WHEN 2 THEN p_size * 1e6 WHEN 3 THEN p_size::DOUBLE END AS lo, CASE p_size % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 1e3 WHEN 2 THEN p_size * 1e6 WHEN 3 THEN p_size * 2e3 END AS hi FROM part""")
def switching_times(t):
    text = "CASE p_size % 5 WHEN 0 THEN p_size || ' ns' WHEN 1 THEN p_size || 'us typ.' WHEN 2 THEN p_size || ' msec' WHEN 3 THEN p_size || ' ns to ' || (p_size * 2) || ' µs' ELSE '' || p_size END AS text"
    span = P.time_ns(F.col("text"))
    return made(t, text).select("part_id", span["lo"].alias("lo"), span["hi"].alias("hi"))


THROW = "CASE n WHEN 1 THEN 'ST' WHEN 2 THEN 'DT' ELSE n || 'T' END"


@query(f"""SELECT part_id, CASE k WHEN 0 THEN 'SP' || {THROW} WHEN 1 THEN 'SP' || {THROW} WHEN 2 THEN 'DP' || {THROW} WHEN 3 THEN 'SP4T' WHEN 4 THEN 'TRANSFER' WHEN 5 THEN '' ELSE '3P' || {THROW} END AS layout FROM (SELECT p_partkey AS part_id, p_size % 7 AS k, 1 + p_size % 16 AS n FROM part)""")
def throw_layouts(t):
    text = "CASE p_size % 7 WHEN 0 THEN 'an SP' || (1 + p_size % 16) || 'T switch' WHEN 1 THEN '1P-' || (1 + p_size % 16) || 'T' WHEN 2 THEN 'DP' || (1 + p_size % 16) || 'T, reflective' WHEN 3 THEN 'single pole four throw' WHEN 4 THEN 'coaxial transfer switch' WHEN 5 THEN 'SP' || (40 + p_size) || 'T' ELSE '3p' || (1 + p_size % 16) || 't' END AS text"
    return made(t, text).select("part_id", P.throw_layout(F.col("text")).alias("layout"))


PACKS = {"QFN-16, QFN-16": ("QFN-16", "surface-mount", "QFN", None), "Connectorized-SMA": ("Connectorized-SMA", "connectorized", "SMA", None), "WR-90 waveguide, flange": ("WR-90 waveguide, flange", "waveguide", "WR-90", None), "Bare Die, bare die": ("Bare Die", "die", None, None), "hermetic module TO-8": ("hermetic module TO-8", "module", "TO-8", True), "drop-in": ("drop-in", "drop-in", None, None), "plain": ("plain", None, None, None)}
PICK = "CASE p_size % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(PACKS)) + " END"
TOLD = lambda j: "CASE p_size % 7 " + " ".join(f"WHEN {i} THEN {'NULL' if v[j] is None else 'true' if v[j] is True else repr(v[j])}" for i, v in enumerate(PACKS.values())) + " END"


@query(f"SELECT p_partkey AS part_id, {TOLD(0)} AS text, {TOLD(1)} AS mount, {TOLD(2)} AS body, {TOLD(3)} AS hermetic FROM part")
def packages(t):
    rows = made(t, f"{PICK} AS text").select("part_id", P.dedupe_commas(F.col("text")).alias("text"))
    return rows.withColumn("p", P.package(F.col("text"))).select("part_id", "text", "p.mount", "p.body", "p.hermetic")


NAME = "CASE p_size % 4 WHEN 0 THEN 'T' || p_size || 'a - Gain (ch-' || p_partkey || ' band-X-low ch-' || p_size || ')' WHEN 1 THEN 'M' || (p_size % 10) || ' - Loss at 3' WHEN 2 THEN 'plain name' ELSE p_size || '-Noise (f-' || p_size || '.5 odd)' END"


@query("""SELECT part_id, CASE k WHEN 2 THEN '99' WHEN 1 THEN CAST(p_size % 10 AS VARCHAR) ELSE substr(CAST(p_size AS VARCHAR), 1, 2) END AS digit, CASE k WHEN 0 THEN 'Gain' WHEN 1 THEN 'Loss at 3' WHEN 2 THEN 'plain name' ELSE 'Noise' END AS type,
 CASE k WHEN 0 THEN CAST(p_size AS VARCHAR) END AS ch, CASE k WHEN 0 THEN 'low' END AS band_x, CASE k WHEN 3 THEN p_size || '.5' END AS f, CASE k WHEN 0 THEN array_to_string(list_sort(list_distinct(['Gain', 'T' || p_size || 'a', 'band-X', 'low', 'ch-' || p_size, 'ch-' || part_id])), '|') END AS tokens FROM (SELECT p_partkey AS part_id, p_size % 4 AS k, p_size FROM part)""")
def test_names(t):
    spec, name = P.spec_of(F.col("name")), F.col("name")
    rows = made(t, f"{NAME} AS name").withColumn("s", spec)
    value = lambda k: F.try_element_at(F.col("s.values"), F.lit(k))
    tokens = F.when(F.col("p_size") % 4 == 0, F.array_join(P.name_tokens(name), "|"))
    return rows.select("part_id", P.digit_group(name).alias("digit"), F.col("s.type").alias("type"), value("ch").alias("ch"), value("band-X").alias("band_x"), value("f").alias("f"), tokens.alias("tokens"))


@query("""SELECT p_partkey AS part_id, CASE k WHEN 0 THEN p_size * 1000.0 + 0.5 WHEN 1 THEN 0.0 WHEN 2 THEN NULL WHEN 3 THEN -p_size * 1.0 ELSE p_size * 1.0 END AS number, CASE k WHEN 3 THEN -p_size * 1.0 WHEN 4 THEN p_size * 1.0 END AS signed FROM (SELECT *, p_size % 5 AS k FROM part)""")
def cell_numbers(t):
    text = "CASE p_size % 5 WHEN 0 THEN p_size || ',000.5 V' WHEN 1 THEN 'DC' WHEN 2 THEN 'None' WHEN 3 THEN '-' || p_size ELSE '± ' || p_size END AS text"
    signed = F.when(F.col("p_size") % 5 >= 3, Z.signed_number(F.regexp_replace("text", "^-", "−")))
    return made(t, text).select("part_id", Z.number_of(F.col("text")).alias("number"), signed.alias("signed"))


@query("""SELECT p_partkey AS part_id, round(CASE k WHEN 0 THEN p_size / 1000.0 WHEN 1 THEN p_size * 1.0 WHEN 2 THEN p_size / 1000.0 WHEN 3 THEN (p_size + 400) / 1000.0 WHEN 4 THEN (p_size + 1e7) / 1e9 WHEN 5 THEN p_size * 1.0 END, 9) AS ghz FROM (SELECT *, p_size % 7 AS k FROM part)""")
def workbook_frequencies(t):
    """The cell's unit, the heading's, then the size of the number; text without a number is nothing."""
    cell = "CASE p_size % 7 WHEN 0 THEN p_size || ' MHz' WHEN 1 THEN p_size || ' GHz' WHEN 2 THEN '' || p_size WHEN 3 THEN '' || (p_size + 400) WHEN 4 THEN '' || (p_size + 10000000) WHEN 5 THEN '' || p_size ELSE 'None' END AS cell"
    head = "CASE p_size % 7 WHEN 1 THEN 'Freq Min (MHz)' WHEN 2 THEN 'Freq Min (MHz)' ELSE 'Freq Min' END AS head"
    return made(t, cell, head).select("part_id", F.round(Z.workbook_ghz(F.col("cell"), F.col("head")), 9).alias("ghz"))


KEYED = {"Frequency Response IF Min (MHz)": "if_freq_min", "Frequency Response RF Max": "freq_max", "OIP3 (dBm)": "oip3_dbm", "Gain Typ": "gain_db", "Package": "package", "Package Area (mm2)": "package_area_mm2", "1ku List Price": "price_usd", "Row Colour": None}


@query("SELECT p_partkey AS part_id, " + "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(KEYED.values())) + " END AS key FROM part")
def heading_keys(t):
    head = "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KEYED)) + " END AS head"
    return made(t, head).select("part_id", Z.ruled(F.col("head"), Z.COLUMNS).alias("key"))


@query("""SELECT p_partkey AS part_id, CASE k WHEN 0 THEN -p_size::DOUBLE END AS lo, CASE WHEN k IN (1, 2) THEN p_size::DOUBLE END AS typ, CASE k WHEN 0 THEN p_size + 5.0 END AS hi, CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'dB' WHEN 2 THEN '' END AS unit FROM (SELECT *, p_size % 4 AS k FROM part)""")
def typed_cells(t):
    text = "CASE p_size % 4 WHEN 0 THEN '-' || p_size || ' to +' || (p_size + 5) || ' °C' WHEN 1 THEN p_size || ' dB' WHEN 2 THEN p_size || ' WQFN' ELSE 'none' END AS text"
    return made(t, text).withColumn("v", Z.value_of("num", F.col("text"))).select("part_id", F.col("v.value_min").alias("lo"), F.col("v.value_typ").alias("typ"), F.col("v.value_max").alias("hi"), "v.unit")


@query("""SELECT p_partkey AS part_id, CASE k WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN round_even(10 * log10(p_size * 1000.0), 1) WHEN 2 THEN round_even(10 * log10(p_size), 1) WHEN 3 THEN CASE WHEN p_size * 10 <= 100 THEN round_even(10 * log10(p_size * 10000.0), 1) END END AS dbm,
 CASE k WHEN 1 THEN p_size::DOUBLE WHEN 3 THEN p_size * 10.0 END AS watts FROM (SELECT *, p_size % 4 AS k FROM part WHERE p_size > 0)""")
def power_cells(t):
    rows = made(t, "CAST(CASE p_size % 4 WHEN 3 THEN p_size * 10 ELSE p_size END AS DOUBLE) AS v", "CASE p_size % 4 WHEN 0 THEN 'dBm' WHEN 1 THEN 'W' WHEN 2 THEN 'mW' ELSE '' END AS u").where("p_size > 0")
    out = Z.power_dbm(F.col("v"), F.col("u"))
    return rows.select("part_id", out["dbm"].alias("dbm"), out["watts"].alias("watts"))


@query("""SELECT p_partkey AS part_id, round(CASE k WHEN 0 THEN p_size / 1000.0 WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN p_size * 1000.0 WHEN 4 THEN p_size END, 6) AS value, CASE k WHEN 0 THEN 'GHz' WHEN 1 THEN 'ns' WHEN 2 THEN 'mA' WHEN 4 THEN 'dBm' ELSE '' END AS unit FROM (SELECT *, p_size % 5 AS k FROM part)""")
def embedded_units(t):
    """Frequencies, times and currents of embedded records in our units; a time in an unknown unit is refused."""
    rows = made(t, "CASE p_size % 5 WHEN 0 THEN 'MHz' WHEN 1 THEN 'us' WHEN 2 THEN 'A' WHEN 3 THEN 'furlong' ELSE 'dBm' END AS u", "CASE p_size % 5 WHEN 0 THEN 'freq' WHEN 1 THEN 'time_ns' WHEN 2 THEN 'ma' WHEN 3 THEN 'time_ns' ELSE 'power' END AS f")
    return rows.withColumn("s", Z.scaled(F.col("p_size").cast("string"), F.col("u"), F.col("f"))).select("part_id", F.round("s.value", 6).alias("value"), "s.unit")


@query("""SELECT part_id, key, round(value, 6) AS value FROM (SELECT p_partkey AS part_id, unnest(CASE p_size % 4 WHEN 0 THEN [{'key': 'freq_min', 'value': p_size / 1000.0}, {'key': 'freq_max', 'value': (p_size + 9) / 1000.0}] WHEN 1 THEN [{'key': 'conversion_gain_db', 'value': -p_size * 1.0}, {'key': 'conversion_loss_db', 'value': p_size * 1.0}]
 WHEN 2 THEN [{'key': 'freq_max', 'value': p_size * 1.0}] ELSE [] END, recursive := true) FROM part WHERE p_size > 0)""")
def table_cells(t):
    rows = made(t, "CASE p_size % 4 WHEN 0 THEN 'freq_range' WHEN 1 THEN 'conversion_gain_db' WHEN 2 THEN 'freq_max' ELSE 'nf_db' END AS k", "CASE p_size % 4 WHEN 0 THEN p_size || ' to ' || (p_size + 9) WHEN 1 THEN '-' || p_size WHEN 2 THEN '' || p_size ELSE 'TBD' END AS c", "CASE p_size % 4 WHEN 0 THEN 'MHz' WHEN 1 THEN 'dB' WHEN 2 THEN 'GHz' ELSE 'dB' END AS u").where("p_size > 0")
    return rows.select("part_id", F.explode(Z.absorbed(F.col("k"), F.col("c"), F.col("u"))).alias("e")).select("part_id", "e.key", F.round("e.value", 6).alias("value"))


@query("""SELECT part_id, key, round(value, 6) AS value FROM (SELECT p_partkey AS part_id, unnest(CASE p_size % 4 WHEN 0 THEN [{'key': 'freq_min', 'value': 1.0}, {'key': 'freq_max', 'value': p_size + 1.0}, {'key': 'psat_dbm', 'value': round_even(10 * log10(15000.0), 1)}] WHEN 1 THEN [{'key': 'freq_min', 'value': 0.0}, {'key': 'freq_max', 'value': p_size / 1000.0}, {'key': 'gain_db', 'value': p_size * 1.0}]
 WHEN 2 THEN [{'key': 'gain_range_db', 'value': p_size * 1.0}] ELSE [{'key': 'psat_dbm', 'value': p_size * 1.0}, {'key': 'nf_db', 'value': 2.0}] END, recursive := true) FROM part)""")
def description_specs(t):
    text = "CASE p_size % 4 WHEN 0 THEN '1GHz to ' || (p_size + 1) || 'GHz, 15W, GaN Power Amplifier' WHEN 1 THEN 'up to ' || p_size || ' MHz amplifier with ' || p_size || ' dB of gain' WHEN 2 THEN p_size || ' dB Linear-in-dB Variable Gain Amplifier' ELSE p_size || ' dBm amplifier, 2 dB noise figure' END AS text"
    return made(t, text).select("part_id", F.explode(Z.described(F.col("text"))).alias("e")).select("part_id", "e.key", F.round("e.value", 6).alias("value"))


@query("""SELECT p_partkey AS part_id, p_size::DOUBLE AS gain, 18.0 AS p1db, CAST(NULL AS DOUBLE) AS psat FROM part""")
def inline_specs(t):
    """`Label: value unit` pairs; a dash is no value, a second pair of a key doesn't count."""
    rows = made(t, "'ADM DC - 18 GHz P1dB: 18 dBm Gain: ' || p_size || ' dB Psat: - Gain: 99 dB' AS text").withColumn("e", Z.inline(F.col("text")))
    value = lambda k: F.get(F.filter("e", lambda x: x["key"] == k), F.lit(0))["value"]
    return rows.select("part_id", value("gain_db").alias("gain"), value("p1db_dbm").alias("p1db"), value("psat_dbm").alias("psat"))


MARKS = {"Switching Speed (Max)": ("switching speed", "switching_time_ns"), "Isolation, dB": ("isolation", "isolation_db"), "Insertion Loss (Typical)": ("insertion loss", "insertion_loss_db"), "Frequency:": ("frequency", "freq_ghz"), "Colour": ("colour", None)}


@query("SELECT p_partkey AS part_id, " + ", ".join("CASE p_size % 5 " + " ".join(f"WHEN {i} THEN {'NULL' if v[j] is None else repr(v[j])}" for i, v in enumerate(MARKS.values())) + f" END AS {n}" for j, n in enumerate(("bare", "key"))) + " FROM part")
def label_keys(t):
    rows = made(t, "CASE p_size % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(MARKS)) + " END AS label")
    return rows.select("part_id", Z.bare_label(F.col("label")).alias("bare"), Z.attribute(F.col("label"))["key"].alias("key"))


@query("""SELECT p_partkey AS part_id, round(CASE k WHEN 0 THEN 2.0 WHEN 1 THEN p_size - p_size * 0.1 / 2 WHEN 2 THEN p_size - 0.1 WHEN 3 THEN p_size END, 6) AS lo, round(CASE k WHEN 0 THEN p_size + 2.0 WHEN 1 THEN p_size + p_size * 0.1 / 2 WHEN 2 THEN p_size + 0.1 WHEN 3 THEN p_size END, 6) AS hi,
 round(CASE k WHEN 1 THEN p_size * 0.1 WHEN 2 THEN 0.2 END, 6) AS bandwidth FROM (SELECT *, p_size % 5 AS k FROM part WHERE p_size > 0)""")
def listed_bands(t):
    """A named band, a centre with a bandwidth in percent or MHz, a cutoff alone, none."""
    pair = lambda a, b: f"named_struct('label', '{a}', 'value', {b})"
    none = f"filter(array({pair('x', chr(39) * 2)}), x -> false)"
    text = f"CASE p_size % 5 WHEN 0 THEN array({pair('gain', chr(39) + '9 dB' + chr(39))}, {pair('frequency range', '2 || ' + chr(39) + ' to ' + chr(39) + ' || (p_size + 2) || ' + chr(39) + ' GHz' + chr(39))}) WHEN 1 THEN array({pair('center frequency', 'p_size || ' + chr(39) + ' GHz' + chr(39))}, {pair('bandwidth', chr(39) + '10 %' + chr(39))}) WHEN 2 THEN array({pair('centre frequency', 'p_size || ' + chr(39) + ' GHz' + chr(39))}, {pair('3 db bandwidth', chr(39) + '200 MHz' + chr(39))}) WHEN 3 THEN array({pair('cutoff frequency', 'p_size || ' + chr(39) + ' GHz' + chr(39))}) ELSE {none} END AS a"
    rows = made(t, text).where("p_size > 0").withColumn("b", Z.band_of(F.col("a")))
    return rows.select("part_id", F.round("b.lo", 6).alias("lo"), F.round("b.hi", 6).alias("hi"), F.round("b.bandwidth", 6).alias("bandwidth"))


CASED = {
    "category": (lambda c: Z.category_of_listing(F.lit(""), c), {"Space Qualified Band Pass Filter": "filter", "RF Balun Transformer": "balun", "Power Splitter 2-way": "divider", "odd thing": ""}),
    "section": (lambda c: Z.ruled(c, Z.SECTIONS, 1, "ic"), {"Low Noise Amplifiers": "amplifier", "SP4T Switches": "switch", "GaN HEMT": "transistor", "Misc": "ic"}),
    "product": (lambda c: Z.ruled(c, Z.PRODUCT_TYPES, 1, "ic"), {"Low-Noise Amplifiers (LNA)": "amplifier", "Demodulators": "modulator", "PLL Synthesizers": "synthesizer", "Cables": "ic"}),
    "filters": (lambda c: F.coalesce(Z.ruled(c, Z.FILTERS), F.lit("")), {"Band-Pass Filter": "bpf", "Notch filter": "bsf", "LPF 3 GHz": "lpf", "Absorber": ""}),
    "mount": (lambda c: F.coalesce(Z.ruled(c, Z.MOUNTED), F.lit("")), {"Surface Mount, 5x5": "smt", "Bare Die": "die", "Coaxial": "connectorized", "?": ""}),
    "space": (lambda c: Z.space_class(F.lit(""), c), {"Space Qualified LNA": "space_qualified", "Space Grade mixers": "space_grade", "EverythingRFSpaceQual": "space_qualified", "Commercial": None}),
    "adapter": (lambda c: Z.adapter_of(c), {"/x/ADI_Space_Portfolio.xlsx": "adi_space", "/x/ParametricSearch (1).xlsx": "adi_parametric", "/x/qorvo_space.pdf": "qorvo", "/x/notes.pdf": None}),
    "switches": (lambda c: Z.switch_type(c), {"Absorptive SPDT": "absorptive", "non-reflective": "absorptive", "Reflective": "reflective", "SP4T": None}),
}


@query("SELECT p_partkey AS part_id, " + ", ".join("CASE p_size % 4 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(texts.values())) + f" END AS {name}" for name, (_, texts) in CASED.items()) + " FROM part")
def ruled_categories(t):
    """Categories, subcategories, mounts, space words, readers and switch types by ordered phrases."""
    out = []
    for name, (column, texts) in CASED.items():
        text = F.expr("CASE p_size % 4 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(texts)) + " END")
        out.append(column(text).alias(name))
    return t("part").select(F.col("p_partkey").alias("part_id"), *out)


@query("""SELECT p_partkey AS part_id, CASE p_size % 4 WHEN 0 THEN 'http://h/HMC' || p_partkey || '.pdf' WHEN 1 THEN 'http://h/x.pdf' WHEN 2 THEN 'http://h/hmc' || p_partkey || '-v2.pdf' END AS best FROM part""")
def best_links(t):
    urls = "CASE p_size % 4 WHEN 0 THEN array('http://h/Catalog.pdf', 'http://h/HMC' || p_partkey || '.pdf') WHEN 1 THEN array('http://h/x.pdf') WHEN 2 THEN array('http://h/HMC' || p_partkey || '_Catalog.pdf', 'http://h/hmc' || p_partkey || '-v2.pdf', 'http://h/HMC' || p_partkey || '.pdf') ELSE array('http://h/none.pdf') END AS urls"
    mpn = F.when(F.col("p_size") % 4 == 1, "X").otherwise(F.concat(F.lit("hmc-"), F.col("part_id").cast("string")))
    return made(t, urls).select("part_id", Z.best_pdf(F.col("urls"), mpn).alias("best"))


@query("""SELECT page_id, regexp_replace(trim(url), '[<>:"/\\\\|?*]', '_', 'g')[1:120] AS name, CASE WHEN page_id % 2 = 0 THEN 'https://base.org/products/' || page_id ELSE split_part(url, '?utm_source', 1) END AS address FROM pages""")
def saved_links(t):
    href = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("../../products/"), F.col("page_id").cast("string"))).otherwise(F.concat("url", F.lit("?utm_source=x")))
    return t("pages").select("page_id", Z.safe_name(F.col("url")).alias("name"), Z.absolute(href, "https://base.org").alias("address"))


@query("""SELECT p_partkey AS part_id, round((10 * log10(p_size + 1)) / 1, 6) AS db, round(CASE WHEN p_size > 25 THEN 3.0 / (p_size - 25) END, 6) AS bound, round(greatest(0, (p_size / 50.0)), 6) AS upper_ok FROM part WHERE p_size <= 50""")
def bounds(t):
    """Intervals by column arithmetic: the rule of three where nothing failed."""
    size = F.col("p_size").cast("double")
    return t("part").where("p_size <= 50").select(F.col("p_partkey").alias("part_id"), r6(10 * F.log10(size + 1), "db"), r6(F.when(size > 25, 3.0 / (size - 25)), "bound"), r6(F.greatest(F.lit(0.0), size / 50.0), "upper_ok"))


@query("SELECT p_partkey AS part_id, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS upper FROM (SELECT p_partkey, p_size % 7 * 1.0 / 10 AS p, 10.0 AS n, 1.645 AS z FROM part)")
def wilson_upper(t):
    return t("part").select(F.col("p_partkey").alias("part_id"), r6(F.least(F.lit(9.0), N.wilson_upper(F.col("p_size") % 7, F.lit(10))), "upper"))


@query("SELECT s_suppkey, n_name, (contains(a, b) OR contains(b, a)) AND a <> '' AND b <> '' AS same, CASE WHEN p <> '' THEN p END AS family FROM (SELECT s_suppkey, n_name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(CASE WHEN s_suppkey % 2 = 0 THEN substr(s_name, 1, 8) ELSE n_name END), '[^a-z0-9]', '', 'g') AS b, upper(replace(s_name, ' ', '')) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def vendor_likeness(t):
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    other = F.when(F.col("s_suppkey") % 2 == 0, F.substring("s_name", 1, 8)).otherwise(F.col("n_name"))
    return rows.select("s_suppkey", "n_name", X.vendor_matches(F.col("s_name"), other).alias("same"), X.family_key(F.concat("s_name", F.lit("-SP"))).alias("family"))
