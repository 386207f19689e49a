"""What cells, labels and headings of catalogues say, as columns.

Rules are lists of phrases: the first phrase that a text has counts. `=x` asks for the whole text, `^x` for its beginning,
`x+y` for both, others for containment; texts are compared in lower case with everything but letters, digits, dots, % and µ as blanks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parsing as P
from . import vocabulary as V

#: Words that stand for no value.
NOTHING = ["", "none", "n/a", "na", "nan", "-", "--", "tbd"]
#: Units as they are written, and how they are kept.
UNITS = {"thz": "THz", "ghz": "GHz", "mhz": "MHz", "khz": "kHz", "hz": "Hz", "dbm": "dBm", "dbc": "dBc", "dbi": "dBi", "db": "dB", "mw": "mW", "kw": "kW", "w": "W", "watt": "W", "watts": "W", "ohm": "ohm", "ohms": "ohm", "ω": "ohm", "ns": "ns", "nsec": "ns", "us": "us", "usec": "us", "µs": "us", "μs": "us", "ms": "ms", "msec": "ms", "s": "s", "sec": "s",
         "v": "V", "mv": "mV", "ma": "mA", "a": "A", "%": "%", "krad": "krad", "mev": "MeV", "gbps": "Gbps", "mbps": "Mbps", "deg": "deg"}
#: Headings of parametric tables and the keys they stand for, first match.
HEADINGS = """
freq min, frequency min | freq_min
freq max, frequency max | freq_max
^freq, ^frequency | freq_range
conversion gain | conversion_gain_db
gain block |
gain | gain_db
noise figure, =nf, ^nf | nf_db
oip3, ip3, iip3 | oip3_dbm
op1db, ip1db, p1db, p0.1db, ip0.1db | p1db_dbm
insertion loss | insertion_loss_db
isolation | isolation_db
conversion loss | conversion_loss_db
attenuation | attenuation_db
psat, pout, output power, power | psat_dbm
switching speed | switching_speed_ns
phase error, rms phase | phase_error_deg
package type | package
^package | package_size
voltage, vcc, vdd | supply_v
current | current_ma
"""
#: Headings of parametric workbooks, the keys and units they stand for; ports come before the part's own band.
COLUMNS = """
frequency response if min | if_freq_min | GHz
frequency response if max | if_freq_max | GHz
frequency response lo min | lo_freq_min | GHz
frequency response lo max | lo_freq_max | GHz
frequency response rf min | freq_min | GHz
frequency response rf max | freq_max | GHz
frequency response min, freq min, frequency min, min frequency | freq_min | GHz
frequency response max, freq max, frequency max, max frequency | freq_max | GHz
specified at frequency | specified_at_ghz | GHz
bandwidth 3 db, bandwidth 3db, ^bandwidth | bandwidth_ghz | GHz
frequency cutoff range, frequency cut off range, cutoff range | cutoff_range_ghz | GHz
noise figure | nf_db | dB
iip3, input ip3 | iip3_dbm | dBm
oip3, output ip3 | oip3_dbm | dBm
ip 0.1 db, ip0.1db, p0.1db | p01db_dbm | dBm
op1db, ip1db, p1db | p1db_dbm | dBm
=gain, gain typ, small signal gain | gain_db | dB
isolation | isolation_db | dB
insertion loss | insertion_loss_db | dB
return loss | return_loss_db | dB
conversion gain | conversion_gain_db | dB
conversion loss | conversion_loss_db | dB
attenuation | attenuation_db | dB
residual phase noise | phase_noise_dbc | dBc/Hz
max average rf power, max rf power | max_rf_power_dbm | dBm
output power, psat, pout | psat_dbm | dBm
switching speed | switching_speed_ns | ns
phase adjust resolution, phase shifter resolution | phase_resolution | deg
=package, package type | package |
package area | package_area_mm2 | mm2
package height | package_height_mm | mm
^availability | availability |
price | price_usd | USD
temperature | temp_range | C
lifecycle | lifecycle |
^description | description |
"""
#: Keys whose cells are frequencies, and those kept as text.
FREQUENCY_KEYS = "freq_min freq_max if_freq_min if_freq_max lo_freq_min lo_freq_max specified_at_ghz bandwidth_ghz cutoff_range_ghz".split()
TEXT_KEYS = "package availability lifecycle".split()
#: Labels of listings, their keys and how their values read.
LABELS = {
    label.strip(): (key, kind)
    for labels, key, kind in (
        (x.strip() for x in line.split("|"))
        for line in """
        frequency | freq_ghz | freq
        gain | gain_db | num
        noise figure | nf_db | num
        p1db | p1db_dbm | num
        oip3 | oip3_dbm | num
        output power | power_w | num
        average power | power_avg_w | num
        saturated power | psat_dbm | num
        insertion loss | insertion_loss_db | num
        isolation | isolation_db | num
        attenuation | attenuation_db | num
        coupling | coupling_db | num
        directivity | directivity_db | num
        vswr | vswr | num
        impedance | impedance_ohm | num
        waveguide | waveguide | text
        modulation | modulation | text
        switching speed, switching time, rise time, rise fall time | switching_time_ns | time_ns
        connector | connector | text
        configuration | configuration | text
        package type | package | text
        type | subtype | text
        sub-category, sub category | subcategory_text | text
        termination | switch_type | text
        industry application | industry_application | text
        pulsed cw | pulsed_cw | text
        operating temperature | temp_c | text
        """.strip().splitlines()
    )
    for label in labels.split(",")
}
#: Labels of a part's own band, and of single frequencies.
BAND_LABELS = ["frequency", "frequency range", "operating frequency", "operating frequency range", "passband", "passband frequency", "pass band", "tunable frequency", "tuning range", "rf frequency"]
POINT_LABELS = ["center frequency", "centre frequency", "cutoff frequency", "cut-off frequency", "cut off frequency", "notch frequency"]
WAY_LABELS = ["no. of ways", "number of ways", "no of ways", "no.of ways", "ways", "no. of way", "no. of outputs", "number of outputs", "outputs", "no. of channels", "number of channels"]
#: Specifications of embedded records: names, key, family of units.
EMBEDDED = """
=min frequency, =frequency min | freq_min | freq
=max frequency, =frequency max | freq_max | freq
=frequency | freq_range | freq
noise figure | nf_db | db
=gain, small signal gain | gain_db | db
output power, =pout, =psat | psat_dbm | power
switching speed, switching time, rise time, fall time, =ton, =toff, =t on, =t off | switching_time_ns | time_ns
data rate, datarate | data_rate_gbps | num
p1db, 1 db compression | p1db_dbm | dbm
oip3, =ip3, iip3 | oip3_dbm | dbm
isolation | isolation_db | db
insertion loss | insertion_loss_db | db
return loss | return_loss_db | db
attenuation | attenuation_db | db
efficiency | efficiency_pct | pct
operating voltage, bias voltage, supply voltage, =vd, =vdd | supply_v | volt
current | current_ma | ma
=package, package type | package | text
"""
ATTRIBUTES = {"short description": "description", "form": "form_factor", "technology": "process", "frequency band": "frequency_band", "features": "features", "application": "industry_application", "package category": "package", "package": "package", "package type": "package", "configuration": "configuration", "switch type": "configuration", "throws": "configuration"}
#: Product types of workbooks, row types, section headings, parts of addresses, words of listings: category and subcategory.
PRODUCT_TYPES = "low noise amplifier | amplifier\npower amplifier | amplifier\nrf amplifier | amplifier\namplifier | amplifier\nattenuator | attenuator\nbeamformer, vector modulator | beamformer\nmixer | mixer\nmodulator, demodulator | modulator\nphase shifter | phase_shifter\nswitch | switch\ntunable filter, filter | filter\ndetector | detector\nsynthesizer, pll | synthesizer"
ROW_TYPES = "low noise, lna | amplifier | lna\npower amplifier | amplifier | pa\ngain block | amplifier | buffer\ndriver | amplifier | driver\nvariable gain | amplifier | vga\ndistributed | amplifier |"
SECTIONS = "low noise amplif | amplifier | lna\npower amplif | amplifier | pa\ndriver amplif | amplifier | driver\ngain block | amplifier | buffer\nvariable gain | amplifier | vga\namplif | amplifier |\nattenuator | attenuator |\nlimiter | limiter |\nphase shifter | phase_shifter |\nmixer | mixer |\nmultiplier | multiplier |\nmodulator | modulator |\nupconverter, downconverter | mixer |\nsynthesizer | synthesizer |\nvco | oscillator |\nswitch | switch |\nfilter, diplexer, duplexer, multiplexer | filter |\ntransformer, balun | balun |\nbeamformer | beamformer |\ntransistor, hemt | transistor |\nfront end module | ic |\ntransceiver | transceiver |\npmic, power management, converter | power |"
PATHS = "low noise, lna | amplifier | lna\npower amplifier | amplifier | pa\ngain block | amplifier | buffer\ndriver | amplifier | driver\namplifier | amplifier |\nattenuator | attenuator |\nlimiter | limiter |\nphase shifter | phase_shifter |\nmixer | mixer |\nmultiplier | multiplier |\nmodulator | modulator |\nswitch | switch |\nfilter | filter |\ncoupler | coupler |\ndivider, splitter | divider |\nbalun, transformer | balun |\ndetector | detector |\noscillator, vco | oscillator |\nsynthesizer | synthesizer |\ndiode | diode |\ntransistor | transistor |\nisolator | isolator |\ncirculator | circulator |\nequalizer | equalizer |\nbias tee | bias_tee |\nterminat | termination |\nbeamformer | beamformer |\ntransceiver | transceiver |"
LISTED = "attenuator | attenuator\ntermination | termination\npower divider, power splitter, combiner | divider\ncoupler | coupler\ncirculator | circulator\nisolator | isolator\nmixer | mixer\nphase shifter | phase_shifter\nmultiplier | multiplier\noscillator | oscillator\nlimiter | limiter\ndetector | detector\ndiplexer, duplexer | filter\nbalun, transformer | balun\nswitch | switch\nfilter | filter\namplifier | amplifier"
SLUGS = {"microwave-rf-amplifiers": "amplifier", "rf-attenuators": "attenuator", "rf-filters": "filter", "rf-mixers": "mixer", "rf-switches": "switch", "rf-directional-couplers": "coupler", "rf-couplers": "coupler", "rf-power-dividers": "divider", "phase-shifters": "phase_shifter", "rf-limiters": "limiter", "rf-oscillators": "oscillator", "rf-circulators": "circulator", "rf-isolators": "isolator", "rf-detectors": "detector",
         "frequency-multipliers": "multiplier", "rf-terminations": "termination", "dc-blocks": "dc_block", "bias-tees": "bias_tee", "rf-baluns": "balun", "baluns": "balun", "balun": "balun", "rf-transformers": "balun", "transformers": "balun", "transformers-baluns": "balun", "baluns-transformers": "balun"}
AMPLIFIERS = "low noise, lna* | lna\nhigh power, hpa* | hpa\npower amplifier, pa* | pa\nvariable gain, vga* | vga\ndriver, gain block | driver"
FILTERS = "band pass, bandpass, bpf* | bpf\nband stop, bandstop, band reject, notch, bsf* | bsf\nlow pass, lowpass, lpf* | lpf\nhigh pass, highpass, hpf* | hpf\ndiplexer | diplexer\nduplexer | duplexer\ntunable | tunable\ncavity | cavity\nceramic | ceramic"
MOUNTED = "surface mount, smt, ic mmic | smt\ndie, chip | die\nconnector, coax | connectorized\nflange | flange\ndrop in | drop_in\nmodule | module\nwaveguide | waveguide"
CUTOFFS = {"absorptive": "absorptive", "reflective": "reflective"}
#: Parameters of pipe tables, and what they are called where they are limits of destruction.
PARAMETERS = "small signal gain, ^gain | gain_db\nnoise figure, ^nf | nf_db\noutput ip3, input ip3, oip3, iip3, ip3 | oip3_dbm\noutput p1db, input p1db, p1db | p1db_dbm\nisolation | isolation_db\nconversion loss | conversion_loss_db\ninsertion loss | insertion_loss_db\ninput return loss | input_return_loss_db\noutput return loss | output_return_loss_db\ncurrent consumption, positive dc current, supply current | current_ma\npower supply dc voltage, drain supply voltage | supply_v\nmaximum operating temperature | temp_max_c\nminimum operating temperature | temp_min_c\nattenuation | attenuation_db\npsat, saturated output power, output power | psat_dbm"
DESTROYS = {"current_ma": "absmax_current_ma", "supply_v": "absmax_supply_v", "temp_max_c": "absmax_temp_max_c", "temp_min_c": "absmax_temp_min_c", "psat_dbm": "absmax_input_power_dbm"}
PERFORMANCE = "gain_db nf_db oip3_dbm p1db_dbm isolation_db conversion_loss_db insertion_loss_db input_return_loss_db output_return_loss_db attenuation_db".split()
INLINE = {"p1db": "p1db_dbm", "psat": "psat_dbm", "gain": "gain_db", "nf": "nf_db", "noise figure": "nf_db", "isolation": "isolation_db", "insertion loss": "insertion_loss_db", "conversion loss": "conversion_loss_db"}

VALUE = "struct<value_min:double,value_typ:double,value_max:double,value_text:string,unit:string>"
ENTRY = "struct<key:string,value:double,text:string,unit:string>"


def plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9.%µμ]+", " "))


def _fits(said: Column, phrase: str) -> Column:
    if phrase.startswith("="):
        return said == phrase[1:]
    if phrase.startswith("^"):
        return (said == phrase[1:]) | F.startswith(said, F.lit(phrase[1:] + " "))
    if phrase.endswith("*"):  # a whole word
        return F.contains(F.concat(F.lit(" "), said, F.lit(" ")), F.lit(f" {phrase[:-1]} "))
    return F.contains(said, F.lit(phrase))


def ruled(x: Column, rules: str, column: int = 1, default: str | None = None) -> Column:
    """The given column of the first rule that the text fits; an empty one is null."""
    return P.let(plain(x), lambda said: _ruled(said, rules, column, default))


def _ruled(said: Column, rules: str, column: int, default: str | None) -> Column:
    out = None
    for line in rules.strip().splitlines():
        cells = [c.strip() for c in line.split("|")]
        test = reduce(lambda a, b: a | b, [_fits(said, p.strip()) for p in cells[0].split(",")])
        value = F.lit(cells[column] or None).cast("string")
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(default).cast("string"))


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))


def number_of(x: Column) -> Column:
    """The first number of a cell; words for nothing are null, DC alone is 0."""
    text = F.trim(F.coalesce(x, F.lit("")))
    found = F.replace(F.regexp_extract(text, r"-?\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.lower(text).isin(NOTHING), None).otherwise(F.coalesce(found, F.when(P.spoken(text, "dc"), 0.0)))


def signed_number(x: Column) -> Column:
    """A number behind signs of tolerance or comparison; the typographic minus counts."""
    return F.regexp_replace(F.replace(F.trim(x), F.lit("−"), F.lit("-")), r"^[±<>~≈≤≥=\s+]+", "").try_cast("double")


def unit_of(x: Column) -> Column:
    """The first unit among a text's words, in one spelling; degrees Celsius only with their sign."""
    words = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"°\s*c\b|[a-zµμω]+|%"), F.lit(0))
    known = F.transform(words, lambda w: F.when(F.startswith(w, F.lit("°")), "C").otherwise(F.try_element_at(_table(UNITS), w)))
    return F.get(F.filter(known, lambda u: u.isNotNull()), F.lit(0))


def label_unit(label: Column) -> Column:
    """The unit that a label names in brackets or after a comma, in lower case."""
    after = F.lower(F.regexp_extract(label, r"[(\[,]\s*([A-Za-zµμ%]+)\s*[)\]]?", 1))
    return F.when(F.try_element_at(_table(UNITS), after).isNotNull() | (after == "c"), after)


def header_scale(header: Column) -> Column:
    """GHz in the unit that a heading states in brackets."""
    return F.try_element_at(_table(P.FREQUENCIES), F.lower(F.regexp_extract(header, r"\(\s*([A-Za-z]+)\s*\)", 1)))


def cell_frequency(cell: Column) -> Column:
    """GHz where the cell itself states the unit."""
    at = lambda tokens: lambda i: P.number(F.get(tokens, i)) * F.try_element_at(_table(P.FREQUENCIES), F.get(tokens, i + 1))
    return P.let(P._tokens(cell), lambda tokens: P._first(F.transform(P._places(tokens), at(tokens))))


def workbook_ghz(cell: Column, header: Column, least: float = 1e-6, most: float = 300.0) -> Column:
    """GHz by the cell's unit, else the heading's, else the size: from 1e6 Hz, from 1e3 and above `most` MHz, else GHz. Without a stated unit it has to be plausible; 0 is DC."""
    scale = header_scale(header)
    guess = lambda n: F.when(n > 1e6, n / 1e9).when((n >= 1e3) | (n > most), n / 1e3).otherwise(n)
    guessed = lambda n: P.let(guess(n), lambda g: F.when((g == 0) | g.between(least, most), g))
    found = F.coalesce(cell_frequency(cell), P.let(number_of(cell), lambda n: F.when(scale.isNotNull(), n * scale).otherwise(guessed(n))))
    return P.let(found, lambda x: F.when(x >= 0, x))


def value_of(kind: str, text: Column, hint: Column | None = None) -> Column:
    """A listing's cell as text, freq (GHz), time_ns, or num: a range or a single number with its unit; null if it says nothing."""
    said, nothing = F.trim(F.coalesce(text, F.lit(""))), F.lit(None).cast("double")
    made = lambda lo, typ, hi, words, unit: F.struct(lo.alias("value_min"), typ.alias("value_typ"), hi.alias("value_max"), words.alias("value_text"), unit.alias("unit")).cast(VALUE)
    words = F.lit(None).cast("string")
    if kind == "text":
        return F.when(said != "", made(nothing, nothing, nothing, F.substring(said, 1, 200), F.lit("")))
    if kind == "freq":
        return P.let(P.band_ghz(said, hint), lambda band: F.when(band.isNotNull(), made(band["lo"], nothing, band["hi"], words, F.lit("GHz"))))
    if kind == "time_ns":
        one = lambda t: t["lo"] == t["hi"]
        return P.let(P.time_ns(said, hint), lambda t: F.when(t.isNotNull(), made(F.when(~one(t), t["lo"]), F.when(one(t), t["lo"]), F.when(~one(t), t["hi"]), words, F.lit("ns"))))
    return P.let(P._tokens(said), lambda tokens: _numbers(tokens, lambda lo, typ, hi: made(lo, typ, hi, words, F.coalesce(unit_of(said), F.lit("")))))


def _numbers(tokens: Column, made) -> Column:
    """A range, or the first number, with their signs."""
    at = lambda i: F.get(tokens, i)
    minus = lambda i: (i > 0) & (at(F.greatest(i - 1, F.lit(0))) == "-") & ((i == 1) | P.number(at(F.greatest(i - 2, F.lit(0)))).isNull())
    signed = lambda i: P.number(at(i)) * F.when(minus(i), -1).otherwise(1)
    second = lambda i: F.when(P.number(at(i + 2)).isNotNull(), P.number(at(i + 2))).when(at(i + 2) == "-", -P.number(at(i + 3))).when(at(i + 2) == "+", P.number(at(i + 3)))
    nothing = F.lit(None).cast("double")
    span = P._first(F.transform(P._places(tokens), lambda i: F.when(signed(i).isNotNull() & at(i + 1).isin(P.BETWEEN) & second(i).isNotNull(), F.struct(signed(i).alias("lo"), second(i).alias("hi")))))
    single = P._first(F.transform(P._places(tokens), signed))
    one = P.let(single, lambda x: F.when(x.isNotNull(), made(nothing, x, nothing)))
    return P.let(span, lambda r: F.when(r.isNotNull(), made(r["lo"], nothing, r["hi"])).otherwise(one))


def scalar_ghz(text: Column, hint: Column | None = None) -> Column:
    """One frequency: the upper end of a band."""
    return P.band_ghz(text, hint)["hi"]


def bandwidth_ghz(text: Column, centre: Column, hint: Column | None = None) -> Column:
    """A width: percent of the centre, the width of a band, or the single value."""
    share = F.regexp_extract(text, r"\d+(?:\.\d+)?", 0).try_cast("double")
    width = P.let(P.band_ghz(text, hint), lambda band: F.when(band["hi"] > band["lo"], band["hi"] - band["lo"]).otherwise(band["hi"]))
    return F.when(F.contains(text, F.lit("%")), centre * share / 100).otherwise(width)


def band_of(attributes: Column) -> Column:
    """struct(lo, hi, bandwidth) from an array of struct(label, value): a named band, else any frequency, else centre and bandwidth, else a point."""
    stated = lambda label: F.nullif(F.regexp_extract(label, r"(?i)\(\s*([tgmk]?hz)\s*\)", 1), F.lit(""))
    read = F.transform(attributes, lambda a: F.struct(a["label"].alias("label"), a["value"].alias("value"), F.when(F.contains(a["label"], F.lit("freq")) | F.contains(a["label"], F.lit("pass")) | F.contains(a["label"], F.lit("tun")), P.band_ghz(a["value"], stated(a["label"]))).alias("band")))
    return P.let(read, lambda own: _band_of(own, stated))


def _band_of(own: Column, stated) -> Column:
    first = lambda keep: P._first(F.transform(F.filter(own, keep), lambda a: a["band"]))
    has = lambda a, *words: reduce(lambda x, y: x | y, [F.contains(a["label"], F.lit(w)) for w in words])
    is_ = lambda label: lambda a: a["label"] == label
    by = lambda labels: F.coalesce(*(first(is_(label)) for label in labels))
    general = first(lambda a: has(a, "frequency", "passband") & ~has(a, "bandwidth") & ~a["label"].isin(POINT_LABELS))
    wide = F.get(F.filter(own, lambda a: has(a, "bandwidth")), F.lit(0))

    def settled(centre: Column, width: Column) -> Column:
        around = F.struct(F.when(width > 0, F.round(F.greatest(F.lit(0.0), centre - width / 2), 6)).otherwise(centre).alias("lo"), F.when(width > 0, F.round(centre + width / 2, 6)).otherwise(centre).alias("hi"))
        band = F.coalesce(by(BAND_LABELS), general, F.when(centre.isNotNull(), around), by(POINT_LABELS))
        return P.let(band, lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.round(width, 6).alias("bandwidth")))

    middle = first(lambda a: a["label"].isin(POINT_LABELS[:2]))["hi"]
    return P.let(middle, lambda centre: P.let(bandwidth_ghz(wide["value"], centre, stated(wide["label"])), lambda width: settled(centre, width)))


def power_dbm(value: Column, unit: Column, most_bare: float = 100.0) -> Column:
    """struct(dbm, watts): a cell in dBm is no watts; watts are kept and converted, milliwatts converted; bare numbers above `most_bare` are refused."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    dbm = F.when(u == "dbm", value).when((u == "mw") & (value > 0), F.bround(10 * F.log10(value), 1)).when(u.isin("w", "") & (value > 0) & ~((u == "") & (value > most_bare)), F.bround(10 * F.log10(value * 1000), 1))
    return F.struct(dbm.alias("dbm"), F.when(u.isin("w", ""), value).alias("watts"))


def scaled(value: Column, unit: Column, family: Column) -> Column:
    """struct(value, unit) of an embedded record's number in our units; times and powers that can't be read are null."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    v = value.try_cast("double")
    watts = u.isin("w", "watt", "watts")
    out = (
        F.when(family == "freq", v * F.coalesce(F.try_element_at(_table(P.FREQUENCIES), u), F.lit(1.0)))
        .when(family == "power", F.when(watts, F.when(v > 0, F.bround(10 * F.log10(v * 1000), 1))).otherwise(v))
        .when(family == "time_ns", v * F.try_element_at(_table(P.TIMES), u))
        .when((family == "ma") & (u == "a"), v * 1000)
        .otherwise(v)
    )
    kept = F.coalesce(F.try_element_at(_table({"freq": "GHz", "power": "dBm", "time_ns": "ns", "dbm": "dBm", "db": "dB", "pct": "%", "volt": "V", "ma": "mA"}), family), F.coalesce(unit, F.lit("")))
    return F.struct(out.alias("value"), F.when(out.isNotNull(), kept).otherwise("").alias("unit"))


def _entry(key, value=None, text=None, unit="") -> Column:
    lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(lit(key, "string").alias("key"), lit(value, "double").alias("value"), lit(text, "string").alias("text"), lit(unit, "string").alias("unit")).cast(ENTRY)


def absorbed(key: Column, text: Column, unit: Column) -> Column:
    """A table's cell as entries: bands in GHz by the heading's unit, packages as text, numbers; a negative conversion gain is a loss as well."""
    none = F.array().cast(f"array<{ENTRY}>")
    said = F.trim(F.coalesce(text, F.lit("")))
    scale = F.coalesce(F.try_element_at(_table(P.FREQUENCIES), F.lower(unit)), F.lit(1.0))
    n = number_of(said)
    loss = F.when((key == "conversion_gain_db") & (n < 0), F.array(_entry("conversion_loss_db", F.abs(n), None, F.coalesce(F.nullif(unit, F.lit("")), F.lit("dB"))))).otherwise(none)
    return (
        F.when(F.lower(said).isin(NOTHING), none)
        .when(key == "package", F.array(_entry("package", None, F.substring(said, 1, 60))))
        .when(n.isNull(), none)
        .when(key == "freq_min", F.array(_entry("freq_min", n * scale, None, "GHz")))
        .when(key == "freq_max", F.array(_entry("freq_max", n * scale, None, "GHz")))
        .when(key == "freq_range", P.let(value_of("num", said), lambda r: F.array(_entry("freq_min", F.coalesce(F.least(r["value_min"], r["value_max"]), n) * scale, None, "GHz"), _entry("freq_max", F.coalesce(F.greatest(r["value_min"], r["value_max"]), n) * scale, None, "GHz"))))
        .otherwise(F.concat(F.array(_entry(key, n, None, unit)), loss))
    )


def described(text: Column) -> Column:
    """What a description states: a band with a unit, power, gain (for variable gain its range), noise figure."""
    return P.let(P._tokens(F.coalesce(text, F.lit(""))), lambda tokens: _described(F.coalesce(text, F.lit("")), tokens))


def _described(said: Column, tokens: Column) -> Column:
    at = lambda i: F.get(tokens, i)
    scale = _table({k: v for k, v in P.FREQUENCIES.items() if k in ("ghz", "mhz", "khz")})
    unit = lambda i: F.try_element_at(scale, at(i))

    def span(i: Column) -> Column:
        middle = i + 1 + unit(i + 1).isNotNull().cast("int")
        fits = P.number(at(i)).isNotNull() & at(middle).isin("to", "-", "–", "through") & P.number(at(middle + 1)).isNotNull() & unit(middle + 2).isNotNull()
        a, b = P.number(at(i)) * F.coalesce(unit(i + 1), unit(middle + 2)), P.number(at(middle + 1)) * unit(middle + 2)
        return F.when(fits, F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))

    upto = lambda i: F.when(((at(i) == "to") & (at(F.greatest(i - 1, F.lit(0))).isin("up", "dc")) | (at(i) == "-") & (at(F.greatest(i - 1, F.lit(0))) == "dc")) & (i > 0) & unit(i + 2).isNotNull(), F.struct(F.lit(0.0).alias("lo"), (P.number(at(i + 1)) * unit(i + 2)).alias("hi")))
    band = F.coalesce(P._first(F.transform(P._places(tokens), span)), P._first(F.transform(P._places(tokens), upto)))
    before = lambda *units: P._first(F.transform(P._places(tokens), lambda i: F.when(at(i + 1).isin(*units), P.number(at(i)))))
    named = lambda *words: P._first(F.transform(P._places(tokens), lambda i: F.when((at(i + 1) == "db") & reduce(lambda a, b: a | b, [at(i + 2) == w if " " not in w else (at(i + 2) == w.split()[0]) & (at(i + 3) == w.split()[1]) for w in words]), P.number(at(i)))))
    dbm, watts = before("dbm"), before("w")
    # a figure in dB that `gain` follows in the same sentence, within some words
    gain = P._first(F.transform(P._places(tokens), lambda i: F.when((at(i + 1) == "db") & F.exists(F.sequence(F.lit(2), F.lit(9)), lambda k: at(i + k) == "gain") & ~F.exists(F.sequence(F.lit(2), F.lit(9)), lambda k: (at(i + k) == ".") & ~F.exists(F.sequence(F.lit(2), F.lit(9)), lambda j: (j < k) & (at(i + j) == "gain"))), P.number(at(i)))))
    varies = P.spoken(said, "variable gain, linear in db, gain control")
    found = [
        F.when(band.isNotNull(), _entry("freq_min", band["lo"], None, "GHz")), F.when(band.isNotNull(), _entry("freq_max", band["hi"], None, "GHz")),
        F.when(dbm.isNotNull() | (watts > 0), _entry("psat_dbm", F.coalesce(dbm, F.bround(10 * F.log10(watts * 1000), 1)), None, "dBm")),
        F.when(gain.isNotNull(), _entry(F.when(varies, "gain_range_db").otherwise("gain_db"), gain, None, "dB")),
        F.when(named("noise figure", "nf").isNotNull(), _entry("nf_db", named("noise figure", "nf"), None, "dB")),
    ]
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def inline(text: Column) -> Column:
    """`Label: value unit` pairs of a card, the first of each key; a dash states that there is no value."""
    names = "|".join(sorted(INLINE, key=len, reverse=True))
    pattern = rf"(?i)\b({names})\s*:\s*(-|[-+]?\d+(?:\.\d+)?)\s*(dBm|dB)?"
    groups = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    every = F.filter(F.transform(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, "lvu", strict=True))), lambda z: _entry(F.try_element_at(_table(INLINE), F.lower(z["l"])), z["v"].try_cast("double"), None, z["u"])), lambda e: e["value"].isNotNull())
    keys = F.transform(every, lambda e: e["key"])
    return F.filter(every, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def bare_label(label: Column) -> Column:
    """A label without notes in brackets, words of statistics and a unit at its end."""
    s = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\([^)]*\)|\[[^\]]*\]", " ")
    words = F.filter(F.split(F.regexp_replace(s, r"[\s/_,:]+", " "), " "), lambda w: (w != "") & ~w.isin("max", "min", "typ", "typical", "nom", "nominal", "maximum", "minimum", "avg", "average"))
    last = F.element_at(words, -1)
    cut = (F.size(words) > 1) & (F.try_element_at(_table(UNITS), last).isNotNull() | last.isin("c", "°c", "degc", "psec"))
    words = F.when(cut, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    words = F.when(cut & (F.element_at(words, -1) == "in") & (F.size(words) > 1), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    return F.trim(F.array_join(words, " "), F.lit("- "))


def attribute(label: Column) -> Column:
    """struct(key, kind) of a listing's label, as written or without its notes."""
    keys, kinds = _table({k: v[0] for k, v in LABELS.items()}), _table({k: v[1] for k, v in LABELS.items()})
    raw = F.trim(F.lower(F.coalesce(label, F.lit(""))), F.lit(": "))
    known = F.when(F.try_element_at(keys, raw).isNotNull(), raw).otherwise(bare_label(label))
    return F.when(F.try_element_at(keys, known).isNotNull(), F.struct(F.try_element_at(keys, known).alias("key"), F.try_element_at(kinds, known).alias("kind")))


def category_of_listing(url: Column, *words: Column) -> Column:
    """The address's slug, else the first category named in the texts, else empty."""
    slug = F.regexp_extract(F.coalesce(url, F.lit("")), "/products/([^/]+)/", 1)
    return F.coalesce(F.try_element_at(_table(SLUGS), slug), ruled(F.concat_ws(" ", *words), LISTED), F.lit(""))


def space_class(*sources: Column) -> Column:
    """space_qualified or space_grade by the strongest source that names space at all; null if none does."""
    said = [F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"\s+", "") for s in sources]
    return F.coalesce(*(F.when(F.contains(s, F.lit("spacequal")), "space_qualified").when(F.contains(s, F.lit("space")), "space_grade") for s in said))


def switch_type(*texts: Column) -> Column:
    said = F.lower(F.concat_ws(" ", *texts))
    return F.when(F.contains(said, F.lit("absorptive")) | F.contains(said, F.lit("non-reflective")) | F.contains(said, F.lit("terminated")), "absorptive").when(F.contains(said, F.lit("reflective")), "reflective")


def ways_of(attributes: Column, *texts: Column) -> Column:
    """Ways of a divider: a labelled count, else `N-way` in its texts."""
    stated = P._first(F.transform(F.filter(attributes, lambda a: a["label"].isin(WAY_LABELS)), lambda a: F.regexp_extract(a["value"], r"\d+", 0).try_cast("int")))
    return F.coalesce(stated, F.regexp_extract(F.concat_ws(" ", *texts), r"(?i)(\d+) *-? *way\b", 1).try_cast("int"))


def absolute(href: Column, base: str) -> Column:
    """A saved link as an address, without the tracking that follows it."""
    h = F.trim(F.coalesce(href, F.lit("")))
    inside = F.concat(F.lit(base + "/"), F.regexp_replace(h, r"^(?:\.\./|/)+", ""))
    return F.when(h == "", "").when(F.startswith(h, F.lit("http")), F.substring_index(h, "?utm_source", 1)).otherwise(inside)


def safe_name(x: Column) -> Column:
    """A file name that still reads as the part number."""
    return F.substring(F.regexp_replace(F.trim(x), r'[<>:"/\\|?*]', "_"), 1, 120)


def pdf_score(url: Column, mpn: Column) -> Column:
    """How likely a linked PDF is a part's own: its number in the name 100, six signs of it 40, a catalogue -200."""
    name = F.upper(F.try_url_decode(F.substring_index(url, "/", -1)))
    flat, key = F.regexp_replace(name, "[^A-Z0-9]", ""), F.regexp_replace(F.upper(mpn), "[^A-Z0-9]", "")
    own = F.when((key != "") & F.contains(flat, key), 100).when((F.char_length(key) > 5) & F.contains(flat, F.substring(key, 1, 6)), 40).otherwise(0)
    return own - F.when(F.rlike(name, F.lit("CATALOG|BROCHURE|SELECTION|SHORTFORM|LINECARD|GUIDE")), 200).otherwise(0)


def best_pdf(urls: Column, mpn: Column) -> Column:
    """The first link with the highest score above 0."""
    scored = F.transform(urls, lambda u, i: F.struct(pdf_score(u, mpn).alias("score"), (-i).alias("at"), u.alias("url")))
    return F.array_max(F.filter(scored, lambda s: s["score"] > 0))["url"]


def adapter_of(path: Column) -> Column:
    """Which reader a file is for, by its name."""
    name = F.lower(F.substring_index(path, "/", -1))
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])
    sheet, pdf = F.rlike(name, F.lit(r"\.(?:xlsx|xlsm|csv)$")), F.endswith(name, F.lit(".pdf"))
    space = has("space_portfolio", "space portfolio") | (has("space") & has("adi"))
    return F.when(sheet & space, "adi_space").when(sheet & (has("parametric") | F.contains(F.replace(name, F.lit(" "), F.lit("")), F.lit("parametricsearch"))), "adi_parametric").when(sheet, "adi").when(pdf & has("qorvo"), "qorvo").when(pdf & (has("slyt", "space-products", "space_products") | F.startswith(name, F.lit("ti"))), "ti")


def script_shell(html: Column) -> Column:
    """Whether a page is an empty shell for scripts: heavy, with few links and words."""
    links = F.regexp_count(html, F.lit(r"(?i)href\s*=\s*[\"'][^\"']+[\"']"))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), "<[^>]+>", " ")
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    low = F.lower(html)
    framed = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in ('id="root"', 'id="app"', "__next_data__", "ng-app", "data-reactroot")])
    return (F.char_length(html) > 5000) & ((links < 20) & (words < 300) | framed & (links < 30) & (words < 600))


del V
