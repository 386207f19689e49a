"""Values that texts state, as columns: bands, times, switch layouts, packages, test names.

Each text is cut into tokens once (numbers, words, single signs); the rules then look at tokens and their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above this a frequency is a unit error.
PLAUSIBLE_GHZ = 1000.0
#: GHz in a frequency unit.
FREQUENCIES = {"thz": 1e3, "ghz": 1.0, "mhz": 1e-3, "khz": 1e-6, "hz": 1e-9}
#: Words and signs between the ends of a range.
BETWEEN = ["to", "through", "–", "—", "~", "-"]
#: Nanoseconds in a unit.
TIMES = {"ns": 1.0, "nsec": 1.0, "us": 1e3, "usec": 1e3, "µs": 1e3, "μs": 1e3, "ms": 1e6, "msec": 1e6, "s": 1e9, "sec": 1e9}
#: Number words of switch layouts; a pole count is one of the first that are at most four.
WORDS = {"single": 1, "one": 1, "double": 2, "two": 2, "dual": 2, "triple": 3, "three": 3, "quad": 4, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "sixteen": 16}
#: How a part is mounted, by the words that say so (a star: any word that begins so); the first kind that is met counts.
MOUNTS = {
    "connectorized": "connectoriz*, connectorised*, module with connector*, coax*",
    "waveguide": "waveguide, wr 0*, wr 1*, wr 2*, wr 3*, wr 4*, wr 5*, wr 6*, wr 7*, wr 8*, wr 9*, wr0*, wr1*, wr2*, wr3*, wr4*, wr5*, wr6*, wr7*, wr8*, wr9*",
    "benchtop": "benchtop*, rackmount*, rack mount*, instrument*",
    "die": "die, chip, unpackaged*",
    "drop-in": "drop in*, dropin*",
    "flange": "flange, bolt down*, boltdown*",
    "through-hole": "through hole*, throughhole*, thru hole, thruhole, tht, pth",
    "surface-mount": "surface mount*, surfacemount*, smt, smd, qfn, lga, lfcsp, bga, sot, soic, msop, dfn",
    "module": "module, brick, assembly",
}
#: Package bodies; of the second kind a number is part of the name, of the third it may be.
BODIES = "QFN LFCSP LGA BGA DFN SOIC MSOP TSSOP SOP CSP WLCSP SMA CH DIP PDIP QFP LCC CQFP SIP".split()
NUMBERED, MAYBE_NUMBERED = ["TO", "WR"], ["SOT"]


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression that is mentioned twice is otherwise computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))


def _tokens(text: Column) -> Column:
    """Numbers (thousands separators included), words and single signs, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|[a-zµμ]+|[^\s\w]"), F.lit(0))


def _first(values: Column) -> Column:
    """The first element that isn't null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _places(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))


def number(x: Column) -> Column:
    """A number with thousands separators; null if it isn't one."""
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def _ghz(value: Column, unit: Column, largest: Column) -> Column:
    """GHz by the unit; without one by the largest value: above 1e6 kHz, above 300 MHz, else GHz."""
    guessed = F.when(largest > 1e6, 1e-6).when(largest > 300, 1e-3).otherwise(1.0)
    return value * F.coalesce(F.try_element_at(_table(FREQUENCIES), F.lower(unit)), guessed)


def band_ghz(text: Column, hint: Column | None = None) -> Column:
    """struct(lo, hi) in GHz: a unit at either end of a range holds for both; `DC`, `up to` and `<=` begin at 0; implausible is null."""
    return let(_tokens(text), lambda tokens: _band(tokens, F.lit(None).cast("string") if hint is None else hint))


def _band(tokens: Column, hint: Column) -> Column:
    at = lambda i: F.get(tokens, i)
    unit = lambda i: F.when(F.try_element_at(_table(FREQUENCIES), at(i)).isNotNull(), at(i))
    named = lambda i: unit(i).isNotNull().cast("int")

    def span(i: Column) -> Column:
        """A range that begins with token i: number, perhaps unit, what stands between, number, perhaps unit."""
        middle = i + 1 + named(i + 1)
        ends = number(at(i)).isNotNull() & at(middle).isin(BETWEEN) & number(at(middle + 1)).isNotNull()
        return F.when(ends, F.struct(number(at(i)).alias("a"), unit(i + 1).alias("ua"), number(at(middle + 1)).alias("b"), unit(middle + 2).alias("ub")))

    def ends(found: Column) -> Column:
        most = F.greatest(found["a"], found["b"])
        left = _ghz(found["a"], F.coalesce(found["ua"], found["ub"], hint), most)
        right = _ghz(found["b"], F.coalesce(found["ub"], found["ua"], hint), most)
        return F.struct(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi"))

    single = _first(F.transform(tokens, number))
    stated = _first(F.transform(_places(tokens), unit))
    upto = F.exists(_places(tokens), lambda i: at(i).isin("dc", "upto", "<", "≤") | ((at(i) == "up") & (at(i + 1) == "to")))
    point = let(_ghz(single, F.coalesce(stated, hint), single), lambda p: F.struct(F.when(upto, 0.0).otherwise(p).alias("lo"), p.alias("hi")))
    band = let(_first(F.transform(_places(tokens), span)), lambda found: F.when(found.isNotNull(), ends(found)).otherwise(point))
    return let(band, lambda x: F.when((x["hi"] > 0) & (x["hi"] <= PLAUSIBLE_GHZ), F.struct(F.round(x["lo"], 6).alias("lo"), F.round(x["hi"], 6).alias("hi"))))


def time_ns(text: Column, hint: Column | None = None) -> Column:
    """struct(lo, hi) in nanoseconds; a time whose unit neither the text nor the hint states is refused."""
    return let(_tokens(text), lambda tokens: _times(tokens, hint))


def _times(tokens: Column, hint: Column | None) -> Column:
    scale = _table(TIMES)
    signed = lambda i: number(F.get(tokens, i)) * F.when((i > 0) & (F.get(tokens, F.greatest(i - 1, F.lit(0))) == "-"), -1).otherwise(1)
    timed = F.filter(F.transform(_places(tokens), lambda i: signed(i) * F.try_element_at(scale, F.get(tokens, i + 1))), lambda x: x.isNotNull())
    factor = F.try_element_at(scale, F.lower(hint)) if hint is not None else F.lit(None).cast("double")
    bare = F.filter(F.transform(_places(tokens), lambda i: signed(i) * factor), lambda x: x.isNotNull())
    every = let(timed, lambda t: F.when(F.size(t) > 0, t).otherwise(bare))
    return let(every, lambda e: F.when(F.size(e) > 0, F.struct(F.array_min(e).alias("lo"), F.array_max(e).alias("hi"))))


def throw_name(poles: Column, throws: Column) -> Column:
    """SPDT, SP4T, 3P6T: one and two have letters, other counts are figures."""
    pole = F.when(poles == 1, "SP").when(poles == 2, "DP").otherwise(F.concat(poles.cast("string"), F.lit("P")))
    return F.concat(pole, F.when(throws == 1, "ST").when(throws == 2, "DT").otherwise(F.concat(throws.cast("string"), F.lit("T"))))


def throw_layout(text: Column) -> Column:
    """SPDT, SP4T, DPDT, 3P6T, TRANSFER or an empty string: the compact form, then words, then a transfer switch.

    A compact form is a token, or two neighbours read as one: a pole sign, P, a throw sign, T. One out of bounds (4 poles, 32 throws) says nothing.
    """
    return let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), _layout)


def _layout(tokens: Column) -> Column:
    at = lambda i: F.get(tokens, i)
    sign = lambda letters, x: F.coalesce(F.try_element_at(_table(letters), x), x.try_cast("int"))
    runs = F.flatten(F.transform(_places(tokens), lambda i: F.array(at(i), F.concat(at(i), F.coalesce(at(i + 1), F.lit(""))))))

    def compact(x: Column) -> Column:
        poles, throws = sign({"s": 1, "d": 2}, F.substring(x, 1, 1)), sign({"s": 1, "d": 2, "t": 3, "q": 4}, F.substr(x, F.lit(3), F.char_length(x) - 3))
        shaped = F.char_length(x).between(4, 5) & (F.substring(x, 2, 1) == "p") & F.endswith(x, F.lit("t"))
        return F.when(shaped, let(F.struct(poles.alias("poles"), throws.alias("throws")), lambda c: F.when(c["poles"].isNotNull() & c["throws"].isNotNull(), c)))

    def worded(i: Column) -> Column:
        few = {w: n for w, n in WORDS.items() if n <= 4}
        poles, throws = F.try_element_at(_table(few), at(i)), F.try_element_at(_table(WORDS), at(i + 2))
        return F.when((at(i + 1) == "pole") & (at(i + 3) == "throw") & poles.isNotNull() & throws.isNotNull(), F.struct(poles.alias("poles"), throws.alias("throws")))

    transfer = F.when(F.exists(_places(tokens), lambda i: (at(i) == "transfer") & (at(i + 1) == "switch")), "TRANSFER").otherwise("")
    by_words = let(_first(F.transform(_places(tokens), worded)), lambda w: F.when(w.isNotNull(), throw_name(w["poles"], w["throws"])).otherwise(transfer))
    bounded = lambda c: c["poles"].between(1, 4) & c["throws"].between(1, 32)
    return let(_first(F.transform(runs, compact)), lambda c: F.when(c.isNull(), by_words).when(bounded(c), throw_name(c["poles"], c["throws"])).otherwise(""))


def dedupe_commas(text: Column) -> Column:
    """Parts between commas once each, letters and digits compared, in their order."""
    parts = F.filter(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.regexp_replace(p, "[^A-Za-z0-9]", "") != "")
    keys = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, "[^A-Za-z0-9]", "")))
    kept = F.filter(parts, lambda p, i: F.array_position(keys, F.lower(F.regexp_replace(p, "[^A-Za-z0-9]", ""))) == i + 1)
    return F.array_join(kept, ", ")


def spoken(text: Column, terms: str) -> Column:
    """Whether a text has one of the terms between commas as whole words; a term with a star, as the beginning of words."""
    return _said(_line(text), terms)


def _line(text: Column) -> Column:
    """The words of a text in one line, with blanks around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def _said(line: Column, terms: str) -> Column:
    wanted = [f" {t.strip()[:-1]}" if t.strip().endswith("*") else f" {t.strip()} " for t in terms.split(",")]
    return F.exists(F.array(*map(F.lit, wanted)), lambda t: F.contains(line, t))


def package(text: Column) -> Column:
    """struct(mount, body, hermetic); what isn't stated stays null."""
    mount = let(_line(text), lambda line: F.coalesce(*(F.when(_said(line, terms), name) for name, terms in MOUNTS.items())))

    def body(token: Column) -> Column:
        """Letters, and a number with or without a hyphen: the name, with the number where it belongs to it."""
        return let(F.regexp_extract(token, "^[A-Z]+", 0), lambda name: let(F.substr(token, F.char_length(name) + 1), lambda rest: kind(token, name, rest)))

    def kind(token: Column, name: Column, rest: Column) -> Column:
        figures = F.regexp_replace(rest, "^-", "").try_cast("long").isNotNull()
        whole = name.isin(NUMBERED) & figures | name.isin(MAYBE_NUMBERED) & (figures | (rest == ""))
        return F.when(whole, token).when(name.isin(BODIES) & ((rest == "") | F.startswith(rest, F.lit("-"))), name)

    tokens = F.regexp_extract_all(F.upper(text), F.lit("[A-Z0-9]+(?:-[0-9]+)?"), F.lit(0))
    hermetic = F.when(spoken(text, "hermetic*, kovar*, glass seal*"), True)
    return F.struct(mount.alias("mount"), _first(F.transform(tokens, body)).alias("body"), hermetic.alias("hermetic"))


def digit_group(name: Column) -> Column:
    """The first two digits of a test name's first token, one if there is one, else 99."""
    digits = F.translate(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)), "".join(chr(c) for c in range(0x20, 0x7F) if not chr(c).isdigit()), "")
    return F.when(digits == "", "99").otherwise(F.substring(digits, 1, 2))


def spec_of(name: Column) -> Column:
    """struct(type, values) of `TOKEN - Type (key-value ...)`: a token's last hyphen parts key and value, the last of a key wins.

    Without the brackets at the end there are no values, and the type is what follows the first ` - `, else the whole name.
    """
    return let(F.trim(name), lambda text: let(_after_token(text), lambda rest: _spec(name, rest)))


def _after_token(text: Column) -> Column:
    """What follows the hyphen after the first token, or else the last hyphen inside it before a bracket; null without one."""
    first = F.get(F.split(text, r"\s+"), F.lit(0))

    def cut(first: Column) -> Column:
        after, inside = F.substr(text, F.char_length(first) + 1), F.substring_index(first, "(", 1)
        inner = F.substring_index(inside, "-", -1)
        joined = F.concat(F.substr(first, F.char_length(inside) - F.char_length(inner) + 1), after)
        return F.when(F.startswith(F.ltrim(after), F.lit("-")), F.substr(F.ltrim(after), F.lit(2))).when(F.contains(inside, F.lit("-")), joined)

    return let(first, cut)


def _spec(name: Column, rest: Column) -> Column:
    opened = F.instr(rest, "(")
    whole = F.coalesce((opened > 1) & F.endswith(rest, F.lit(")")), F.lit(False))
    kind, inside = F.trim(F.substr(rest, F.lit(1), opened - 1)), F.substr(rest, opened + 1, F.char_length(rest) - opened - 1)
    cut = F.transform(F.split(F.trim(inside), r"\s+"), lambda t: F.struct(F.substr(t, F.lit(1), F.char_length(t) - F.char_length(F.substring_index(t, "-", -1)) - 1).alias("k"), F.substring_index(t, "-", -1).alias("v")))
    pairs = F.when(whole, F.filter(cut, lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (p["v"] != ""))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    last = lambda own: lambda k: F.element_at(F.filter(own, lambda p: p["k"] == k), -1)["v"]
    values = let(pairs, lambda own: let(F.array_distinct(F.transform(own, lambda p: p["k"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, last(own)))))
    dash = F.instr(name, " - ")
    plain = F.trim(F.when(dash > 0, F.substr(name, dash + 3)).otherwise(name))
    return F.struct(F.coalesce(F.nullif(F.when(whole, kind).otherwise(plain), F.lit("")), F.lit("(untyped)")).alias("type"), values.alias("values"))


def name_tokens(name: Column) -> Column:
    """The distinct words of a test name: letters, a hyphen and what is joined to it; or a letter and what follows it. Sorted."""
    runs = F.filter(F.split(name, r"[^A-Za-z0-9.-]+"), lambda r: F.rlike(r, F.lit("[A-Za-z]")))
    joined = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("[A-Za-z]+(?:-[A-Za-z0-9.]+|[A-Za-z0-9]*)"), F.lit(0))))
    return F.array_sort(F.array_distinct(joined))
