"""Personal data: base entities by expressions, further identifiers by bootstrapped contextual extraction. No Python on the data.

Base: e-mail addresses, IP addresses, payment cards and phone numbers, leftmost and not overlapping within a kind;
matches that fail their kind's test are dropped. A text is only scanned for a kind whose signs it holds.

Bootstrapping: identifier-like tokens (6 signs or more with a digit) are instances; the words before them, their shape,
and both together are lexical patterns. Base entities and values assigned to a credential's name (by a blank, quote,
colon or '='; these of any length with a digit) are the seeds. In
each round a pattern's confidence is the share of its distinct instances that are accepted (patterns with few accepted
ones don't count), an instance's confidence is that some accepted pattern is right (noisy or), and instances above
the threshold are accepted for the next round. Accepted ones stay so, and rounds go on until none is added. The
pattern-instance graph is a table of distinct edges in shared storage, so a line that repeats in a third of all rows
is one edge each; long instances and shapes stand in it by their hash. Occurrences of accepted instances outside
base spans are added as kind `id`; those of under 6 signs only where they are assigned to a credential.

Null texts are empty and have no spans; an empty table gives no rows; repeated rows have the same spans; positions are
code points, ends exclusive. The work on a text grows with its length and its number of spans, not with their product.
Columns other than doc_id and text are ignored by `find`, whatever their names, and kept by `mask`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RUN, before, dropped, let, running, written

#: Kinds in order: name, sign that a text must hold, expression. Possessive loops and looks behind keep them linear.
KINDS = [
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){13}", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
NAMES = [k for k, _, _ in KINDS] + ["id"]
IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
#: Names of credentials; what is assigned to them is a seed.
CREDENTIAL = "(?:token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth)"
#: Tokens with a digit, and the signs that they are made of. An '=' after a credential's name ends a token and begins another.
EQUALS = rf"(?:(?<!(?i:{CREDENTIAL}))=++"
TOKEN = rf"(?:(?<![A-Za-z0-9_@+/=.-])|(?<=(?i:{CREDENTIAL})=))[A-Za-z_@+/.-]*+{EQUALS}[A-Za-z_@+/.-]*+)*+[0-9][A-Za-z0-9_@+/.-]*+{EQUALS}[A-Za-z0-9_@+/.-]*+)*+"
#: What stands before an assigned value; only a credential's '=' stands right before a token.
CREDENTIALS = rf"{CREDENTIAL}\s*(?:=|:|=>)\s*[\"']?$|=$"
SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"
SEEN = "array<struct<start:int,stop:int,kind:int,value:string,before:string>>"
TOKENS = "array<struct<start:int,stop:int,value:string,before:string,inside:boolean>>"
#: Parts that the edges of a value or pattern, and the places of a value, are dealt into.
PARTS = 64


def _spans(text: Column, pattern: str, kind: int, context: bool = False) -> Column:
    """start, stop, kind and value of a pattern's matches, and what stands before each."""
    none = F.array().cast(SEEN)

    def walk(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda v, i: F.char_length(v) + F.char_length(F.get(between, i)))
        one = lambda stops: lambda v, i: F.struct(
            (F.get(stops, i) - F.char_length(v)).alias("start"), F.get(stops, i).alias("stop"), F.lit(kind).alias("kind"), v.alias("value"),
            (F.right(F.get(between, i), F.lit(60)) if context else F.lit("")).alias("before"),
        )
        return let(running(steps, "int", lambda x, y: x + y), lambda stops: F.transform(found, one(stops)).cast(SEEN))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda p: walk(m, p))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled (less 9 above 9), and the others add up to tens."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(IP))
    if kind == "card":
        return F.char_length(_digits(value)).between(14, 19) & F.when(F.char_length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    found = []
    for number, (kind, sign, pattern) in enumerate(KINDS):
        own = F.filter(_spans(text, pattern, number), _test(kind))
        gate = F.contains(text, F.lit(sign)) if sign == "@" else F.rlike(text, F.lit(sign))
        found.append(F.when(gate, own).otherwise(F.array().cast(SEEN)))
    return F.array_sort(F.concat(*found)).cast(SEEN)


def _shape(value: Column) -> Column:
    """Hexadecimal runs by their length, else each digit as 9 and each run of letters as one."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]", "9")
    return F.when(F.rlike(value, F.lit("^[0-9a-fA-F]{16,}$")) & F.rlike(value, F.lit("[a-fA-F]")), F.concat(F.lit("hex"), F.char_length(value).cast("string"))).otherwise(plain)


def _tokens(found: Column, base: Column) -> Column:
    """The tokens without the sentence's signs, and whether each overlaps a base span.

    One does if, of the base spans that start before its end, one ends after its start: their ends' running maximum, by position.
    """
    trimmed = F.transform(found, lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.char_length(_trimmed(t["value"]))).alias("stop"), _trimmed(t["value"]).alias("value"), t["before"].alias("before")))
    none = F.array().cast(TOKENS)

    def marked(t: Column) -> Column:
        events = F.array_sort(F.concat(F.transform(t, lambda x: F.struct(x["stop"].alias("at"), F.lit(0).alias("base"), F.lit(-1).alias("end"))), F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["stop"].alias("end")))))
        return let(events, lambda e: let(running(F.transform(e, lambda x: x["end"]), "int", F.greatest), lambda ends: let(_where(e, ends), lambda own: told(t, own))))

    def _where(events: Column, ends: Column) -> Column:
        pairs = F.transform(events, lambda x, i: F.struct(x["base"].alias("base"), F.get(ends, i).alias("end")))
        return F.filter(pairs, lambda x: x["base"] == 0)

    def told(t: Column, own: Column) -> Column:
        return F.transform(t, lambda x, i: F.struct(x["start"], x["stop"], x["value"], x["before"], F.get(own, i)["end"] > x["start"])).cast(TOKENS)

    plain = lambda t: F.transform(t, lambda x: F.struct(x["start"], x["stop"], x["value"], x["before"], F.lit(False))).cast(TOKENS)
    return F.when(F.size(found) == 0, none).otherwise(let(trimmed, lambda t: F.when(F.size(base) == 0, plain(t)).otherwise(marked(t))))


def scanned(docs: DataFrame) -> DataFrame:
    """One scan of all texts: doc_id, key of the text, base spans, and identifier-like tokens with what stands before them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", F.xxhash64("_text").alias("text_key"), F.when(F.rlike(F.col("_text"), F.lit("[0-9@]")), F.col("_text")).alias("_text"))
    text, none = F.col("_text"), F.array().cast(SEEN)
    fits = lambda s: (s["stop"] - s["start"] >= 6) | _assigned(s["before"])
    tokens = F.filter(_spans(text, TOKEN, len(KINDS), context=True), fits)
    found = let(base_spans(text), lambda b: F.struct(b.alias("base"), let(tokens, lambda t: _tokens(t, b)).alias("tokens")))
    rows = rows.select("doc_id", "text_key", F.when(text.isNotNull(), found).alias("f"))
    return rows.select("doc_id", "text_key", F.coalesce("f.base", none).alias("base"), F.coalesce("f.tokens", F.array().cast(TOKENS)).alias("tokens"))


def _assigned(before: Column) -> Column:
    return F.rlike(F.lower(before), F.lit(CREDENTIALS))


def _key(value: Column) -> Column:
    """The value, or its hash if it is long."""
    return F.when(F.char_length(value) > 64, F.sha2(value, 256)).otherwise(value)


def _trimmed(token: Column) -> Column:
    """The token without signs at its end that belong to the sentence."""
    return F.regexp_replace(token, r"[.=/+-]+$", "")


def _part(column: str) -> Column:
    return F.expr(f"pmod(xxhash64({column}), {PARTS})")


def discover(scan: DataFrame, support: int = 3, pattern_share: float = 0.7, accept: float = 0.8) -> DataFrame:
    """value: the keys of the accepted instances once no round adds any.

    A value's edges are dealt into parts by their pattern, a pattern's by their value; what is known of either goes to
    (itself, part), so neither a hot value nor a hot pattern ends in one task.
    """
    seen = scan.select(F.explode("tokens").alias("t")).select("t.value", "t.before", (F.col("t.inside") | _assigned(F.col("t.before"))).alias("seed"))
    tail = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace("before", "[0-9]", "9")), r"\s+", " ")), " ")
    last = F.when(F.size(tail) >= 1, F.element_at(tail, -1)).otherwise("")
    two = F.concat_ws(" ", F.when(F.size(tail) >= 2, F.element_at(tail, -2)).otherwise(""), last)
    shape = _key(_shape(F.col("value")))
    edges = seen.where((F.char_length("value") >= 6) | F.col("seed")).select(_key(F.col("value")).alias("value"), F.col("seed").cast("int").alias("seed"), F.explode(F.array(F.concat(F.lit("before "), two), F.concat(F.lit("shape "), shape), F.concat_ws(" ", F.lit("both"), last, shape))).alias("pattern"))
    edges = written(edges.groupBy("value", "pattern").agg(F.max("seed").alias("seed")).withColumn("by_value", _part("pattern")).withColumn("by_pattern", _part("value")), "edges")
    of_value, of_pattern = edges.select("value", "by_value").distinct(), edges.select("pattern", "by_pattern").distinct()
    seeds = edges.where("seed = 1").select("value")
    accepted = written(seeds.distinct(), "accepted")
    before, count = -1, accepted.count()
    while before < count:
        good = of_value.join(accepted, "value").withColumn("good", F.lit(1))
        marked = edges.join(good, ["value", "by_value"], "left")
        patterns = marked.groupBy("pattern", "by_pattern").agg(F.count("*").alias("n"), F.count("good").alias("good")).groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        patterns = patterns.where(f"good >= {support} AND good >= {pattern_share} * n").select("pattern", (F.col("good") / (F.col("n") + 1)).alias("confidence"))
        scores = edges.join(of_pattern.join(patterns, "pattern"), ["pattern", "by_pattern"]).groupBy("value").agg((1 - F.exp(F.sum(F.ln(1 - F.col("confidence"))))).alias("confidence"))
        last_table, accepted = accepted, written(scores.where(f"confidence >= {accept}").select("value").union(seeds).distinct(), "accepted")
        dropped(last_table)
        before, count = count, accepted.count()
    return accepted


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_key, base and spans (start, stop, kind, value) of documents(doc_id, text), in the rows' number."""
    scan = written(scanned(docs), "scan")
    accepted = discover(scan, **options).withColumnRenamed("value", "key")
    places = scan.select("doc_id", "text_key", F.explode("tokens").alias("t")).where("NOT t.inside").select("doc_id", "text_key", "t.start", "t.stop", "t.value", _key(F.col("t.value")).alias("key")).withColumn("part", _part("text_key"))
    known = places.select("key", "part").distinct().join(accepted, "key")
    more = places.join(known, ["key", "part"]).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.col("text_key").alias("k2")).agg(F.collect_set(F.struct("start", "stop", F.lit(len(KINDS)).alias("kind"), "value")).alias("more"))
    joined = scan.drop("tokens").join(more, (F.coalesce("doc_id", F.lit(-1)) == F.col("k1")) & (F.col("text_key") == F.col("k2")), "left")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))
    every = F.array_sort(F.concat(base.cast(SPAN), F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN))))
    return joined.select("doc_id", "text_key", base.cast(SPAN).alias("base"), every.alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans leave one mark.

    A part of a text is found by counting signs from its start, so the text is cut once for every RUN spans and these are taken from the cut.
    """
    names = F.array(*(F.lit(f"[{n.upper()}]") for n in NAMES))

    def cut(ends: Column, c: Column) -> Column:
        first = before(ends, c * RUN)
        whole = F.substring(text, first + 1, F.get(ends, F.least((c + 1) * RUN, F.size(spans)) - 1) - first)
        return let(F.struct(first.alias("first"), whole.alias("text")), lambda own: F.array_join(F.transform(F.slice(spans, c * RUN + 1, RUN), lambda s, i: piece(own, before(ends, c * RUN + i), s)), ""))

    def piece(own: Column, reach: Column, s: Column) -> Column:
        kept = F.concat(F.substring(own["text"], reach - own["first"] + 1, s["start"] - reach), F.get(names, s["kind"]))
        return F.when(s["start"] >= reach, kept).otherwise("")

    def whole(ends: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int")), lambda c: cut(ends, c))
        return F.concat(F.array_join(cuts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, let(running(F.transform(spans, lambda s: s["stop"]), "int", F.greatest), whole)).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with their personal data masked, with the columns they had."""
    spans = find(docs).where(F.size("spans") > 0).select(F.coalesce("doc_id", F.lit(-1)).alias("_k1"), F.col("text_key").alias("_k2"), "spans").dropDuplicates(["_k1", "_k2"]).withColumnRenamed("spans", "_spans")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.col("text").cast("string").alias("_text"))
    rows = rows.join(spans, (F.col("_id") == F.col("_k1")) & (F.xxhash64(F.coalesce("_text", F.lit(""))) == F.col("_k2")), "left")
    new = F.when(F.col("_spans").isNotNull(), masked(F.col("_text"), F.col("_spans"))).otherwise(F.col("_text"))
    kept = [new.alias(c) if c == "text" else F.char_length(new).cast(t).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c, t in docs.dtypes]
    return rows.select(*kept)
