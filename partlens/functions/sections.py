"""Parts of datasheet texts: sections, labels, lines of qualification, training texts, part numbers of file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parsing as P

#: Headings of sections, and words that show that a line is about engineering.
HEADINGS = {"description": "general description, product description, description, overview", "features": "features, key features, product features", "applications": "applications, typical applications"}
SIGNALS = "ghz, mhz, db, dbm, hermetic, ceramic, screened, screening, qualified, mil std, class, krad, package, alumina, gold, kovar, die"
QUALIFIES = "mil prf, mil std, qml, escc, jans, space, hermetic, screened, screening, burn in, krad, radiation, outgassing, lot acceptance, class"
UNITS = "ghz mhz khz hz db dbm dbc v ma a w ns us ms ohm ohms c".split()
STATISTICS = "min max typ typical minimum maximum nominal unit units".split()


def sections(texts: DataFrame, key: str) -> DataFrame:
    """key, section, text: lines under a heading up to the next one; a heading is a short line that is one of its names."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    plain = F.trim(F.regexp_replace(F.lower("line"), "[^a-z]+", " "))
    named = F.coalesce(*(F.when(plain.isin([w.strip() for w in words.split(",")]), name) for name, words in HEADINGS.items()))
    # a line in capitals without figures begins something else
    other = F.rlike("line", F.lit(r"^\s*[A-Z][A-Z ,/&-]{5,60}\s*$")) & named.isNull()
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.last(F.coalesce(named, F.when(other, "")), ignorenulls=True).over(upto)
    rows = lines.withColumn("named", named).withColumn("section", open_).where("section <> '' AND named IS NULL AND trim(line) <> ''")
    return rows.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.trim(x["line"])), "\n").alias("text"))


def has_signal(line: Column) -> Column:
    return P.spoken(line, SIGNALS) | F.rlike(line, F.lit(r"\d"))


def qualification_notes(text: Column, most: int = 1200) -> Column:
    """Lines about qualification, each once, no more than the signs allowed; lines of figures are left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & P.spoken(x, QUALIFIES) & (F.char_length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 0.4 * F.char_length(x)))
    key = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")

    def fitted(own: Column) -> Column:
        keys = F.transform(own, key)
        once = F.filter(own, lambda x, i: F.array_position(keys, key(x)) == i + 1)
        return F.aggregate(once, F.lit(""), lambda acc, x: F.when(F.char_length(acc) + F.char_length(x) + 1 > most, acc).when(acc == "", x).otherwise(F.concat(acc, F.lit("\n"), x)))

    return P.let(lines, fitted)


def composed(title: Column, category: Column, parts: list[Column]) -> Column:
    """A training text: title, category and what else is there, a line each."""
    return F.concat_ws("\n", *(F.nullif(F.trim(c), F.lit("")) for c in (title, category, *parts)))


def clean_label(raw: Column) -> Column:
    """A table's label without numbering, notes, units and statistics; null for prose, lone figures, and what is too short or long."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"\([^)]*\)|\[[^\]]*\]", " "), r"^[\s\d.•*·-]+", "")
    words = F.filter(F.split(F.trim(F.regexp_replace(s, r"[\s:;,=]+", " ")), " "), lambda w: (w != "") & ~w.isin(STATISTICS))

    def judged(own: Column) -> Column:
        last = F.element_at(own, -1)
        trimmed = F.when((F.size(own) > 1) & last.isin(UNITS), F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own)
        said = F.array_join(trimmed, " ")
        digits = F.char_length(F.regexp_replace(said, "[^0-9]", ""))
        fine = F.size(trimmed).between(1, 6) & F.char_length(said).between(3, 48) & (digits <= 0.4 * F.char_length(said)) & ~F.rlike(said, F.lit(r"[.!?]$|\b(?:the|is|are|with|this|that)\b"))
        return F.when(fine, said)

    return P.let(words, lambda w: F.when(F.size(w) > 0, judged(w)))


def ports_in(label: Column) -> Column:
    """The ports that a label names, in the order rf, lo, if."""
    return F.filter(F.array(*(F.when(P.spoken(label, p), p) for p in ("rf", "lo", "if"))), lambda p: p.isNotNull())


def without_bullet(label: Column) -> Column:
    """struct(label, bullet): the text without a marketing bullet, and whether there was one."""
    return F.struct(F.trim(F.regexp_replace(label, r"^\s*[•●▪*·–-]+\s*", "")).alias("label"), F.rlike(label, F.lit(r"^\s*[•●▪*·]")).alias("bullet"))


def number_of_file(path: Column) -> Column:
    """The part number in a file's name: without the extension and words like datasheet or a revision."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z]{2,5}$", "")
    words = F.filter(F.split(stem, r"[_\s]+"), lambda w: (w != "") & ~F.rlike(w, F.lit(r"(?i)^(?:datasheet|ds|data|sheet|rev[a-z0-9]*|v\d+|final|copy|\(\d+\))$")))
    shaped = F.filter(words, lambda w: F.rlike(w, F.lit("[0-9]")) & F.rlike(w, F.lit("[A-Za-z]")))
    return P.let(words, lambda w: F.coalesce(F.get(shaped, F.lit(0)), F.get(w, F.lit(0)), F.lit("")))


def redacted(text: Column, mpn: Column, mark: str = "[PN]") -> Column:
    """The text without a part number, also where separators stand between its signs; short numbers aren't looked for."""
    signs = F.filter(F.split(F.regexp_replace(F.upper(mpn), "[^A-Z0-9]", ""), ""), lambda c: c != "")
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), F.array_join(signs, r"[-\s_.+/]?"), F.lit(r"\+?(?![A-Za-z0-9])"))
    return F.when(F.size(signs) >= 4, F.regexp_replace(text, pattern, F.lit(mark))).otherwise(text)


def url_problem(url: Column) -> Column:
    """Why an address isn't worth fetching; null if nothing speaks against it."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(u, r"://([^/?#]*)", 1)
    return F.when(u == "", "empty").when(~F.rlike(u, F.lit("^https?://")), "no scheme").when((host == "") | ~F.contains(host, F.lit(".")), "no host").when(F.rlike(u, F.lit(r"\s")), "blank inside").when(F.rlike(u, F.lit(r"[{}]")), "unfilled template")


def url_candidates(stored: Column, mpn: Column, templates: list[str]) -> Column:
    """Addresses worth trying, the stored one first, each once; templates know {pn}, {pn_lower}, {pn_upper} and {pn_base} (without a packing suffix)."""
    base = F.regexp_replace(mpn, r"(?i)-(?:tr|r7|rl|reel|t)$|\+$", "")
    filled = []
    for t in templates:
        column = F.lit(t)
        for name, value in (("{pn_lower}", F.lower(mpn)), ("{pn_upper}", F.upper(mpn)), ("{pn_base}", base), ("{pn}", mpn)):
            column = F.replace(column, F.lit(name), value)
        filled.append(column)
    every = F.array(F.when(F.startswith(stored, F.lit("http")), stored), *(F.when(F.trim(mpn) != "", c) for c in filled))
    return F.array_distinct(F.filter(every, lambda u: u.isNotNull() & url_problem(u).isNull()))
