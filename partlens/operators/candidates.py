"""From stored specifications to candidates: one pass over long rows, one row for each part and key, then one record a part.

specs(part_id, key, value_min, value_typ, value_max, value_text, confidence, seq): seq is the order of storage, in which
later rows win ties. A resolved row has a value, or a text, or a band (lo, hi; either may be missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import parsing as P
from partlens.functions import text as X
from partlens.functions import vocabulary as V

from .resolve import pick

BANDED = r"^(.+)@(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)GHz$"
RESOLVED = "struct<value:double,text:string,lo:double,hi:double>"


def _table(values: dict, value) -> Column:
    return F.create_map(*(c for k, v in values.items() for c in (F.lit(k), value(v))))


def renamed(key: Column) -> Column:
    """One name for keys that sources spell differently."""
    return F.coalesce(F.try_element_at(_table(V.RENAMED, F.lit), key), key)


def _roles(specs: DataFrame) -> DataFrame:
    """Each stored row under the name it is read by, and what it is there: an edge, a band, a number, a banded number or a text."""
    role = lambda name, kind, first="typ": F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), F.lit(kind).alias("kind"), F.lit(first).alias("first"))
    edge = F.try_element_at(_table(V.edges(), lambda own: F.array(*(role(n, k) for n, k in own))), F.col("key"))
    known = F.try_element_at(_table(V.KEYS, lambda v: role(v[0], "number", v[1])), F.col("key"))
    based = F.try_element_at(_table(V.KEYS, lambda v: role(v[0], "banded", v[1])), F.regexp_extract("key", BANDED, 1))
    said = F.coalesce(F.col("value_text"), F.lit("")) != ""
    rows = specs.withColumn("key", renamed(F.col("key")))
    roles = (
        F.when(edge.isNotNull(), edge)
        .when(F.col("key") == "freq_ghz", F.when(F.col("value_min").isNotNull() & F.col("value_max").isNotNull(), F.array(role("freq_ghz", "band"))))
        .when(F.rlike(F.col("key"), F.lit(BANDED)), F.when(based.isNotNull(), F.array(based)))
        .when(known.isNotNull(), F.array(known))
        .when(said & F.col("key").isin(V.TEXTS), F.array(role(F.col("key"), "text")))
        .otherwise(F.array(role(F.col("key"), "free")))
    )
    rows = rows.withColumn("role", F.explode(roles))
    stated = F.coalesce("value_typ", "value_min", "value_max")
    low = F.when(F.col("role.kind").isin("both", "band"), F.coalesce("value_min", stated)).when(F.col("role.kind") == "lo", stated)
    high = F.when(F.col("role.kind").isin("both", "band"), F.coalesce("value_max", stated)).when(F.col("role.kind") == "hi", stated)
    number = F.coalesce(*(F.when(F.col("role.first") == p, pick(p, F.col("value_min"), F.col("value_typ"), F.col("value_max"))) for p in ("min", "max", "typ")))
    cut = lambda i: F.when(F.col("role.kind") == "banded", F.regexp_extract("key", BANDED, i).try_cast("double"))
    return rows.select(
        "part_id", F.col("role.name").alias("key"), F.col("role.kind").alias("kind"), F.col("role.first").alias("first"), number.alias("number"), F.col("value_text").alias("text"),
        low.alias("lo"), high.alias("hi"), cut(2).alias("from_ghz"), cut(3).alias("to_ghz"), F.substring_index("key", "@", -1).alias("label"), "confidence", "seq",
    )


def resolve(specs: DataFrame, wanted: tuple[float, float] | None = None) -> DataFrame:
    """part_id, key, value, text, lo, hi, band: one row for each part and key; all rules in one aggregation by part and key.

    Numbers: the highest confidence, of equal ones the last. Texts of the known kinds: the last; others the first, where
    there is no number. Bands: the last of each edge, in order. Numbers that hold for a band (`key@2-18GHz`) replace
    others: the band that covers what is wanted or overlaps it most, else the value that holds in all of them; `band` names it.
    """
    rows = _roles(specs)
    of = lambda *kinds: F.col("kind").isin(*kinds)
    best = lambda value, order, where: F.max_by(F.when(where, value), F.when(where, order))
    known = F.col("number").isNotNull()
    plain = best(F.col("number"), F.struct("confidence", "seq"), of("number", "free") & known)
    last_text, first_text = best(F.col("text"), F.col("seq"), of("text")), best(F.col("text"), -F.col("seq"), of("free") & ~known & (F.col("text") != ""))
    edge = lambda c: best(F.col(c), F.col("seq"), F.col(c).isNotNull())
    banded = F.struct(F.col("number").alias("value"), F.col("label").alias("band"))
    worst = best(banded, F.struct(F.when(F.col("first") == "max", F.col("number")).otherwise(-F.col("number")), -F.col("seq")), of("banded") & known)
    if wanted:
        lo, hi = wanted
        overlap = F.least(F.col("to_ghz"), F.lit(float(hi))) - F.greatest(F.col("from_ghz"), F.lit(float(lo)))
        covers = ((F.col("from_ghz") <= lo) & (F.col("to_ghz") >= hi)).cast("int")
        worst = F.coalesce(best(banded, F.struct(covers, overlap, -F.col("seq")), of("banded") & (overlap > 0)), worst)
    out = rows.groupBy("part_id", "key").agg(plain.alias("plain"), last_text.alias("last_text"), first_text.alias("first_text"), edge("lo").alias("lo"), edge("hi").alias("hi"), worst.alias("banded"))
    chosen = F.col("banded.value").isNotNull()
    out = out.select(
        "part_id", "key", F.when(chosen, F.col("banded.value")).otherwise(F.col("plain")).alias("value"), F.when(chosen | F.col("plain").isNotNull(), None).otherwise(F.coalesce("last_text", "first_text")).alias("text"),
        F.when(F.col("lo") > F.col("hi"), F.col("hi")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") > F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.when(chosen, F.col("banded.band")).alias("band"),
    )
    return out.where("value IS NOT NULL OR text IS NOT NULL OR lo IS NOT NULL OR hi IS NOT NULL")


def records(resolved: DataFrame) -> DataFrame:
    """part_id, specs: a map from key to value, text or band, with what follows from others: noise from losses, packages split, repeated parts dropped."""
    entry = F.struct("key", F.struct("value", "text", "lo", "hi").cast(RESOLVED).alias("v"))
    band = F.struct(F.concat("key", F.lit("_band")).alias("key"), F.struct(F.lit(None).alias("value"), F.col("band").alias("text"), F.lit(None).alias("lo"), F.lit(None).alias("hi")).cast(RESOLVED).alias("v"))
    entries = F.flatten(F.collect_list(F.when(F.col("band").isNotNull(), F.array(entry, band)).otherwise(F.array(entry))))
    rows = resolved.groupBy("part_id").agg(F.map_from_entries(entries).alias("specs"))
    rows = rows.withColumn("_package", P.package(P.dedupe_commas(F.try_element_at("specs", F.lit("package"))["text"])))
    at = lambda key: F.try_element_at("specs", F.lit(key))
    number = lambda x: F.struct(x.alias("value"), F.lit(None).alias("text"), F.lit(None).alias("lo"), F.lit(None).alias("hi")).cast(RESOLVED)
    text = lambda x: F.struct(F.lit(None).alias("value"), x.alias("text"), F.lit(None).alias("lo"), F.lit(None).alias("hi")).cast(RESOLVED)
    loss = F.coalesce(F.abs(at("insertion_loss_db")["value"]), F.abs(at("conversion_loss_db")["value"]))
    source = F.when(at("insertion_loss_db")["value"].isNotNull(), "insertion_loss_db").otherwise("conversion_loss_db")
    package = F.col("_package")
    missing = lambda key: at(key).isNull()
    derived = [
        (at("noise_nf_db")["value"].isNull() & loss.isNotNull(), "noise_nf_db", number(loss)),
        (at("noise_nf_db")["value"].isNull() & loss.isNotNull(), "noise_nf_db_from", text(source)),
        (missing("package_body") & package["body"].isNotNull(), "package_body", text(package["body"])),
        (missing("mount_type") & package["mount"].isNotNull(), "mount_type", text(package["mount"])),
        (missing("hermetic") & package["hermetic"], "hermetic", text(F.lit("yes"))),
    ]
    more = F.filter(F.array(*(F.when(when, F.struct(F.lit(k).alias("key"), v.alias("v"))) for when, k, v in derived)), lambda x: x.isNotNull())
    tidy = F.transform_values("specs", lambda k, v: F.when(k.isin(*V.LISTED, "package") & v["text"].isNotNull(), text(P.dedupe_commas(v["text"]))).otherwise(v))
    joined = P.let(F.map_from_entries(more), lambda added: F.map_concat(F.map_filter(tidy, lambda k, v: ~F.map_contains_key(added, k)), added))
    return rows.select("part_id", joined.alias("specs"))


def evidence_of(evidence: DataFrame) -> DataFrame:
    """part_id, qual_evidence (in the order of storage), qual_summary: the first six signals with their weights."""
    rows = evidence.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct("seq", "signal", "weight", "snippet"))).alias("e"))
    said = F.transform(F.slice("e", 1, 6), lambda x: F.concat(x["signal"], F.lit(" "), F.when(x["weight"] >= 0, "+").otherwise(""), F.regexp_replace(F.format_string("%s", x["weight"]), r"\.0$", "")))
    return rows.select("part_id", F.transform("e", lambda x: x.dropFields("seq")).alias("qual_evidence"), F.array_join(said, ", ").alias("qual_summary"))


def covers(specs: Column, wanted: tuple[float, float], unstated: bool = True, slack: float = 1e-9) -> Column:
    """Whether the stated band covers the wanted one; a single frequency is a band of its own; parts that state none stay unless told otherwise."""
    own = F.try_element_at(specs, F.lit("freq_ghz"))
    lo, hi = F.coalesce(own["lo"], own["value"]), F.coalesce(own["hi"], own["value"])
    return F.when(lo.isNull() | hi.isNull(), F.lit(unstated)).otherwise((lo <= wanted[0] + slack) & (hi >= wanted[1] - slack))


def assemble(parts: DataFrame, specs: DataFrame, evidence: DataFrame, category: str | None = None, vendors: list[str] | None = None, ids: list[int] | None = None, wanted: tuple[float, float] | None = None, unstated: bool = True, limit: int | None = None) -> DataFrame:
    """Candidates: parts(part_id, mpn, vendor, category, subcategory, product_url, description, last_seen) with their specs and evidence.

    Filters on the part come before the joins; the most recent `limit` are taken after the band's filter.
    """
    if category:
        parts = parts.where(F.col("category") == category)
    if vendors:
        parts = parts.where(F.col("vendor").isin(vendors))
    if ids:
        parts = parts.where(F.col("part_id").isin(ids))
    own = lambda rows: rows.join(parts.select("part_id"), "part_id", "left_semi") if category or vendors or ids else rows
    out = parts.join(records(resolve(own(specs), wanted)), "part_id", "left").join(evidence_of(own(evidence)), "part_id", "left")
    out = out.withColumn("specs", F.coalesce("specs", F.create_map().cast(f"map<string,{RESOLVED}>"))).withColumn("vendor_raw", F.col("vendor")).withColumn("vendor", X.canonical_vendor(F.col("vendor")))
    out = out.withColumn("category", F.nullif(F.col("category"), F.lit(""))).withColumn("subcategory", F.nullif(F.col("subcategory"), F.lit(""))).withColumn("qual_summary", F.coalesce("qual_summary", F.lit("")))
    if wanted:
        out = out.where(covers(F.col("specs"), wanted, unstated))
    return out.orderBy(F.desc("last_seen"), "part_id").limit(limit) if limit else out
