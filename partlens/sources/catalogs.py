"""Catalogues on disk as records: parametric workbooks, saved listing pages, parametric HTML tables, embedded records, datasheet texts.

A reader gives long rows (where a cell stands, its heading or label, its text); what they mean is decided by columns. A record
has mpn, vendor, category, subcategory, product_url, datasheet_url, description, source and specs (an array of
struct(key, value_min, value_typ, value_max, value_text, unit, method, confidence, snippet)). `stored` makes store rows of records.
"""

from __future__ import annotations

import html as entities
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.functions import parsing as P
from partlens.functions import readings as Z
from partlens.operators import filters as L

SPEC = "struct<key:string,value_min:double,value_typ:double,value_max:double,value_text:string,unit:string,method:string,confidence:double,snippet:string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Keys that a general catalogue never writes.
NO_CLAIMS = ["space", "space_variant", "erf_grade"]


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """sheet, row, column and text of a workbook's cells; of formulas their text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = links[sheet.get(f"{REL}id")].lstrip("/")
            tree = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in tree.iter(f"{MAIN}row"):
                for at, cell in enumerate(row.findall(f"{MAIN}c")):
                    letters = re.match("[A-Z]+", cell.get("r") or "")
                    column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else at
                    formula, value = cell.find(f"{MAIN}f"), cell.find(f"{MAIN}v")
                    if formula is not None and formula.text:
                        text = formula.text
                    elif cell.get("t") == "s" and value is not None:
                        text = shared[int(value.text)]
                    elif cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    else:
                        text = value.text if value is not None else None
                    if text is not None:
                        yield sheet.get("name"), int(row.get("r")) - 1, column, text


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col, text of all workbooks below a path; files that aren't workbooks give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(file, *c) for c in sheet_cells(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row int, col int, text string")


def _number_spec(key: Column, value: Column, unit: Column, method: str, confidence: float, snippet: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(key.alias("key"), none.alias("value_min"), value.alias("value_typ"), none.alias("value_max"), F.lit(None).cast("string").alias("value_text"), unit.alias("unit"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), (snippet if snippet is not None else F.lit("")).alias("snippet")).cast(SPEC)


def _text_spec(key: Column, text: Column, method: str, confidence: float, snippet: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(key.alias("key"), none.alias("value_min"), none.alias("value_typ"), none.alias("value_max"), text.alias("value_text"), F.lit("").alias("unit"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), (snippet if snippet is not None else F.lit("")).alias("snippet")).cast(SPEC)


def workbook_records(cells: DataFrame, vendor: str, confidence: float = 0.9) -> DataFrame:
    """Records of parametric workbooks: a cover names the product type, column 0 holds the part number (often as a link), a row of units may follow the headings.

    The last sheet counts unless one is called Web Display. What the sheet doesn't state is filled from the description.
    """
    cover = cells.where("sheet = 'Cover' AND row < 12")
    asked = cover.where(F.contains(F.lower("text"), F.lit("product type"))).select("path", "row", F.col("col").alias("at"))
    told = cover.join(asked, ["path", "row"]).where("col > at").groupBy("path").agg(F.min_by("text", F.struct("row", "col")).alias("product_type"))
    body = cells.where("sheet <> 'Cover'")
    shown = body.groupBy("path").agg(F.max(F.when(F.col("sheet") == "Web Display", "Web Display")).alias("named"), F.max("sheet").alias("last"))
    body = body.join(shown.select("path", F.coalesce("named", "last").alias("sheet")), ["path", "sheet"])
    heads = body.where("row = 0").select("path", "col", F.trim("text").alias("header"))
    heads = heads.withColumn("key", Z.ruled(F.col("header"), Z.COLUMNS)).withColumn("unit", F.coalesce(Z.ruled(F.col("header"), Z.COLUMNS, 2), F.lit("")))
    kind = heads.where(F.contains(F.lower("header"), F.lit("type")) & (F.col("col") > 0) & F.col("key").isNull()).groupBy("path").agg(F.min("col").alias("type_col"))
    linked = F.rlike("text", F.lit(r"(?i)HYPERLINK\("))
    units = body.where("row = 1").groupBy("path").agg(((F.count_if((F.char_length("text") <= 12) & (F.col("text") != "")) >= 3) & ~F.bool_or(linked)).cast("int").alias("skip"))
    rows = body.join(units, "path", "left").where(F.col("row") > F.coalesce("skip", F.lit(0)))
    first = rows.where("col = 0").select("path", "row", F.regexp_extract("text", r'(?i)HYPERLINK\(\s*"([^"]+)"\s*,\s*"[^"]+"', 1).alias("product_url"), F.trim(F.coalesce(F.nullif(F.regexp_extract("text", r'(?i)HYPERLINK\(\s*"[^"]+"\s*,\s*"([^"]+)"', 1), F.lit("")), "text")).alias("mpn"))
    first = first.where(F.char_length("mpn") >= 3)
    read = rows.join(heads, ["path", "col"]).where("key IS NOT NULL")
    ghz, number = Z.workbook_ghz(F.col("text"), F.col("header")), Z.number_of(F.col("text"))
    celsius = F.regexp_extract_all("text", F.lit(r"-?\d+"), F.lit(0))
    entries = (
        F.when(F.col("key").isin(Z.FREQUENCY_KEYS), F.array(_number_spec(F.col("key"), ghz, F.lit("GHz"), "catalog", confidence)))
        .when(F.col("key").isin(Z.TEXT_KEYS), F.array(_text_spec(F.col("key"), F.when(~F.lower(F.trim("text")).isin(Z.NOTHING), F.substring(F.trim("text"), 1, 60)), "catalog", confidence)))
        .when(F.col("key") == "temp_range", F.array(*(_number_spec(F.lit(k), F.get(celsius, F.lit(i)).try_cast("double"), F.lit("C"), "catalog", confidence) for i, k in enumerate(("temp_min_c", "temp_max_c")))))
        .otherwise(F.array(_number_spec(F.col("key"), number, F.col("unit"), "catalog", confidence), _number_spec(F.lit("conversion_loss_db"), F.when((F.col("key") == "conversion_gain_db") & (number < 0), -number), F.lit("dB"), "catalog", confidence)))
    )
    stated = read.where("key <> 'description'").select("path", "row", F.explode(entries).alias("s")).where("s.value_typ IS NOT NULL OR s.value_text IS NOT NULL")
    said = read.where("key = 'description'").groupBy("path", "row").agg(F.substring(F.first("text"), 1, 200).alias("description"))
    typed = rows.join(kind, "path").where("col = type_col").select("path", "row", F.trim("text").alias("row_type"))
    out = first.join(stated.groupBy("path", "row").agg(F.array_sort(F.collect_list("s")).alias("stated")), ["path", "row"], "left").join(said, ["path", "row"], "left").join(typed, ["path", "row"], "left").join(told, "path", "left")
    known = F.transform(F.coalesce("stated", F.array().cast(f"array<{SPEC}>")), lambda s: s["key"])
    filled = F.transform(F.filter(Z.described(F.col("description")), lambda e: ~F.array_contains(known, e["key"])), lambda e: _number_spec(e["key"], e["value"], e["unit"], "catalog", confidence, F.lit("description")))
    device = F.when(~F.lower(F.coalesce("row_type", F.lit(""))).isin(Z.NOTHING), F.array(_text_spec(F.lit("device_type"), F.substring("row_type", 1, 60), "catalog", confidence))).otherwise(F.array().cast(f"array<{SPEC}>"))
    general = Z.ruled(F.col("product_type"), Z.PRODUCT_TYPES, 1, "ic")
    return out.select(
        "mpn", F.lit(vendor).alias("vendor"), F.coalesce(Z.ruled(F.col("row_type"), Z.ROW_TYPES), general).alias("category"), F.coalesce(Z.ruled(F.col("row_type"), Z.ROW_TYPES, 2), F.lit("")).alias("subcategory"),
        "product_url", F.lit("").alias("datasheet_url"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("product_type", F.lit("")).alias("source"), F.concat(F.coalesce("stated", F.array().cast(f"array<{SPEC}>")), filled, device).alias("specs"), "row", "path",
    )


class _Boxes(HTMLParser):
    """The product boxes of a listing page: fields by class, and label-value rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.boxes, self.header, self.stack, self.box = [], "", [], None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        classes = (own.get("class") or "").split()
        if tag in ("br", "img", "input", "hr", "meta", "link"):
            return
        field = None
        if tag == "div" and "product-box" in classes:
            self.box = {"depth": len(self.stack), "href": "", "dname": "", "title": "", "vendor": "", "vendor_text": "", "node": "", "description": "", "attributes": []}
            self.boxes.append(self.box)
        elif tag in ("h1", "h2") and not self.header:
            field = "header"
        elif self.box is not None:
            inside = {c for _, _, cs in self.stack for c in cs}
            if tag == "a":
                if not self.box["href"] and "/products/" in (own.get("href") or ""):
                    self.box["href"] = own["href"]
                if "prod-title" in inside:
                    self.box["dname"], field = own.get("dname") or self.box["dname"], "title"
                if any(c.startswith("manuName") for c in classes):
                    self.box["vendor"], field = own.get("manu-name") or "", "vendor_text"
            elif "nodeName" in classes:
                field = "node"
            elif "descriptiontext" in classes:
                field = "description"
            elif "data-row" in classes:
                self.box["attributes"].append(["", ""])
            elif "attribute" in classes and self.box["attributes"]:
                field = 0
            elif "value" in classes and self.box["attributes"]:
                field = 1
        self.stack.append((tag, field, classes))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        if self.box is not None and len(self.stack) <= self.box["depth"]:
            self.box = None

    def handle_data(self, data):
        field = next((f for _, f, _ in reversed(self.stack) if f is not None), None)
        if field == "header":
            self.header += data
        elif self.box is not None and isinstance(field, int):
            self.box["attributes"][-1][field] += data
        elif self.box is not None and field:
            self.box[field] += data


def listing_boxes(pages: DataFrame) -> DataFrame:
    """pages(path, html) -> path, ix, header, href, mpn, vendor, node, title, description, attributes (label, value) of saved listing pages."""
    tidy = lambda x: re.sub(r"\s+", " ", x).strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, html in zip(batch["path"], batch["html"], strict=True):
                parser = _Boxes()
                parser.feed(html or "")
                for i, b in enumerate(parser.boxes):
                    title = tidy(b["title"])
                    mpn = tidy(re.sub(r"(?i)\((?:obsolete|new|featured)\)", "", b["dname"])) or tidy(title.split("-", 1)[-1])
                    if b["href"] and mpn:
                        found = [{"label": tidy(k).rstrip(":").lower(), "value": tidy(v)} for k, v in b["attributes"] if tidy(v)]
                        rows.append((path, i, tidy(parser.header), b["href"], mpn, tidy(b["vendor"] or b["vendor_text"]), tidy(b["node"]), title, tidy(b["description"]), found))
            yield pd.DataFrame(rows, columns=["path", "ix", "header", "href", "mpn", "vendor", "node", "title", "description", "attributes"])

    return pages.select("path", "html").mapInPandas(run, "path string, ix int, header string, href string, mpn string, vendor string, node string, title string, description string, attributes array<struct<label:string,value:string>>")


def listing_records(boxes: DataFrame, base: str) -> DataFrame:
    """Records of listing boxes: attributes by label, the band, power in dBm, ways, throws, mount, space class by the strongest source."""
    method, sure = "aggregator", 0.75
    at = lambda label: F.get(F.filter("attributes", lambda a: a["label"] == label), F.lit(0))["value"]
    url = Z.absolute(F.col("href"), base)
    boxes = boxes.withColumn("url", url).withColumn("band", Z.band_of(F.col("attributes")))

    def parsed(a: Column) -> Column:
        known, hint = Z.attribute(a["label"]), Z.label_unit(a["label"])
        value = F.when(known["kind"] == "text", Z.value_of("text", a["value"])).when(known["kind"] == "time_ns", Z.value_of("time_ns", a["value"], hint)).when(known["kind"] == "num", Z.value_of("num", a["value"]))
        note = F.substring(F.concat(a["label"], F.lit(": "), a["value"]), 1, 150)
        return P.let(F.struct(known["key"].alias("key"), value.alias("v"), note.alias("note")), rows)

    def rows(x: Column) -> Column:
        v = x["v"]
        one = F.struct(x["key"].alias("key"), v["value_min"], v["value_typ"], v["value_max"], v["value_text"], v["unit"], F.lit(method), F.lit(sure), x["note"]).cast(SPEC)
        power = Z.power_dbm(F.coalesce(v["value_typ"], v["value_max"], v["value_min"]), v["unit"])
        watts = x["key"].isin("power_w", "power_avg_w")
        dbm = _number_spec(F.when(x["key"] == "power_w", "psat_dbm").otherwise("power_avg_dbm"), power["dbm"], F.lit("dBm"), "derived", 0.7, x["note"])
        kept = F.when(watts & power["watts"].isNull(), F.array().cast(f"array<{SPEC}>")).otherwise(F.array(one))
        return F.when(v.isNull(), F.array().cast(f"array<{SPEC}>")).otherwise(F.concat(kept, F.when(watts & power["dbm"].isNotNull(), F.array(dbm)).otherwise(F.array().cast(f"array<{SPEC}>"))))

    said = F.flatten(F.transform("attributes", parsed))
    none = F.lit(None).cast("double")
    band = F.struct(F.lit("freq_ghz"), F.col("band.lo"), none, F.col("band.hi"), F.lit(None).cast("string"), F.lit("GHz"), F.lit(method), F.lit(sure), F.lit("")).cast(SPEC)
    category = Z.category_of_listing(F.col("url"), F.col("node"), F.col("header"), F.col("title"))
    ways = Z.ways_of(F.col("attributes"), at("type"), at("configuration"), F.col("description"), F.col("node"), F.col("title"))
    throws = F.coalesce(F.nullif(P.throw_layout(F.coalesce(at("configuration"), F.lit(""))), F.lit("")), F.nullif(P.throw_layout(F.col("title")), F.lit("")), F.nullif(P.throw_layout(F.col("description")), F.lit("")))
    stated_type, told_type = Z.switch_type(at("termination")), Z.switch_type(at("configuration"), F.col("title"), F.col("description"), at("type"))
    mount = Z.ruled(F.concat_ws(" ", at("configuration"), at("package type")), Z.MOUNTED)
    variant = Z.space_class(at("grade"), F.col("node"), F.col("header"), F.element_at(F.split("path", "/"), -2))
    more = [
        (F.col("band.hi").isNotNull(), band), (F.col("band.bandwidth").isNotNull(), _number_spec(F.lit("bandwidth_ghz"), F.col("band.bandwidth"), F.lit("GHz"), method, 0.7)),
        ((category == "divider") & ways.isNotNull(), _number_spec(F.lit("no_of_ways"), ways.cast("double"), F.lit(""), method, 0.8)), (throws.isNotNull(), _text_spec(F.lit("throw_config"), throws, method, 0.8)),
        (stated_type.isNotNull(), _text_spec(F.lit("switch_type"), stated_type, method, 0.8)), (stated_type.isNull() & told_type.isNotNull(), _text_spec(F.lit("switch_type"), told_type, method, 0.65)),
        (mount.isNotNull(), _text_spec(F.lit("mount_type"), mount, method, 0.7)), (at("grade").isNotNull(), _text_spec(F.lit("erf_grade"), F.substring(at("grade"), 1, 100), method, 0.9)),
        (variant.isNotNull(), _text_spec(F.lit("space"), F.lit("qualified"), "catalog", 0.9)), (variant.isNotNull(), _text_spec(F.lit("space_variant"), variant, "catalog", 0.9)),
    ]
    extra = F.filter(F.array(*(F.when(when, s) for when, s in more)), lambda s: s.isNotNull())
    sub = F.when(category == "amplifier", Z.ruled(at("type"), Z.AMPLIFIERS)).when(category == "filter", Z.ruled(F.concat_ws(" ", F.col("node"), at("type"), at("sub-category"), F.col("description"), F.col("title")), Z.FILTERS)).when(category == "switch", F.coalesce(stated_type, told_type))
    return boxes.select("mpn", F.coalesce(F.nullif("vendor", F.lit("")), F.lit("everythingrf")).alias("vendor"), category.alias("category"), F.coalesce(sub, F.lit("")).alias("subcategory"), F.col("url").alias("product_url"), F.lit("").alias("datasheet_url"), "description", F.col("path").alias("source"), F.concat(said, extra).alias("specs"), variant.alias("variant"), "path", "ix")


def best_in_run(records: DataFrame) -> DataFrame:
    """Of rows of one part and vendor in a run: a qualified one isn't taken back by a graded one; of equal ones the last."""
    at = Window.partitionBy(F.regexp_replace(F.upper("mpn"), r"\s+", ""), F.lower("vendor")).orderBy((F.col("variant") == "space_qualified").desc_nulls_last(), F.desc("path"), F.desc("ix"))
    return records.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def embedded(pages: DataFrame, vendor: str, base: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON in `data-part` attributes, and how many of each page couldn't be read. Control signs in texts are tolerated.

    pages(path, html). The first value of a key counts; several applications are joined.
    """
    shape = "partNumber string, partUrl string, datasheetHref string, specs array<struct<specName:string,value:string,uom:string>>, attributes array<struct<attributeName:string,value:string>>"
    raw = pages.select("path", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)data-part\s*=\s*"(\{.*?\})"'), F.lit(1))).alias("ix", "raw"))
    plain = F.col("raw")
    for code, sign in (("&quot;", '"'), ("&#034;", '"'), ("&#34;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    read = raw.withColumn("d", F.from_json(F.regexp_replace(plain, r"[\x00-\x1F]", " "), shape, {"mode": "PERMISSIVE"}))
    lost = read.groupBy("path").agg(F.count_if(F.col("d.partNumber").isNull()).alias("dropped"))
    mpn = F.trim("d.partNumber")
    good = read.where(L.part_number_shaped(mpn) & L.orderable(mpn))
    family = lambda s: Z.ruled(s["specName"], Z.EMBEDDED, 2)

    def entries(s: Column) -> Column:
        return P.let(F.struct(Z.ruled(s["specName"], Z.EMBEDDED).alias("key"), family(s).alias("family"), s["value"].alias("value"), s["uom"].alias("uom")), entry)

    def entry(x: Column) -> Column:
        out = Z.scaled(x["value"], x["uom"], x["family"])
        text = F.trim(F.coalesce(x["value"], F.lit("")))
        number = lambda k: _number_spec(k, out["value"], out["unit"], "catalog", 0.8)
        none = F.array().cast(f"array<{SPEC}>")
        return F.when(x["key"].isNull(), none).when(x["family"] == "text", F.when(text != "", F.array(_text_spec(x["key"], F.substring(text, 1, 60), "catalog", 0.8))).otherwise(none)).when(out["value"].isNull(), none).when(x["key"] == "freq_range", F.array(number(F.lit("freq_min")), number(F.lit("freq_max")))).otherwise(F.array(number(x["key"])))

    spec_rows = F.flatten(F.transform(F.coalesce("d.specs", F.array().cast("array<struct<specName:string,value:string,uom:string>>")), entries))
    names = F.create_map(*(F.lit(x) for pair in Z.ATTRIBUTES.items() for x in pair))
    told = F.filter(F.transform(F.coalesce("d.attributes", F.array().cast("array<struct<attributeName:string,value:string>>")), lambda a: F.struct(F.try_element_at(names, F.lower(F.trim(a["attributeName"]))).alias("key"), a["value"].alias("value"))), lambda a: a["key"].isNotNull() & a["value"].isNotNull() & ~a["value"].isin("", "null"))
    keys = F.array_distinct(F.transform(F.filter(told, lambda a: a["key"] != "description"), lambda a: a["key"]))
    texts = F.transform(keys, lambda k: _text_spec(k, F.substring(F.array_join(F.transform(F.filter(told, lambda a: a["key"] == k), lambda a: a["value"]), ", "), 1, 120), "catalog", 0.8))
    good = good.withColumn("every", F.concat(spec_rows, texts)).withColumn("description", F.substring(F.coalesce(F.get(F.filter(told, lambda a: a["key"] == "description"), F.lit(0))["value"], F.lit("")), 1, 200))
    order = F.transform("every", lambda s: s["key"])
    good = good.withColumn("specs", F.filter("every", lambda s, i: F.array_position(order, s["key"]) == i + 1))
    form = F.get(F.filter("specs", lambda s: s["key"] == "form_factor"), F.lit(0))["value_text"]
    place = F.concat_ws(" ", "description", form, "path")
    full = lambda x: F.when((F.coalesce(x, F.lit("")) == "") | F.startswith(x, F.lit("http")), F.coalesce(x, F.lit(""))).otherwise(F.concat(F.lit(base), x))
    out = good.select(mpn.alias("mpn"), F.lit(vendor).alias("vendor"), Z.ruled(place, Z.PATHS, 1, "ic").alias("category"), F.coalesce(Z.ruled(place, Z.PATHS, 2), F.lit("")).alias("subcategory"), full(F.col("d.partUrl")).alias("product_url"), full(F.trim("d.datasheetHref")).alias("datasheet_url"), "description", F.col("path").alias("source"), "specs", "path", "ix")
    last = Window.partitionBy(F.upper("mpn")).orderBy(F.desc("path"), F.desc("ix"))
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n"), lost


def table_records(cells: DataFrame, sections: DataFrame, vendor: str, base: str) -> DataFrame:
    """Records of parametric tables: cells(path, table_ix, row_ix, col_ix, text, raw) with row 0 as headings, sections(path, table_ix, section).

    A row's part number is in its links; a part's first row counts, later ones fill what is missing.
    """
    heads = cells.where("row_ix = 0").select("path", "table_ix", "col_ix", F.col("text").alias("header")).withColumn("key", Z.ruled(F.col("header"), Z.HEADINGS)).withColumn("unit", F.coalesce(Z.unit_of(F.col("header")), F.lit("")))
    body = cells.where("row_ix > 0")
    links = body.groupBy("path", "table_ix", "row_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_ix", "raw"))), lambda x: x["raw"]), " ").alias("raw"), F.max(F.when(F.col("col_ix") == 1, F.col("text"))).alias("description"))
    links = links.withColumn("mpn", F.trim(F.try_url_decode(F.regexp_extract("raw", r"(?i)/products/p/([^\"'?#/]+)", 1)))).withColumn("sheet", F.regexp_extract("raw", r"(?i)/products/d/([^\"'?#/]+)", 1))
    links = links.where(L.part_number_shaped(F.col("mpn")) & L.orderable(F.col("mpn")))
    entries = body.join(heads, ["path", "table_ix", "col_ix"]).where("key IS NOT NULL").select("path", "table_ix", "row_ix", "col_ix", F.posexplode(Z.absorbed(F.col("key"), F.col("text"), F.col("unit"))).alias("k", "e"))
    rows = links.join(sections, ["path", "table_ix"], "left").withColumn("part", F.upper("mpn"))
    seen = rows.join(entries, ["path", "table_ix", "row_ix"], "left")
    place = F.struct("path", "table_ix", "row_ix")
    spec = F.when(F.col("e.text").isNotNull(), _text_spec(F.col("e.key"), F.col("e.text"), "catalog", 0.8)).when(F.col("e.value").isNotNull(), _number_spec(F.col("e.key"), F.col("e.value"), F.coalesce("e.unit", F.lit("")), "catalog", 0.8))
    # of one part's cells the last one of a key
    last = seen.where(F.col("e.key").isNotNull()).groupBy("part", F.col("e.key").alias("key")).agg(F.max_by(spec, F.struct("path", "table_ix", "row_ix", "col_ix", "k")).alias("s"))
    specs = last.groupBy("part").agg(F.array_sort(F.collect_list("s")).alias("specs"))
    keep = lambda c: F.min_by(c, place)
    first = rows.groupBy("part").agg(keep("mpn").alias("mpn"), keep("section").alias("section"), keep("path").alias("source"), F.min_by(F.nullif("description", F.lit("")), F.when(F.coalesce("description", F.lit("")) != "", place)).alias("description"), F.min_by("sheet", F.when(F.col("sheet") != "", place)).alias("sheet"))
    out = first.join(specs, "part", "left")
    return out.select("mpn", F.lit(vendor).alias("vendor"), Z.ruled(F.col("section"), Z.SECTIONS, 1, "ic").alias("category"), F.coalesce(Z.ruled(F.col("section"), Z.SECTIONS, 2), F.lit("")).alias("subcategory"), F.concat(F.lit(f"{base}/products/p/"), F.col("mpn")).alias("product_url"), F.coalesce(F.concat(F.lit(f"{base}/products/d/"), F.col("sheet")), F.lit("")).alias("datasheet_url"), F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description"), "source", F.coalesce("specs", F.array().cast(f"array<{SPEC}>")).alias("specs"))


def pipe_specs(texts: DataFrame) -> DataFrame:
    """texts(mpn, text) of pipe tables -> mpn, key, value, unit: parameters by the table's headings, the first value of a key.

    Limits of destruction are kept under names of their own; performance isn't read from operating conditions.
    """
    lines = texts.select("mpn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    lines = lines.withColumn("cells", F.when(F.contains("line", F.lit("|")), cells))
    heading = F.startswith(F.lower(F.get("cells", F.lit(0))), F.lit("parameter"))
    # a line without cells ends a table
    opens = F.when(F.col("cells").isNull(), F.struct(F.col("at"), F.lit(None).cast("array<string>").alias("head"))).when(heading, F.struct(F.col("at"), F.transform("cells", F.lower).alias("head")))
    upto = Window.partitionBy("mpn").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("open", F.last(opens, ignorenulls=True).over(upto)).where(~F.coalesce(heading, F.lit(True))).withColumn("head", F.col("open.head")).where("head IS NOT NULL")
    find = lambda *words: F.array_position(F.transform("head", lambda h: F.exists(F.array(*map(F.lit, words)), lambda w: (h == w) | F.endswith(w, F.lit("…")) & F.contains(h, F.replace(w, F.lit("…"), F.lit(""))))), True) - 1
    joined = F.array_join("head", " ")
    kind = F.when(F.contains(joined, F.lit("maximum rating")), "absmax").when(F.contains(joined, F.lit("nominal")), "operating").otherwise("electrical")
    at = lambda *words: F.when(find(*words) >= 0, F.get("cells", find(*words).cast("int")))
    key = Z.ruled(F.get("cells", F.lit(0)), Z.PARAMETERS)
    renamed = F.create_map(*(F.lit(x) for pair in Z.DESTROYS.items() for x in pair))
    rows = rows.withColumn("kind", kind).withColumn("key", F.when(kind == "absmax", F.try_element_at(renamed, key)).when((kind == "operating") & key.isin(Z.PERFORMANCE), None).otherwise(key))
    value = F.coalesce(Z.number_of(at("typ", "typical", "maximum rating…")), Z.number_of(at("nominal…")), Z.number_of(at("min", "minimum")), Z.number_of(at("max", "maximum")))
    low, high = Z.number_of(at("minimum frequency…")), Z.number_of(at("maximum frequency…"))
    entry = lambda k, v, u: F.struct(k.alias("key"), v.alias("value"), u.alias("unit"))
    unit = F.coalesce(F.substring(at("unit", "units"), 1, 8), F.lit(""))
    found = F.filter(F.array(F.when(F.col("key").isNotNull() & value.isNotNull(), entry(F.col("key"), value, unit)), F.when(high > 0, entry(F.lit("freq_min"), F.least(low, high), F.lit("GHz"))), F.when((high > 0) & low.isNotNull(), entry(F.lit("freq_max"), F.greatest(low, high), F.lit("GHz")))), lambda e: e.isNotNull() & e["value"].isNotNull())
    rows = rows.select("mpn", "at", F.posexplode(found).alias("k", "e"))
    return rows.groupBy("mpn", "e.key").agg(F.min_by(F.struct("e.value", "e.unit"), F.struct("at", "k")).alias("v")).select("mpn", "key", "v.value", "v.unit")


def order_options(texts: DataFrame) -> DataFrame:
    """texts(mpn, text) -> mpn, variant (loose part number), package: from tables with a part number and a package column; evaluation boards are left out."""
    lines = texts.select("mpn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("cells", F.when(F.contains("line", F.lit("|")), F.transform(F.split("line", r"\|"), lambda c: F.trim(c))))
    position = lambda word: F.array_position(F.transform("cells", lambda c: F.startswith(F.lower(c), F.lit(word))), True) - 1
    heading = (position("part number") >= 0) & (position("package") > position("part number"))
    lines = lines.withColumn("opens", F.when(heading, F.struct(position("part number").alias("pn"), position("package").alias("pk"))))
    ends = F.col("cells").isNull() & ((F.trim("line") == "") | F.startswith(F.trim("line"), F.lit("Rev:")) | F.startswith(F.trim("line"), F.lit("www.")))
    upto = Window.partitionBy("mpn").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(ends, F.struct(F.lit(-1).cast("long").alias("pn"), F.lit(-1).cast("long").alias("pk"))).when(F.col("opens").isNotNull(), F.col("opens").cast("struct<pn:bigint,pk:bigint>"))
    rows = lines.withColumn("open", F.last(state, ignorenulls=True).over(upto)).where("opens IS NULL AND cells IS NOT NULL AND open.pn >= 0")
    pn, package = F.get("cells", F.col("open.pn").cast("int")), F.get("cells", F.col("open.pk").cast("int"))
    rows = rows.select("mpn", "at", F.regexp_replace(F.upper(pn), "[^A-Z0-9]", "").alias("variant"), F.substring(package, 1, 40).alias("package")).where("variant <> '' AND package NOT IN ('', '-') AND NOT startswith(variant, 'EVB')")
    return rows.groupBy("mpn", "variant").agg(F.max_by("package", "at").alias("package"))


def stored(records: DataFrame, signal: str, weight: float, confidence: float, claims: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parts, specs and evidence of records. Edges become one band; one edge alone is a point. Sources that make no claims write no space keys."""
    norm = F.regexp_replace(F.upper("mpn"), r"\s+", "")
    keyed = records.withColumn("part_id", F.xxhash64(norm, "vendor"))
    parts = keyed.select("part_id", "mpn", norm.alias("mpn_norm"), "vendor", "category", "subcategory", "product_url", F.substring("description", 1, 200).alias("description"))
    edge = lambda k: F.get(F.filter("specs", lambda s: s["key"] == k), F.lit(0))["value_typ"]
    lo, hi = F.coalesce(edge("freq_min"), edge("freq_max")), F.coalesce(edge("freq_max"), edge("freq_min"))
    none = F.lit(None).cast("double")
    band = F.struct(F.lit("freq_ghz"), F.least(lo, hi), none, F.greatest(lo, hi), F.lit(None).cast("string"), F.lit("GHz"), F.lit("catalog"), F.lit(confidence), F.lit("")).cast(SPEC)
    sheet = _text_spec(F.lit("datasheet_url"), F.substring("datasheet_url", 1, 200), "catalog", 0.9)
    extra = F.filter(F.array(F.when(lo.isNotNull(), band), F.when(F.col("datasheet_url") != "", sheet)), lambda s: s.isNotNull())
    rows = F.filter(F.concat("specs", extra), lambda s: ~s["key"].isin("freq_min", "freq_max", *([] if claims else NO_CLAIMS)))
    specs = keyed.select("part_id", F.col("product_url").alias("source_url"), F.explode(rows).alias("s")).select("part_id", "s.*", "source_url")
    specs = specs.withColumn("value_text", F.substring("value_text", 1, 200))
    evidence = keyed.select("part_id", F.lit(signal).alias("signal"), F.lit(weight).alias("weight"), F.col("product_url").alias("source_url"), F.substring("source", 1, 120).alias("snippet"))
    return parts, specs, evidence


def listing_evidence(records: DataFrame) -> DataFrame:
    """What a listing says of space: 9 for qualified, 7 for graded parts."""
    qualified = F.col("variant") == "space_qualified"
    norm = F.regexp_replace(F.upper("mpn"), r"\s+", "")
    return records.where("variant IS NOT NULL").select(F.xxhash64(norm, "vendor").alias("part_id"), F.when(qualified, "erf-space-qualified-listing").otherwise("erf-space-grade-listing").alias("signal"), F.when(qualified, 9.0).otherwise(7.0).alias("weight"), F.col("product_url").alias("source_url"), F.col("source").alias("snippet"))


def flat(records: DataFrame) -> DataFrame:
    """mpn, key, value, text: one row a key for a live table; a band as its two edges."""
    rows = records.select("mpn", F.explode("specs").alias("s")).select("mpn", "s.*")
    point = F.when(F.col("value_min").isNull() & F.col("value_max").isNull(), F.col("value_typ"))
    pairs = F.when(F.col("key") == "freq_ghz", F.array(F.struct(F.lit("freq_min").alias("key"), F.coalesce("value_min", point).alias("value"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("freq_max").alias("key"), F.coalesce("value_max", point).alias("value"), F.lit(None).cast("string").alias("text")))).otherwise(F.array(F.struct("key", F.coalesce("value_typ", "value_max", "value_min").alias("value"), F.col("value_text").alias("text"))))
    return rows.select("mpn", F.explode(pairs).alias("p")).select("mpn", "p.key", "p.value", F.when(F.col("p.value").isNull(), F.col("p.text")).alias("text")).where("value IS NOT NULL OR coalesce(text, '') <> ''")


def datasheet_lines(html: DataFrame) -> DataFrame:
    """pages(path, html) -> path, text: cells parted by pipes, blocks by lines, from the overview to the footer, long repeated lines once."""

    def lines(page: str) -> str:
        s = re.sub(r"(?is)<(script|style|noscript|svg|head)\b.*?</\1>", " ", page or "")
        s = re.sub(r"(?i)</t[dh]\s*>", " | ", s)
        s = re.sub(r"(?i)</(?:p|div|li|tr|h[1-6]|table|section)\s*>|<br\s*/?>", "\n", s)
        s = entities.unescape(re.sub(r"<[^>]+>", " ", s))
        own = [x for x in (re.sub(r"[ \t\xa0]+", " ", ln).strip(" |") for ln in s.split("\n")) if x]
        first = next((i for i, x in enumerate(own) if "device overview" in x.lower() or "general description" in x.lower()), 0)
        last = next((i for i in range(first + 1, len(own)) if "stay informed" in own[i].lower() or "be the first to know" in own[i].lower()), len(own))
        seen, out = set(), []
        for x in own[first:last] or own:
            if len(x) > 12 and x.lower() in seen:
                continue
            seen.add(x.lower())
            out.append(x)
        return "\n".join(out)

    return html.select("path", F.pandas_udf(lambda pages: pages.map(lines), "string")("html").alias("text"))
