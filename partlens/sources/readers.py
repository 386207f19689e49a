"""Files on disk as DataFrames: measurement CSVs, JSON catalogues, HTML pages, Touchstone files, datasheet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names of the two measurement layouts, in the order of ours.
STANDARD = {"dut_name": "dut", "Part Number": "part_number", "measurement_name": "test", "data": "data", "units": "units", "upper_limit": "upper", "lower_limit": "lower", "test_report_id": "report"}
LEGACY = {"DUT Name": "dut", "Legacy ID": "part_number", "Test Result Name": "test", "Data": "data", "Units": "units", "Upper Limit": "upper", "Lower Limit": "lower", "Result Stop Date/Time": "ts"}
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "dd-MMM-yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm"]


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """Either layout, told by its columns; blank tests and duts are left out, numbers that aren't are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    layout = STANDARD if "measurement_name" in raw.columns else LEGACY
    missing = [c for c in ("dut", "test", "data") if next(k for k, v in layout.items() if v == c) not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    rows = raw.select(*(F.col(f"`{k}`").alias(v) for k, v in layout.items() if k in raw.columns))
    for c in ("data", "upper", "lower"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.expr(f"try_cast({c} AS double)"))
            rows = rows.withColumn(c, F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)))
    if "ts" in rows.columns:
        rows = rows.withColumn("ts", timestamp(F.col("ts")))
    return rows.where("trim(dut) <> '' AND trim(test) <> ''")


def timestamp(x: Column) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in FORMATS))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """JSON parts, whichever name the part number has; a wrapping object's list is taken."""
    raw = spark.read.json(path, multiLine=True)
    lists = [c for c, t in raw.dtypes if t.startswith("array<struct")]
    if lists and not {"pn", "part_number", "model"} & set(raw.columns):
        raw = raw.select(F.explode(lists[0]).alias("x")).select("x.*")
    names = [F.col(c) for c in ("pn", "part_number", "model") if c in raw.columns]
    return raw.withColumn("pn", F.coalesce(*names)).where("pn IS NOT NULL")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path, html: whole files, folders included."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def html_tables(html: DataFrame, key: str, column: str = "html") -> DataFrame:
    """key, table_ix, row_ix, col_ix, text for tables of at least two rows."""
    cut = lambda c, tag: F.regexp_extract_all(c, F.lit(f"(?is)<(?:{tag})\\b[^>]*>(.*?)</(?:{tag})\\s*>"), F.lit(1))
    tables = html.select(key, F.posexplode(cut(F.col(column), "table")).alias("table_ix", "t"))
    rows = tables.withColumn("rows", cut(F.col("t"), "tr")).where(F.size("rows") >= 2).select(key, "table_ix", F.posexplode("rows").alias("row_ix", "r"))
    cells = rows.select(key, "table_ix", "row_ix", F.posexplode(cut(F.col("r"), "t[dh]")).alias("col_ix", "c"))
    return cells.select(key, "table_ix", "row_ix", "col_ix", F.trim(F.regexp_replace(F.regexp_replace("c", "<[^>]*>", " "), r"\s+", " ")).alias("text"))


def data_parts(html: DataFrame, key: str, attribute: str, schema: str, column: str = "html") -> DataFrame:
    """JSON in an attribute: parsed rows; what can't be parsed has a null part."""
    found = html.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(f"{attribute}='([^']*)'"), F.lit(1))).alias("pos", "raw"))
    return found.withColumn("part", F.from_json(F.regexp_replace("raw", r"[\x00-\x1F]", " "), schema, {"mode": "PERMISSIVE"}))


def file_kind(content: Column, limit: float = 0.02) -> Column:
    """Corrupt, pdf, html, zip or text, by the first 64 kB; bytes of replacement characters above the limit's share are looked for first."""
    head = F.substring(content, 1, 65536)
    # as ISO 8859-1 every byte is one character, so matches keep to bytes
    text = F.decode(head, "ISO-8859-1")
    lost = F.char_length(text) - F.char_length(F.replace(text, F.lit("\u00ef\u00bf\u00bd"), F.lit("")))
    start = F.lower(F.substring(F.ltrim(text), 1, 400))
    page = F.startswith(start, F.lit("<!doctype html")) | F.contains(start, F.lit("<html"))
    return F.when(lost / F.greatest(F.octet_length(head), F.lit(1)) > limit, "corrupt").when(F.startswith(text, F.lit("%PDF-")), "pdf").when(F.startswith(text, F.lit("PK\u0003\u0004")), "zip").when(page, "html").otherwise("text")


def library(spark: SparkSession, path: str) -> DataFrame:
    """Loose part number -> path of the largest file, the first path if equal."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    key = F.regexp_replace(F.upper(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)), "[^A-Z0-9]", "")
    return files.groupBy(key.alias("key")).agg(F.max("length").alias("length"), F.min_by("path", F.struct(-F.col("length"), "path")).alias("path"))


def touchstone(spark: SparkSession, path: str) -> DataFrame:
    """path, f_ghz and the real and imaginary parts of two-port samples."""
    import pandas as pd

    from partlens.functions.network import read_touchstone

    def run(batches):
        for batch in batches:
            rows = [(p, f, *(v for z in s for v in (z.real, z.imag))) for p, text in zip(batch["path"], batch["value"], strict=True) for f, *s in read_touchstone(text)[0]]
            yield pd.DataFrame(rows, columns=["path", "f_ghz", *(f"s{ij}_{part}" for ij in ("11", "21", "12", "22") for part in ("re", "im"))])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, "path string, f_ghz double, s11_re double, s11_im double, s21_re double, s21_im double, s12_re double, s12_im double, s22_re double, s22_im double")
