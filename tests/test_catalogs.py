"""Catalogue readers on small files made here."""

import zipfile

import pytest

from partlens.sources import catalogs as C
from partlens.sources import readers

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets):
    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r + 1}"
        v = str(v).replace("&", "&amp;").replace("<", "&lt;")
        return f'<c r="{ref}"><f>{v[1:]}</f></c>' if v.startswith("=") else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


def specs_of(row):
    return {s.key: s.value_text if s.value_text is not None else s.value_typ if s.value_typ is not None else (s.value_min, s.value_max) for s in row.specs}


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "mixers.xlsx", {
        "Cover": [["Product Type", "RF Amplifiers"]],
        "Web Display": [["Part", "Frequency Response RF Min (MHz)", "Frequency Response RF Max", "Conversion Gain", "RF Amp Type", "Package", "Operating Temperature", "Description"], ["", "MHz", "GHz", "dB", "text", "", "", ""],
                        ['=HYPERLINK("http://x/hmc1", "HMC1")', "450", "6 GHz", "-10", "Low Noise Amplifier", "QFN", "-40 to +85", "1 GHz to 3 GHz, 15 W part"], ["HMC2", "None", "None", "None", "None", "-", "None", "up to 20 GHz, 2 dB noise figure"], ["X", "1"]],
    })
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    rows = {r.mpn: r for r in C.workbook_records(C.workbook_cells(spark, str(tmp_path)), "ADI").collect()}
    assert set(rows) == {"HMC1", "HMC2"}
    one, two = rows["HMC1"], rows["HMC2"]
    assert (one.product_url, one.category, one.subcategory) == ("http://x/hmc1", "amplifier", "lna")
    assert specs_of(one) == {"freq_min": 0.45, "freq_max": 6.0, "conversion_gain_db": -10.0, "conversion_loss_db": 10.0, "package": "QFN", "temp_min_c": -40.0, "temp_max_c": 85.0, "psat_dbm": 41.8, "device_type": "Low Noise Amplifier"}
    assert specs_of(two) == {"freq_min": 0.0, "freq_max": 20.0, "nf_db": 2.0} and two.category == "amplifier"
    parts, specs, evidence = C.stored(C.workbook_records(C.workbook_cells(spark, str(tmp_path)), "ADI"), "parametric", 3.0, 0.9, claims=False)
    band = specs.where("key = 'freq_ghz'").join(parts, "part_id").orderBy("mpn").collect()
    assert [(r.mpn, r.value_min, r.value_max) for r in band] == [("HMC1", 0.45, 6.0), ("HMC2", 0.0, 20.0)]
    assert specs.where("key IN ('freq_min', 'space')").count() == 0 and evidence.count() == 2


LISTING = """<html><body><h1>Space Grade Parts</h1>
<div class="product-box"><h3 class="prod-title"><a href="../../products/rf-switches/1/x" dname="SW-1 (New)">Acme - SW-1</a></h3><a class="link manuName" manu-name="Acme">A</a><span class="nodeName">Space Qualified RF Switch</span>
<div class="data-row"><div class="attribute">Frequency :</div><div class="value">DC to 7 GHz</div></div><div class="data-row"><div class="attribute">Configuration</div><div class="value">SP4T, Surface Mount</div></div>
<div class="data-row"><div class="attribute">Switching Speed (us)</div><div class="value">2</div></div><div class="data-row"><div class="attribute">Output Power</div><div class="value">35 dBm</div></div><div class="data-row"><div class="attribute">Termination</div><div class="value">Absorptive</div></div></div>
<div class="product-box"><h3 class="prod-title"><a href="https://h/products/rf-power-dividers/2?utm_source=z" dname="PD-2">Best - PD-2</a></h3><a class="manuName">Best</a><div class="descriptiontext">A 4-way divider</div>
<div class="data-row"><div class="attribute">Center Frequency</div><div class="value">10 GHz</div></div><div class="data-row"><div class="attribute">Bandwidth</div><div class="value">10 %</div></div><div class="data-row"><div class="attribute">Average Power</div><div class="value">10 W</div></div></div>
<div class="product-box"><p>nothing</p></div></body></html>"""


def test_listing(spark, tmp_path):
    (tmp_path / "Space").mkdir()
    (tmp_path / "Space" / "a.html").write_text(LISTING)
    boxes = C.listing_boxes(readers.pages(spark, str(tmp_path)))
    records = C.listing_records(boxes, "https://base.org")
    rows = {r.mpn: r for r in records.collect()}
    one, two = rows["SW-1"], rows["PD-2"]
    assert (one.vendor, one.category, one.subcategory, one.product_url, one.variant) == ("Acme", "switch", "absorptive", "https://base.org/products/rf-switches/1/x", "space_qualified")
    assert specs_of(one) == {"freq_ghz": (0.0, 7.0), "configuration": "SP4T, Surface Mount", "switching_time_ns": 2000.0, "psat_dbm": 35.0, "switch_type": "absorptive", "throw_config": "SP4T", "mount_type": "smt", "space": "qualified", "space_variant": "space_qualified"}
    assert (two.category, two.product_url, two.variant, two.vendor) == ("divider", "https://h/products/rf-power-dividers/2", "space_grade", "Best")
    told = specs_of(two)
    assert told["freq_ghz"] == (9.5, 10.5) and told["bandwidth_ghz"] == 1.0 and told["no_of_ways"] == 4.0 and told["power_avg_w"] == 10.0 and told["power_avg_dbm"] == 40.0
    assert C.best_in_run(records.union(records)).count() == 2
    assert sorted((r.signal, r.weight) for r in C.listing_evidence(records).collect()) == [("erf-space-grade-listing", 7.0), ("erf-space-qualified-listing", 9.0)]
    assert {(r.key, r.value) for r in C.flat(records.where("mpn = 'PD-2'")).collect()} >= {("freq_min", 9.5), ("freq_max", 10.5), ("no_of_ways", 4.0)}


def test_embedded_records(spark):
    page = """<tr data-part="{&quot;partNumber&quot;: &quot;CG-55&quot;, &quot;partUrl&quot;: &quot;/p/cg&quot;, &quot;specs&quot;: [{&quot;specName&quot;: &quot;Min Frequency&quot;, &quot;uom&quot;: &quot;MHz&quot;, &quot;value&quot;: 500}, {&quot;specName&quot;: &quot;Output Power&quot;, &quot;uom&quot;: &quot;W&quot;, &quot;value&quot;: 10}, {&quot;specName&quot;: &quot;Switching Time&quot;, &quot;uom&quot;: &quot;weeks&quot;, &quot;value&quot;: 1}],
 &quot;attributes&quot;: [{&quot;attributeName&quot;: &quot;Application&quot;, &quot;value&quot;: &quot;Radar&quot;}, {&quot;attributeName&quot;: &quot;Application&quot;, &quot;value&quot;: &quot;Space\x0b&quot;}, {&quot;attributeName&quot;: &quot;Short Description&quot;, &quot;value&quot;: &quot;GaN amplifier&quot;}]}">x</tr><tr data-part="{broken}">y</tr><tr data-part="{&quot;partNumber&quot;: &quot;EVB-1&quot;}">z</tr>"""
    records, lost = C.embedded(spark.createDataFrame([("list.html", page)], "path string, html string"), "MACOM", "https://m.com")
    (row,) = records.collect()
    assert (row.mpn, row.product_url, row.category, row.description, row.datasheet_url) == ("CG-55", "https://m.com/p/cg", "amplifier", "GaN amplifier", "")
    assert specs_of(row) == {"freq_min": 0.5, "psat_dbm": 40.0, "industry_application": "Radar, Space "} or specs_of(row) == {"freq_min": 0.5, "psat_dbm": 40.0, "industry_application": "Radar, Space"}
    assert lost.first().dropped == 1


def test_tables(spark):
    raw = lambda pn, d="": f"<a href='/products/p/{pn}'>{pn}</a>" + (f"<a href='/products/d/{d}'>s</a>" if d else "")
    cells = [("p", 0, 0, i, t, t) for i, t in enumerate(["Part", "Description", "Frequency Min MHz", "Freq Max (MHz)", "Conversion Gain (dB)", "NF (dB)"])]
    cells += [("p", 0, 1, i, t, raw("QPA-1", "9") if i == 0 else t) for i, t in enumerate(["QPA-1", "LNA", "500", "2000", "-7", "TBD"])]
    cells += [("p", 0, 2, i, t, raw("QPA-EVB-eval") if i == 0 else t) for i, t in enumerate(["e", "board", "1", "2", "3", "4"])]
    cells += [("q", 0, 0, 0, "Part", ""), ("q", 0, 0, 1, "NF", ""), ("q", 0, 1, 0, "QPA-1", raw("qpa-1")), ("q", 0, 1, 1, "1.5", "1.5")]
    table = spark.createDataFrame(cells, "path string, table_ix int, row_ix int, col_ix int, text string, raw string")
    sections = spark.createDataFrame([("p", 0, "Low Noise Amplifiers"), ("q", 0, "Mixers")], "path string, table_ix int, section string")
    (row,) = C.table_records(table, sections, "Qorvo", "https://q.com").collect()
    assert (row.mpn, row.category, row.subcategory, row.datasheet_url, row.description) == ("QPA-1", "amplifier", "lna", "https://q.com/products/d/9", "LNA")
    assert specs_of(row) == {"freq_min": 0.5, "freq_max": 2.0, "conversion_gain_db": -7.0, "conversion_loss_db": 7.0, "nf_db": 1.5}


SHEET = """Device Overview
Parameter | Test Conditions | Minimum Frequency (GHz) | Maximum Frequency (GHz) | Min | Typ | Max | Unit
Small Signal Gain | 3V | 2 | 20 | - | 15.1 | - | dB
Noise Figure | 3V | 2 | 20 | 1 | - | 3 | dB
Gain | again | 2 | 20 | - | 99 | - | dB

Parameter | Maximum Rating | Unit
Current Consumption | 110 | mA
Gain | 7 | dB

Parameter | Min | Nominal | Max | Unit
Supply Current | | 54 | | mA
Small Signal Gain | | 3 | | dB
Part Number | Description | Package | Green
ADM-8344PSM | amp | PSM | RoHS
ADM-8344PC | amp | - | RoHS
EVB-ADM | board | Box | no
"""


def test_sectioned_tables(spark):
    texts = spark.createDataFrame([("ADM", SHEET)], "mpn string, text string")
    got = {r.key: (r.value, r.unit) for r in C.pipe_specs(texts).collect()}
    assert got == {"gain_db": (15.1, "dB"), "nf_db": (1.0, "dB"), "freq_min": (2.0, "GHz"), "freq_max": (20.0, "GHz"), "absmax_current_ma": (110.0, "mA"), "current_ma": (54.0, "mA")}
    assert [(r.variant, r.package) for r in C.order_options(texts).collect()] == [("ADM8344PSM", "PSM")]


@pytest.mark.parametrize(("page", "text"), [("<p>menu</p><h2>Device Overview</h2><table><tr><td>A</td><td>1 &amp; 2</td></tr></table><p>A long repeated line</p><p>A long repeated line</p><p>ok</p><p>ok</p><p>Stay informed now</p>", "Device Overview\nA | 1 & 2\nA long repeated line\nok\nok"), ("", "")])
def test_datasheet_lines(spark, page, text):
    assert C.datasheet_lines(spark.createDataFrame([("p", page)], "path string, html string")).first().text == text
