"""Uploaded files under their own headers, workbooks, and pages that are no data."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from shoplens.functions import exprs
from shoplens.plans.queries_intake import workbook
from shoplens.sources import feeds, uploads
from shoplens.sources import upload_files as UF


def _rows(records, kind="row"):
    return [(r["line"], dict(r["cells"])) for r in records.where(f"kind = '{kind}'").orderBy("path", "line").collect()]


def _frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content binary")


def test_each_file_by_its_own_header(spark, tmp_dir):
    texts = {"a.csv": ("日期,销售额\n2026-07-01,1\n", "gbk"), "b.csv": ("GMV,date,note\n2,2026-07-02,x\n", "utf-8-sig"), "sub/c.csv": ("revenue\n3\n", "utf-8")}
    for name, (text, encoding) in texts.items():
        path = os.path.join(tmp_dir, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding=encoding, newline="") as f:
            f.write(text)
    records = UF.upload_records(UF.files(spark, tmp_dir))
    std = UF.standard_rows(records, ["gmv", "date"])
    assert sorted((r["gmv"], r["date"]) for r in std.collect()) == [("1", "2026-07-01"), ("2", "2026-07-02"), ("3", None)]
    assert {os.path.basename(r["path"]): r["encoding"] for r in records.where("kind = 'header'").collect()} == {
        "a.csv": "gbk", "b.csv": "utf-8-sig", "c.csv": "utf-8"}
    table = uploads.load_upload(spark, tmp_dir)
    assert table.columns == ["日期", "销售额", "GMV", "date", "note", "revenue"] and table.count() == 3


def test_quotes_breaks_blank_short_and_surplus_cells(spark):
    text = 'a, b ,a\r\n"1,5","x\ny",2\r\n\r\nonly\n1,2,3,4\n1,2,3,\n"he said ""no""",,\n'
    records = UF.upload_records(_frame(spark, {"f.csv": text.encode()})).cache()
    head = records.where("kind = 'header'").first()
    assert head["names"] == ["a", "b", "a.1"] and head["line"] == 1
    assert _rows(records) == [(3, {"a": "1,5", "b": "x\ny", "a.1": "2"}), (5, {"a": "only", "b": None, "a.1": None}),
                              (7, {"a": "1", "b": "2", "a.1": "3"}), (8, {"a": 'he said "no"', "b": None, "a.1": None})]
    extra = records.where("kind = 'extra'").first()
    assert (extra["line"], extra["surplus"], dict(extra["cells"])["a.1"]) == (6, ["4"], "3")


def test_rejected_files_are_records(spark):
    files = {"a.exe": b"MZ", "b.csv": b"", "c.csv": b"\xff\xff\x80", "d.xlsx": b"PK no", "e.csv": b"\n\n", "f": b"x", "g.csv": b"a\n" + b"1\n" * 100,
             "h.csv": None, "i.csv": b"a\n1\n"}
    records = UF.upload_records(_frame(spark, files), max_bytes=50)
    got = {r["path"]: r["reason"] for r in records.where("kind = 'rejected'").collect()}
    assert got == {"a.exe": "unsupported_format", "b.csv": "empty_file", "c.csv": "unknown_encoding", "d.xlsx": "broken_workbook", "e.csv": "empty_file",
                   "f": "unsupported_format", "g.csv": "too_large", "h.csv": "empty_file"}
    counts = {(r["kind"], r["reason"]): (r["records"], r["files"]) for r in UF.counts(records).collect()}
    assert counts[("row", None)] == (1, 1) and counts[("rejected", "empty_file")] == (3, 3)
    assert UF.upload_records(_frame(spark, {"g.csv": files["g.csv"]}), max_bytes=None).where("kind = 'row'").count() == 100
    assert UF.upload_records(_frame(spark, files).limit(0)).count() == 0


def test_load_upload_names_what_it_cannot_read(spark, tmp_dir):
    for name, data, message in (("x.csv", b"\xff\xff\x80", "encoding"), ("y.csv", b"a\n1,2\n", "line 2"), ("z.xls", b"\xd0\xcf", "unsupported")):
        path = os.path.join(tmp_dir, name)
        with open(path, "wb") as f:
            f.write(data)
        with pytest.raises(ValueError, match=message):
            uploads.load_upload(spark, path)


def test_workbooks(spark, tmp_dir):
    cells = [["日期", "销售额", "备注"], [45000, 12, "a&b"], [45000.5, 0.25, None], [None, None, None], ["日期", "销售额", "备注"], [45001.123456, 1e20, " x "]]
    with open(os.path.join(tmp_dir, "b.xlsx"), "wb") as f:
        f.write(workbook(cells, {0}))
    t = uploads.load_upload(spark, os.path.join(tmp_dir, "b.xlsx"))
    assert [tuple(r) for r in t.collect()] == [
        ("2023-03-15 00:00:00", "12", "a&b"), ("2023-03-15 12:00:00", "0.25", None), ("日期", "销售额", "备注"), ("2023-03-16 02:57:46.598", "1e+20", " x ")]


def test_workbook_details():
    """Gaps, rich text, inline text, booleans, errors, the 1904 calendar, own date formats."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><workbookPr date1904="1"/><sheets><sheet name="s" r:id="r9"/><sheet name="t" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/b.xml"/><Relationship Id="r9" Target="/xl/worksheets/a.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.00&quot;day&quot;"/></numFmts>'
                         '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {main}><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/worksheets/a.xml": f'<worksheet {main}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c><c r="AB2" t="str"><v>f</v></c></row>'
                               '<row r="7"><c r="A7" t="b"><v>1</v></c><c r="B7" s="1"><v>1</v></c><c r="C7" t="e"><v>#N/A</v></c><c r="D7" s="2"><v>3.0</v></c></row></sheetData></worksheet>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    (one, head), (two, row) = UF.workbook_rows(out.getvalue())
    assert (one, two) == (2, 7) and row == ["True", "1904-01-02 00:00:00", None, "3"]
    assert head[0] == "rich" and head[1] is None and head[2] == "in" and head[27] == "f" and len(head) == 28
    assert UF.header_names(head)[1] == "Unnamed: 1"


PAGES = ['{"orders": [{"id": "1"}, {"id": "2"}], "total": 2}', '{"data": {"orders": [{"id": 3}]}}', "<!DOCTYPE html><p>", "  <html>", '{"orders": [{"id": "4"}', "not json",
         '{"code": 1}', '{"data": null}', '{"orders": []}', "", "  ", None, '{"orders": [null, {"id": "5"}]}']


def test_pages_told_apart(spark):
    text = spark.createDataFrame([(p,) for p in PAGES], "body string")
    got = {r["page"]: (r["pages"], r["records"]) for r in feeds.page_counts(text, "platform_a_orders").collect()}
    assert got == {"data": (4, 5), "html": (2, 0), "unparsable": (2, 0), "no_list": (2, 0), "empty": (3, 0)}
    assert sorted(r["id"] for r in feeds.parse_pages(text, "platform_a_orders").collect()) == ["1", "2", "3", "5"]
    split = feeds.split_pages(text, "platform_a_orders")
    assert sorted(r["body"] or "" for r in feeds.quarantined(split).collect()) == sorted((p or "") for p in PAGES if p not in (PAGES[0], PAGES[1], PAGES[8], PAGES[12]))
    assert feeds.page_counts(text.limit(0), "platform_a_orders").count() == 0


def test_each_page_is_parsed_once(spark):
    text = spark.createDataFrame([(p,) for p in PAGES], "body string")
    records = feeds.parse_pages(text, "platform_a_orders")
    assert records._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_html_is_told_by_the_start_of_a_body(spark):
    bodies = {"<html": True, "\r\n\t <HeAd>": True, "<BODY a='1'> ": True, "<!doctype": True, "": False, None: False, "x <html>": False,
              "{}\n<html>": False, "<htm": False, " <html>": False}
    rows = spark.createDataFrame(list(bodies.items()), "body string, html boolean")
    assert rows.where(exprs.is_html("body") != F.col("html")).count() == 0
