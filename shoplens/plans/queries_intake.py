"""Registered intake queries: uploads of many files under their own headers,
workbooks, and landed pages that are no data (S1, S2, S4, S9, S11, K5).

Files and pages are made on Spark from the driver tables -- a file or page for
each run of order numbers, so their number grows with the data -- and landed
once per data set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.operators import mappers
from shoplens.plans.catalog import register
from shoplens.plans.oracle import with_std
from shoplens.plans.queries_feeds import platform_a_record
from shoplens.plans.queries_streams import MAPPED_A
from shoplens.sources import feeds, upload_files
from shoplens.sources.tables import ORDER_SOURCES, land_pages
from shoplens.sources.tables import landed as land

ORDERS_PER_FILE, ORDERS_PER_PAGE, ROWS_PER_BOOK = 2000, 25, 100

# The three exports of a file number modulo 3: charset, byte order mark, columns.
EXPORTS = [
    ("UTF-8", False, ["日期", "商品名称", "销售额", "订单数", "编号"], ["day", "product", "amount", "units", "order_id"]),
    ("GBK", False, ["Order Date", "Product Name", "编号", "Total Sales", "Units Sold"], ["day", "product", "order_id", "amount", "units"]),
    ("UTF-8", True, ["编号", "revenue", "销量", "item name", "时间"], ["order_id", "amount", "units", "product", "day"]),
]


def _order_number() -> Column:
    return F.split("order_id", "-")[0].cast("bigint")


def export_files(m) -> DataFrame:
    """(path, content) of CSV exports with three headers in three encodings; of
    each first export, rows of 50 units have a cell too many.  Beside them
    files that no reader takes, one for each nation."""
    rows = m.orders.select(
        F.floor(_order_number() / ORDERS_PER_FILE).alias("file"), "order_id", X.day_str("paid_at").alias("day"),
        F.col("product_name").alias("product"), F.format_number("gmv", 2).alias("amount"), F.col("quantity").cast("string").alias("units"), "quantity")
    out = None
    for k, (charset, mark, names, columns) in enumerate(EXPORTS):
        line = F.to_csv(F.struct(*columns))
        if k == 0:
            line = F.when(F.col("quantity") == 50, F.concat(line, F.lit(",surplus"))).otherwise(line)
        # a file holds the lines of ORDERS_PER_FILE orders
        texts = (rows.where(F.col("file") % 3 == k).select("file", line.alias("line")).groupBy("file")
                 .agg(F.concat(F.lit(",".join(names) + "\n"), F.array_join(F.collect_list("line"), "\n"), F.lit("\n")).alias("text")))
        data = F.encode("text", charset)
        made = texts.select(F.concat(F.lit(f"export-{k}-"), F.col("file").cast("string"), F.lit(".csv")).alias("path"),
                            (F.concat(F.unhex(F.lit("EFBBBF")), data) if mark else data).alias("content"))
        out = made if out is None else out.unionByName(made)
    n = F.col("n_nationkey")
    bad = m.raw("nation").select(
        F.concat(F.lit("bad-"), n.cast("string"), F.when(n % 4 == 0, ".exe").when(n % 4 == 3, ".xlsx").otherwise(".csv")).alias("path"),
        F.when(n % 4 == 1, F.unhex(F.lit(""))).when(n % 4 == 2, F.unhex(F.lit("FFFF8081"))).otherwise(F.unhex(F.lit("4D5A"))).alias("content"))
    return out.unionByName(bad)


def export_records(m) -> DataFrame:
    def write(path):
        export_files(m).write.parquet(path)
    path = land(m.spark, m.sf_dir, "export-files", write, ORDER_SOURCES)
    return upload_files.upload_records(m.spark.read.parquet(path))


SURPLUS = f"((CAST(split_part(order_id, '-', 1) AS BIGINT) // {ORDERS_PER_FILE}) % 3 = 0 AND quantity = 50)"


@register("upload_mixed_headers", with_std(f"""
SELECT order_id, strftime(paid_at, '%Y-%m-%d') AS day, product_name AS product, CAST(gmv AS DOUBLE) AS gmv, CAST(quantity AS DOUBLE) AS orders
FROM std_orders WHERE NOT {SURPLUS}
"""))
def upload_mixed_headers(m):
    """S1 + P1 + X1: exports with different headers, column orders and encodings
    read together, each by its own header."""
    rows = export_records(m).where("kind = 'row'")
    return rows.select(F.col("cells")["编号"].alias("order_id"), F.col("std")["date"].alias("day"), F.col("std")["product"].alias("product"),
                       X.parse_dirty_number(F.col("std")["gmv"]).alias("gmv"), X.parse_dirty_number(F.col("std")["orders"]).alias("orders"))


@register("upload_corrupt_rows", with_std(f"""
, f AS (SELECT DISTINCT CAST(split_part(order_id, '-', 1) AS BIGINT) // {ORDERS_PER_FILE} AS file FROM std_orders),
o AS (SELECT *, CAST(split_part(order_id, '-', 1) AS BIGINT) // {ORDERS_PER_FILE} AS file, {SURPLUS} AS surplus FROM std_orders)
SELECT 'header' AS kind, CAST(NULL AS VARCHAR) AS reason, CAST(count(*) AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS files FROM f
UNION ALL SELECT CASE WHEN surplus THEN 'extra' ELSE 'row' END, NULL, CAST(count(*) AS BIGINT), CAST(count(DISTINCT file) AS BIGINT) FROM o GROUP BY 1
UNION ALL SELECT 'rejected', CASE n_nationkey % 4 WHEN 0 THEN 'unsupported_format' WHEN 1 THEN 'empty_file' WHEN 2 THEN 'unknown_encoding' ELSE 'broken_workbook' END,
  CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT) FROM nation GROUP BY 2
"""))
def upload_corrupt_rows(m):
    """S11 + S12: rows with surplus cells and files that cannot be read, kept and counted."""
    return upload_files.counts(export_records(m))


def workbook(cells: list[list], dates: set[int]) -> bytes:
    """A small .xlsx: text as shared strings, numbers as such, the columns
    ``dates`` in a date style."""
    import io
    import zipfile
    from xml.sax.saxutils import escape
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: dict[str, int] = {}
    rows = []
    for r, row in enumerate(cells, 1):
        made = []
        for k, v in enumerate(row):
            if isinstance(v, str):
                made.append(f'<c r="{chr(65 + k)}{r}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
            elif v is not None:
                made.append(f'<c r="{chr(65 + k)}{r}"{" s=" + chr(34) + "1" + chr(34) if k in dates else ""}><v>{v}</v></c>')
        rows.append(f'<row r="{r}">{"".join(made)}</row>')
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{links}"><sheets><sheet name="1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                      f'<Relationship Id="rId1" Type="{links}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {main}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in shared)}</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{''.join(rows)}</sheetData></worksheet>"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


BOOK_NAMES = ["达人昵称", "粉丝数", "销售额", "统计日期", "备注"]


def workbook_files(m) -> DataFrame:
    """(path, content) of creator workbooks, each with one more row that repeats
    its header."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def build(key, rows):
        import pandas as pd
        body = [[r.name, r.followers, r.gmv, r.serial, None] for r in rows.itertuples(index=False)]
        return pd.DataFrame({"path": [f"creators-{key[0]}.xlsx"], "content": [workbook([BOOK_NAMES, *body, BOOK_NAMES], {3})]})

    numbered = m.influencers.select(F.floor(F.col("creator_id").cast("bigint") / ROWS_PER_BOOK).alias("book"), "name", F.col("followers").cast("bigint").alias("followers"),
                                    F.col("gmv").cast("double").alias("gmv"), (F.col("followers") % 1000 + 45000).cast("bigint").alias("serial"))
    return numbered.groupBy("book").applyInPandas(build, "path string, content binary")


@register("upload_excel", with_std(f"""
, b AS (SELECT CAST(creator_id AS BIGINT) // {ROWS_PER_BOOK} AS book, * FROM std_influencers)
SELECT 'creators-' || book || '.xlsx' AS path, name AS creator, CAST(followers AS DOUBLE) AS followers, CAST(gmv AS DOUBLE) AS gmv,
  strftime(DATE '1899-12-30' + CAST(45000 + followers % 1000 AS INTEGER), '%Y-%m-%d 00:00:00') AS day FROM b
UNION ALL SELECT DISTINCT 'creators-' || book || '.xlsx', '达人昵称', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), '统计日期' FROM b
""", influencers=True))
def upload_excel(m):
    """Workbooks with shared strings, numbers, dates, an empty column and a
    body row that equals the header."""
    def write(path):
        workbook_files(m).write.parquet(path)
    path = land(m.spark, m.sf_dir, "workbooks", write, ORDER_SOURCES + ["events"])
    rows = upload_files.standard_rows(upload_files.upload_records(m.spark.read.parquet(path)), ["creator", "followers", "gmv", "date"])
    return rows.select("path", "creator", X.parse_dirty_number(F.col("followers")).alias("followers"),
                       X.parse_dirty_number(F.col("gmv")).alias("gmv"), F.col("date").alias("day"))


# ---------------------------------------------------------------- pages of many records
def paged_orders(m) -> DataFrame:
    """Platform A pages of up to 25 orders' lines; every tenth page comes a
    second time cut off, every eleventh as an error reply without a list,
    every thirteenth as an empty list, every seventeenth as nothing; and the
    raw web pages."""
    def write(path):
        # the orders meet by page as columns: as JSON they take several times the room
        one = (m.orders.where(F.col("platform") == "tiktok").withColumn("page", F.floor(_order_number() / ORDERS_PER_PAGE))
               .repartition("page").select("page", F.to_json(platform_a_record()).alias("record")))
        # at most ORDERS_PER_PAGE orders of seven lines
        pages = one.groupBy("page").agg(F.concat(F.lit('{"orders":['), F.array_join(F.collect_list("record"), ","), F.lit("]}")).alias("body"))
        no = F.col("page")
        again = pages.select(F.explode(F.array_compact(F.array(
            F.col("body"),
            F.when(no % 10 == 0, F.expr("substring(body, 1, length(body) - 7)")),
            F.when(no % 11 == 0, F.lit('{"code": 105001, "message": "access token expired"}')),
            F.when(no % 13 == 0, F.lit('{"orders": []}')),
            F.when(no % 17 == 0, F.lit(" "))))).alias("body"))
        html = m.raw("pages").select(F.col("html").alias("body"))
        land_pages(again.unionByName(html), path, records_per_page=ORDERS_PER_PAGE)
    path = land(m.spark, m.sf_dir, "paged-orders", write, ORDER_SOURCES + ["pages"])
    return m.spark.read.text(path).select(F.col("value").alias("body"))


@register("paged_order_feed", with_std(MAPPED_A + """
SELECT order_id, product_name, CAST(gmv AS DOUBLE) AS gmv, quantity, status FROM mapped_a
"""))
def paged_order_feed(m):
    """S4 + P2: pages of many records, read past cut-off, empty and error pages."""
    r = mappers.map_platform_a_order(feeds.parse_pages(paged_orders(m), "platform_a_orders"), shop_id="SHOP_A")
    return r.select("order_id", "product_name", F.col("gmv").cast("double").alias("gmv"), "quantity", "status")


@register("quarantine_pages", with_std(f"""
, p AS (SELECT CAST(split_part(order_id, '-', 1) AS BIGINT) // {ORDERS_PER_PAGE} AS page, count(*) AS n FROM std_orders WHERE platform = 'tiktok' GROUP BY 1)
SELECT 'data' AS page, CAST(count(*) + count(*) FILTER (page % 13 = 0) AS BIGINT) AS pages, CAST(sum(n) AS BIGINT) AS records FROM p
UNION ALL SELECT 'unparsable', count(*) FILTER (page % 10 = 0), 0 FROM p
UNION ALL SELECT 'no_list', count(*) FILTER (page % 11 = 0), 0 FROM p
UNION ALL SELECT 'empty', count(*) FILTER (page % 17 = 0), 0 FROM p
UNION ALL SELECT 'html', count(*), 0 FROM pages
"""))
def quarantine_pages(m):
    """S9 + K5: pages and records of each kind, data and quarantined."""
    return feeds.page_counts(paged_orders(m), "platform_a_orders")
