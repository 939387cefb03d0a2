"""Uploaded files read one by one, each under its own header.

The input is a frame of files (path, content): ``files`` reads a folder of any
store with Spark's ``binaryFile``; content held in a table will do as well.
Each file is parsed where its content lies, a bounded number of bytes of files
in a Python batch, and comes out as records:

* ``header``  -- the file's column names (``names``), one record a file;
* ``row``     -- ``cells``, a map from the file's own column names to text, and
  ``std``, the cells of the recognised columns under their canonical names;
* ``extra``   -- a row with more cells than the header has names: ``cells`` as
  above and the surplus in ``surplus`` (nothing is cut off unseen);
* ``rejected`` -- a whole file that is empty, too large, of an unknown format or
  encoding, or no workbook; ``reason`` says which.

CSV: the encoding is the first of those listed that decodes the whole file; a
quoted cell may hold line breaks; blank lines are passed over; short rows have
null cells.  Workbooks (.xlsx): the first worksheet, streamed out of the zipped
XML with the shared strings; date cells become ISO text; a body row that
equals the header is a row.  Repeated names get ``.1``, ``.2``; a nameless
column is ``Unnamed: <n>``.
"""

from __future__ import annotations

import codecs
import csv
import datetime as dt
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, iterparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens import constants as K
from shoplens.sources.uploads import map_columns

RECORD = ("path string, kind string, reason string, encoding string, line bigint, names array<string>, cells map<string,string>, "
          "std map<string,string>, surplus array<string>")
_MAP = pa.map_(pa.string(), pa.string())
_SCHEMA = pa.schema([("path", pa.string()), ("kind", pa.string()), ("reason", pa.string()), ("encoding", pa.string()), ("line", pa.int64()),
                     ("names", pa.list_(pa.string())), ("cells", _MAP), ("std", _MAP), ("surplus", pa.list_(pa.string()))])
BATCH_ROWS = 5000
CHUNK_BYTES = 1 << 16
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Number formats of a workbook that are dates.
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 50, 57}


class Unreadable(ValueError):
    """A file that is not taken; the text is the reason."""


def encoding_of(content: bytes, encodings: list[str]) -> str:
    """The first encoding that decodes the whole file, tried chunk by chunk."""
    for name in encodings:
        if name == "utf-8-sig" and not content.startswith(codecs.BOM_UTF8):
            continue
        decoder, view = codecs.getincrementaldecoder(name)(), memoryview(content)
        try:
            for at in range(0, len(view), CHUNK_BYTES):
                decoder.decode(bytes(view[at:at + CHUNK_BYTES]))
            decoder.decode(b"", final=True)
            return name
        except UnicodeDecodeError:
            continue
    raise Unreadable("unknown_encoding")


def csv_rows(content: bytes, encoding: str) -> Iterator[tuple[int, list[str | None]]]:
    """Rows, decoded as they are read: the text of a file is never held whole."""
    reader = csv.reader(io.TextIOWrapper(io.BytesIO(content), encoding, newline=""))
    try:
        for cells in reader:
            if cells:
                yield reader.line_num, [c if c != "" else None for c in cells]
    except csv.Error:
        raise Unreadable("broken_csv") from None


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _texts(archive: zipfile.ZipFile) -> list[str]:
    """Shared strings; rich text is joined, phonetic marks are left out."""
    out: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        with archive.open("xl/sharedStrings.xml") as f:
            for _, e in iterparse(f):
                if e.tag == MAIN + "rPh":
                    e.clear()
                elif e.tag == MAIN + "si":
                    out.append("".join(t.text or "" for t in e.iter(MAIN + "t")))
                    e.clear()
    return out


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    own, styles, inside = set(), [], False
    with archive.open("xl/styles.xml") as f:
        for event, e in iterparse(f, ("start", "end")):
            if e.tag == MAIN + "cellXfs":
                inside = event == "start"
            elif event == "end" and e.tag == MAIN + "numFmt":
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", ""))
                if re.search(r"[ydYD]|m.*[ydh]|h.*m", code):
                    own.add(int(e.get("numFmtId")))
            elif event == "end" and inside and e.tag == MAIN + "xf":
                styles.append(int(e.get("numFmtId", 0)))
    return {k for k, number in enumerate(styles) if number in DATE_FORMATS or number in own}


def _first_sheet(archive: zipfile.ZipFile) -> tuple[str, dt.datetime]:
    """The part of the first worksheet, and the day that serial 0 stands for."""
    relation, epoch = None, dt.datetime(1899, 12, 30)
    with archive.open("xl/workbook.xml") as f:
        for _, e in iterparse(f):
            if e.tag == MAIN + "workbookPr" and e.get("date1904") in ("1", "true"):
                epoch = dt.datetime(1904, 1, 1)
            elif e.tag == MAIN + "sheet" and relation is None:
                relation = next((v for k, v in e.attrib.items() if k.endswith("}id")), "")
    with archive.open("xl/_rels/workbook.xml.rels") as f:
        for _, e in iterparse(f):
            if e.get("Id") == relation:
                target = e.get("Target", "")
                return (target[1:] if target.startswith("/") else "xl/" + target), epoch
    raise Unreadable("no_worksheet")


def _value(cell, kind: str | None, shared: list[str], dates: set[int], epoch: dt.datetime) -> str | None:
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(MAIN + "t")) or None
    v = cell.find(MAIN + "v")
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)] or None
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind is None or kind == "n":
        if int(cell.get("s", 0)) in dates:
            day = epoch + dt.timedelta(milliseconds=round(float(v.text) * 86_400_000))
            return day.isoformat(" ", "milliseconds" if day.microsecond else "seconds")
        number = float(v.text)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return v.text


def workbook_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of the first worksheet, one at a time."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            part, epoch = _first_sheet(archive)
            shared, dates, number = _texts(archive), _date_styles(archive), 0
            with archive.open(part) as f:
                for _, e in iterparse(f):
                    if e.tag != MAIN + "row":
                        continue
                    number = int(e.get("r", number + 1))
                    cells: list[str | None] = []
                    for c in e.findall(MAIN + "c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        cells[at] = _value(c, c.get("t"), shared, dates, epoch)
                    e.clear()
                    if any(x is not None for x in cells):
                        yield number, cells
    except (zipfile.BadZipFile, KeyError, ParseError, IndexError) as e:
        raise Unreadable("broken_workbook") from e


def header_names(cells: list[str | None]) -> list[str]:
    names: list[str] = []
    for k, c in enumerate(cells):
        name = str(c).strip().lstrip("﻿") if c is not None else f"Unnamed: {k}"
        n, base = 0, name
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def file_records(path: str, content: bytes | None, aliases: dict[str, list[str]], max_bytes: int | None, encodings: list[str]) -> Iterator[tuple]:
    """Records of one file, as tuples of ``RECORD``."""
    try:
        suffix = re.search(r"\.[^./]+$", path.lower())
        if not content:
            raise Unreadable("empty_file")
        if max_bytes is not None and len(content) > max_bytes:
            raise Unreadable("too_large")
        if suffix and suffix[0] == ".csv":
            encoding = encoding_of(content, encodings)
            rows = csv_rows(content, encoding)
        elif suffix and suffix[0] == ".xlsx":
            rows, encoding = workbook_rows(content), None
        else:
            raise Unreadable("unsupported_format")
        first = next(rows, None)
        if first is None:
            raise Unreadable("empty_file")
        names = header_names(first[1])
        std = list(map_columns(names, aliases).items())
        yield path, "header", None, encoding, first[0], names, None, None, None
        for line, cells in rows:
            by_name = dict(zip(names, cells + [None] * (len(names) - len(cells)), strict=False))
            surplus = cells[len(names):]
            yield (path, "extra" if any(c is not None for c in surplus) else "row", None, encoding, line, None,
                   list(by_name.items()), [(c, by_name[source]) for c, source in std], surplus or None)
    except Unreadable as e:
        # rows before a break in the file stay; the record counts the break
        yield path, "rejected", str(e), None, None, None, None, None, None


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def upload_records(uploads: DataFrame, max_bytes: int | None = K.UPLOAD_MAX_BYTES, aliases: dict[str, list[str]] = K.COLUMN_ALIASES,
                   encodings: list[str] = K.UPLOAD_ENCODINGS) -> DataFrame:
    """Records of ``uploads`` (path, content); a file of more than ``max_bytes``
    is rejected (None: none is)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                for r in file_records(path.as_py(), content.as_py(), aliases, max_bytes, encodings):
                    rows.append(r)
                    if len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return uploads.select("path", "content").mapInArrow(parse, RECORD)


def counts(records: DataFrame) -> DataFrame:
    """Quarantine counts: records of each kind and reason, and their files."""
    return records.groupBy("kind", "reason").agg(F.count("*").alias("records"), F.count_distinct("path").alias("files"))


def standard_rows(records: DataFrame, columns: list[str]) -> DataFrame:
    """Rows under canonical names, whatever each file calls them; rows with
    surplus cells are not among them (see ``counts``)."""
    return records.where("kind = 'row'").select("path", "line", *[F.col("std")[c].alias(c) for c in columns])


def table(records: DataFrame) -> DataFrame:
    """Rows under all column names that occur, in the order of the files' paths
    and columns; one list of names a distinct header comes to the driver."""
    heads = records.where("kind = 'header'").groupBy("names").agg(F.min("path").alias("path")).orderBy("path").collect()
    names = list(dict.fromkeys(n for h in heads for n in h["names"]))
    return records.where("kind = 'row'").select(*[F.col("cells")[F.lit(n)].alias(n) for n in names])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
