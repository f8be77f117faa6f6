"""Workbooks of several tables.

``write_workbook`` is for small ones, whose rows come to the driver.  ``write_parts`` is for
any size: tasks turn bounded runs of rows into compressed pieces of a sheet, and the driver
puts the pieces, one at a time, behind each other into the archive.
"""

from __future__ import annotations

import re
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.workspace import files

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet_names(names: list[str]) -> list[str]:
    """Names of at most 31 allowed characters, made unique by a number."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
        made, i = base, 2
        while made.lower() in (x.lower() for x in out):
            made = f"{base[: 31 - len(str(i)) - 1]}_{i}"
            i += 1
        out.append(made)
    return out


def _cell(value) -> str:
    if value is None:
        value = "NA"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_workbook(tables: dict[str, DataFrame], path: str, *, limit: int = 100_000) -> None:
    """Write the tables as sheets, nulls as NA; a table of more than ``limit`` rows is an error."""
    names = sheet_names(list(tables))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for i, df in enumerate(tables.values(), 1):
            rows = df.limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"{names[i - 1]}: more than {limit} rows; write Parquet instead")
            lines = [df.columns, *rows]
            body = "".join(f'<row r="{n}">{"".join(map(_cell, r))}</row>' for n, r in enumerate(lines, 1))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
        for name, text in _frame(names).items():
            book.writestr(name, text)


def _frame(names: list[str]) -> dict[str, str]:
    """The parts of a workbook beside its sheets."""
    sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    package = "http://schemas.openxmlformats.org/package/2006"
    return {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{links}</Relationships>',
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    }


#: Rows of a sheet that the format allows, and of a piece that a task compresses at a time.
SHEET_ROWS, PIECE_ROWS = 1_048_576, 5_000


def _piece(text: str, last: bool = False) -> tuple[int, int, bytes]:
    """(check sum, size, bytes) of a piece; pieces put behind each other are one compressed stream, which the last one ends."""
    data, squeeze = text.encode(), zlib.compressobj(wbits=-15)
    return zlib.crc32(data), len(data), squeeze.compress(data) + squeeze.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def _pieces(df: DataFrame, folder: str, index: int) -> tuple[DataFrame, int]:
    """The written pieces of one table's rows (sheet, place, crc, size, data), and its number of rows.

    The rows are written first, so that each has a file and a number in it; with the
    counts of the files these give its place.  Sheets end after SHEET_ROWS rows, the
    header's included.
    """
    spark, columns, limit = df.sparkSession, df.columns, SHEET_ROWS - 1
    df.write.parquet(f"{folder}/rows-{index}")
    # files are named by partition, in the table's order
    listed = spark.read.parquet(f"{folder}/rows-{index}").select(F.col("_metadata.file_name").alias("file")).groupBy("file").count().orderBy("file").collect()
    starts, total = {}, 0
    for r in listed:
        starts[r["file"]], total = total, total + r["count"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            places = [starts[f] + n for f, n in zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)]
            rows = list(zip(*(c.to_pylist() for c in batch.columns[:-2]), strict=True))
            out, at = [], 0
            while at < len(rows):
                end = at + 1
                while end < len(rows) and end - at < PIECE_ROWS and places[end] == places[end - 1] + 1 and places[end] % limit:
                    end += 1
                first = places[at] % limit + 2
                text = "".join(f'<row r="{first + n}">{"".join(map(_cell, r))}</row>' for n, r in enumerate(rows[at:end]))
                out.append((places[at] // limit, places[at], *_piece(text)))
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["sheet", "place", "crc", "size", "data"])

    rows = spark.read.schema(df.schema).parquet(f"{folder}/rows-{index}").select(*(F.col(f"`{c}`") for c in columns), F.col("_metadata.file_name").alias("_file_"), F.col("_metadata.row_index").alias("_row_"))
    rows.mapInArrow(write, "sheet long, place long, crc long, size long, data binary").write.parquet(f"{folder}/pieces-{index}")
    return spark.read.parquet(f"{folder}/pieces-{index}"), total


class _Archive:
    """An archive whose members are written piece by piece, already compressed."""

    def __init__(self, out):
        self.out, self.entries, self.at = out, [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, pieces: Iterator[tuple[int, int, bytes]]) -> None:
        start, crc, size, packed = self.at, 0, 0, 0
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 8, 0, 0x21, 0, 0, 0, len(name.encode()), 0) + name.encode())
        for own, length, data in pieces:
            zeros = bytes(length)
            # the sum of two texts follows from their sums and the second's length
            crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ own
            size, packed = size + length, packed + len(data)
            self._put(data)
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, packed, size) if max(size, packed) >= 0xFFFFFFFF else struct.pack("<IIII", 0x08074B50, crc, packed, size))
        self.entries.append((name.encode(), crc, packed, size, start))

    def close(self) -> None:
        start = self.at
        for name, crc, packed, size, at in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        size, count = self.at - start, len(self.entries)
        end = self.at
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0))


def _sheets(rows: int) -> int:
    """Sheets that a table of so many rows takes."""
    return max(1, -(-rows // (SHEET_ROWS - 1)))


def placed(totals: dict[str, int]) -> list[tuple[str, str, int]]:
    """(sheet, title, rows before) of all sheets that ``write_parts`` made of tables with so many rows."""
    parts = [(title, number) for title, rows in totals.items() for number in range(_sheets(rows))]
    names = sheet_names([title if number == 0 else f"{title} {number + 1}" for title, number in parts])
    return [(name, title, number * (SHEET_ROWS - 1)) for name, (title, number) in zip(names, parts, strict=True)]


def joined(rows: DataFrame, totals: dict[str, int]) -> DataFrame:
    """The rows (sheet, source_row, cells) of a workbook by ``write_parts`` with each table whole again: one header, rows numbered on through its sheets."""
    title, before, further = F.col("sheet"), F.lit(0), F.lit(False)
    for name, whole, at in placed(totals):
        here = F.col("sheet") == name
        title, before, further = F.when(here, whole).otherwise(title), F.when(here, at).otherwise(before), F.when(here, F.lit(at > 0)).otherwise(further)
    kept = rows.filter(~(further & (F.col("source_row") == 1)))
    return kept.select(title.alias("sheet"), (F.col("source_row") + before).alias("source_row"), "cells")


def write_parts(tables: dict[str, DataFrame], path: str, folder: str) -> dict[str, int]:
    """Write tables of any size as sheets of the workbook ``path`` and return the rows of each table.

    Rows keep the order that each table has (sort it first); nulls are NA.  A table that
    is longer than a sheet goes on in further ones, each with its header.  ``folder`` is
    a new shared folder for the pieces.  The driver holds one piece at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    sheets, totals = [], {}
    for i, (title, df) in enumerate(tables.items()):
        pieces, totals[title] = _pieces(df, folder, i)
        for number in range(_sheets(totals[title])):
            sheets.append((df.columns, pieces.filter(F.col("sheet") == number).orderBy("place")))
    names = [name for name, _, _ in placed(totals)]

    def sheet(columns: list[str], pieces: DataFrame) -> Iterator[tuple[int, int, bytes]]:
        yield _piece(f'<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{"".join(map(_cell, columns))}</row>')
        for r in pieces.toLocalIterator():
            yield r["crc"], r["size"], bytes(r["data"])
        yield _piece("</sheetData></worksheet>", last=True)

    with tempfile.NamedTemporaryFile(suffix=".xlsx") as own:
        archive = _Archive(own)
        for i, (columns, pieces) in enumerate(sheets, 1):
            archive.add(f"xl/worksheets/sheet{i}.xml", sheet(columns, pieces))
        for name, text in _frame(names).items():
            archive.add(name, iter([_piece(text, last=True)]))
        archive.close()
        own.flush()
        fs, target = files(spark, path)
        fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{own.name}"), target)
    return totals
