"""Workbooks as a data source: one partition a sheet, rows with their 1-based number and their cells as text.

    spark.dataSource.register(Workbook); spark.read.format("workbook").load(path)
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, source_row int, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


class SheetPartition(InputPartition):
    def __init__(self, sheet: str, part: str):
        self.sheet, self.part = sheet, part


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[SheetPartition]:
        with zipfile.ZipFile(self.path) as book:
            relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
            return [SheetPartition(s.get("name"), "xl/" + relations[s.get(_REL)].removeprefix("/xl/")) for s in sheets]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
            with book.open(partition.part) as file:
                for _, element in ElementTree.iterparse(file):
                    if element.tag != f"{_MAIN}row":
                        continue
                    cells: list[str | None] = []
                    for cell in element:
                        letters = re.match("[A-Z]+", cell.get("r", ""))
                        at = 0
                        for c in letters[0] if letters else "":
                            at = at * 26 + ord(c) - 64
                        cells += [None] * (at - 1 - len(cells) if at else 0)
                        value = cell.find(f"{_MAIN}v")
                        if cell.get("t") == "inlineStr":
                            cells.append("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
                        elif value is None:
                            cells.append(None)
                        else:
                            cells.append(shared[int(value.text)] if cell.get("t") == "s" else value.text)
                    yield partition.sheet, int(element.get("r")), cells
                    element.clear()


def header_rows(rows, required: list[str]):
    """For each sheet the number of the first row that holds all required headers."""
    from pyspark.sql import functions as F

    trimmed = F.transform("cells", lambda c: F.trim(c))
    there = F.size(F.array_except(F.array(*map(F.lit, required)), trimmed)) == 0
    return rows.filter(there).groupBy("sheet").agg(F.min("source_row").alias("header_row"))
