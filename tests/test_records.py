"""Spectrum records, folds and workbooks."""

from __future__ import annotations

import json
import random

import pytest

from sillage.operators import folds
from sillage.sinks.workbook import sheet_names, write_workbook
from sillage.sources import spectrum_records
from sillage.sources.xlsx import Workbook

KEY = "ABCDEFGHIJKLMN-OPQRSTUVWX-N"
NESTED = {
    "accession": "A1",
    "license": "CC BY-NC-SA",
    "compound": {"names": ["INVENTED ESTER"], "smiles": "CCCCOC", "link": [{"database": "InChIKey", "identifier": KEY}]},
    "acquisition": {"instrument": "X", "instrument_type": "EI-B", "mass_spectrometry": {"ms_type": "MS", "ion_mode": "POSITIVE", "subtags": [{"subtag": "IONIZATION_ENERGY", "value": "70 eV"}]}},
    "mass_spectrometry": {"focused_ion": [{"subtag": "ION_TYPE", "value": "[M]+*"}]},
    "peak": {"peak": {"values": [{"mz": 51.5, "intensity": 50.0, "rel": 999}, {"mz": 77.25, "rel": 25.0}]}},
}
FLAT = {"adduct": "[M-H]-", "compound_name": "x", "inchikey": "K", "ion_mode": "Negative", "ms_level": 2, "peaks": [[88.5, 10.0], [91.5, 20.0], [1.0]], "precursor_mz": 401.7}
ANNOTATED = {"annotations": [{"Compound_Name": "Inventin", "Adduct": "M-H", "Precursor_MZ": "212.125", "CAS_Number": "N/A", "Ion_Mode": "Negative"}], "spectruminfo": {"ms_level": "2", "peaks_json": "[[150.5,1000.5],[212.0,4000.25]]"}}


def test_records_of_all_layouts(spark):
    nested = spectrum_records.nested_records(spark.createDataFrame([("q", json.dumps(NESTED)), ("bad", "no json")], "key string, payload string"))
    r = nested.first()
    assert nested.count() == 1 and (r["spectrum_id"], r["spectrum_type"], r["ion_mode"], r["collision_energy"], r["inchikey"], r["cas"]) == ("A1", "EI", "positive", "70 eV", KEY, None)
    assert [(p["mz"], p["intensity"]) for p in r["peaks"]] == [(51.5, 100.0), (77.25, 50.0)]
    broken = ANNOTATED | {"spectruminfo": {"peaks_json": "[["}}
    detail = spectrum_records.detail_records(spark.createDataFrame([("f", json.dumps(FLAT)), ("a", json.dumps(ANNOTATED)), ("b", json.dumps(broken))], "key string, payload string"))
    got = {r["key"]: r for r in detail.collect()}
    assert [(p["mz"], p["intensity"]) for p in got["f"]["peaks"]] == [(88.5, 50.0), (91.5, 100.0)]
    assert (got["a"]["adduct"], got["a"]["cas"], got["a"]["precursor_mz"], len(got["a"]["peaks"]), len(got["b"]["peaks"])) == ("[M-H]-", None, 212.125, 2, 0)
    matched = spectrum_records.identified(nested.unionByName(detail), {"key": KEY, "name": "x"})
    both, counts = spectrum_records.union_with_counts({"one": matched.filter("source = 'nested'"), "two": matched.filter("source = 'detail'")})
    assert both.count() == 4 and sorted(tuple(r) for r in counts.collect()) == [("one", 1, 1, 0, 1), ("two", 3, 0, 3, 0)]


def test_index_search(spark):
    rows = [("l2", "s1", KEY, "a"), ("l1", "s2", KEY[:14] + "-ZZZZZZZZZZ-N", "b  C"), ("l1", "s3", KEY, "d"), ("l1", "s4", "OTHERKEYOTHERK-AAAAAAAAAA-N", "d")]
    index = spark.createDataFrame(rows, "library_name string, spectrum_id string, inchikey string, compound_name string")
    assert [r["spectrum_id"] for r in spectrum_records.search_index(index, inchikey=KEY.lower()).orderBy("pos").collect()] == ["s3", "s1", "s2"]
    assert [r["spectrum_id"] for r in spectrum_records.search_index(index, names=("nothing", "B c", "d")).collect()] == ["s2"]
    assert spectrum_records.search_index(index, names=()).count() == 0


def test_lines_of_characters(spark):
    rows = [("d", 1, t, float(x), x + 5.0, t + 8.0, c) for t, x, c in ((10.0, 0, "H"), (12.0, 5, "i"), (10.0, 14, "a"), (20.0, 0, "b"), (60.0, 0, "c"))]
    df = spark.createDataFrame(rows, "doc string, page int, top double, left double, right double, bottom double, char string")
    assert sorted((r["block"], r["line"], r["text"]) for r in folds.lines_of_characters(df).collect()) == [(0, 0, "Hi a"), (0, 1, "b"), (1, 2, "c")]


def test_every_form_that_starts_a_reference(spark):
    starts = ["VAN DYKE, A. (1931) a", "BROWN (1990) b", "GREEN et al (1991) c", "WHITE (WHITE Ltd) (1992) d", "BLACK & GRAY (1993) e", "STONE J. (1994) f", "O, Y. (1995) g", "HILL-O'NEIL, B. (1996) h"]
    lines = ["REFERENCES", "A", "12", "", *(x for s in starts for x in (s, "Goes on. HERE, not at the start"))]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, pos int, text string")
    got = [r["reference"] for r in folds.references_of_lines(df).orderBy("number").collect()]
    assert got == [f"{s} Goes on. HERE, not at the start" for s in starts]


def plain_lines(chars):
    """One character at a time."""
    lines, anchor = [], None
    for c in sorted(chars, key=lambda c: (round(c[0]), c[1])):
        if anchor is None or abs(c[0] - anchor) > 4:
            lines.append([])
            anchor = c[0]
        lines[-1].append(c)
    out, block, bottom = [], 0, None
    for n, line in enumerate(lines):
        line.sort(key=lambda c: c[1])
        block += bottom is not None and min(c[0] for c in line) - bottom > 3
        bottom = max(c[3] for c in line)
        out.append((block, n, "".join((" " if i and c[1] - line[i - 1][2] > 1.5 else "") + c[4] for i, c in enumerate(line))))
    return out


def test_lines_equal_a_plain_fold(spark):
    draw = random.Random(3)
    chars = [(t := draw.uniform(0, 300), x := draw.uniform(0, 200), x + 4, t + draw.uniform(5, 12), draw.choice("abcde")) for _ in range(400)]
    df = spark.createDataFrame([("d", 1, *c[:2], c[2], c[3], c[4]) for c in chars], "doc string, page int, top double, left double, right double, bottom double, char string")
    assert [(r["block"], r["line"], r["text"]) for r in folds.lines_of_characters(df).orderBy("line").collect()] == plain_lines(chars)


def test_references_of_lines(spark):
    texts = ["AMOORE, J.E. (1986a) A title", "that goes on.", "ADAMS, D.F., F.A. YOUNG", "LUHR, R.A. (1968) Other.", "", "SMITH, A. (1990) Last."]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, pos int, text string").repartition(3)
    assert [r["reference"] for r in folds.references_of_lines(df).orderBy("number").collect()] == ["AMOORE, J.E. (1986a) A title that goes on.", "ADAMS, D.F., F.A. YOUNG LUHR, R.A. (1968) Other.", "SMITH, A. (1990) Last."]


def test_workbooks_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b", None), (2, None, 1.5)], "i int, s string, x double")
    path = str(tmp_path / "b.xlsx")
    write_workbook({"A very long name of a sheet, longer than is allowed": df, "A very long name of a sheet, longer than is allowed, too": df.limit(0)}, path)
    spark.dataSource.register(Workbook)
    rows = [tuple(r) for r in spark.read.format("workbook").load(path).orderBy("sheet", "source_row").collect()]
    assert sorted(r[2] for r in rows) == [["1", "a<b", "NA"], ["2", "NA", "1.5"], ["i", "s", "x"], ["i", "s", "x"]] and len({r[0] for r in rows}) == 2
    assert all(len(n) <= 31 for n in sheet_names(["x" * 50, "x" * 50]))
    with pytest.raises(ValueError):
        write_workbook({"t": df}, path, limit=1)
