from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sillage.llm import warc
from sillage.llm.queries import op3_warc

SF = "/root/testdata/sf0.001"


def test_query_equals_its_definition(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = op3_warc(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        body = pages[r["page_id"]]
        holder = max(k for k, b in pages.items() if b == body)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if holder == r["page_id"] else ("revisit", holder))


ROWS = [(1, "http://a/\r\nX: y", "same"), (5, None, "same"), (3, "http://é/", "same"), (7, "u", None), (9, "u", ""), (11, "u", "WARC/1.1\r\n\r\n\x00é" * 1000), (None, "u", "same"), (None, "u", "alone"), (5, "u", "same")]


@pytest.mark.parametrize("least", [0, 3, 100])
def test_copies_nulls_and_repeated_rows(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, "clash", 0) for r in ROWS], "page_id long, url string, html string, payload string, sha int")
    files = warc.archive(df, f"file://{tmp_path}/w", least=least)
    rows = sorted(warc.read_archives(files, payload=True).collect(), key=str)
    assert len(rows) == len(ROWS)
    for r in rows:
        group = [k for k, _, h in ROWS if k is not None and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r["payload_digest"]]
        holder = max(group, default=None) if r["payload_bytes"] >= least else None
        revisit = holder is not None and r["key"] != holder
        assert (r["record_type"] == "revisit") == revisit and r["refers_to"] == (holder if revisit else None)
        assert (r["payload"] is None) == revisit
    assert sum(r["payload_bytes"] for r in rows) == sum(len((h or "").encode()) for *_, h in ROWS)


def test_members_stand_alone_and_match_the_index(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.col("id").cast("string"), 500).alias("html")).repartition(3)
    files = warc.archive(df, str(tmp_path / "w")).collect()
    assert sum(f["records"] for f in files) == 40
    for f in files:
        data = Path(f["path"]).read_bytes()
        whole = gzip.decompress((Path(tmp_path) / "w" / "whole" / Path(f["path"]).name).read_bytes())
        assert gzip.decompress(data) == whole
        entries = [json.loads(x) for x in Path(f["index_path"]).read_text().splitlines()]
        assert [e["offset"] for e in entries] == [sum(e["length"] for e in entries[:i]) for i in range(len(entries))]
        for e in entries:
            member = zlib.decompressobj(31)
            fields, _, body = warc.read_record(data[e["offset"] : e["offset"] + e["length"]])
            member.decompress(data[e["offset"] : e["offset"] + e["length"]])
            assert member.eof and not member.unused_data and fields["warc-record-id"] == e["id"] and fields["warc-target-uri"] == e["uri"]
            assert warc.payload_digest(body) == fields["warc-payload-digest"].removeprefix("sha1:")


def test_large_records_stream_and_damage_is_noticed(tmp_path):
    body = bytes(range(256)) * 20_000
    parts = []
    for key in range(3):
        parts += [*warc.record(key, "u", body, warc.payload_digest(body), None, "2024-01-01T00:00:00Z"), b"\r\n\r\n"]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(parts)))
    assert warc.normalise_file(str(tmp_path / "a.gz"), str(tmp_path / "b" / "a.gz")) == 3
    # a normalised file, whose records are members, can be normalised again
    assert warc.normalise_file(str(tmp_path / "b" / "a.gz"), str(tmp_path / "c" / "a.gz")) == 3
    assert (tmp_path / "b" / "a.gz").read_bytes() == (tmp_path / "c" / "a.gz").read_bytes()
    (tmp_path / "cut.gz").write_bytes((tmp_path / "a.gz").read_bytes()[:-2000])
    with pytest.raises(EOFError):
        warc.normalise_file(str(tmp_path / "cut.gz"), str(tmp_path / "d" / "a.gz"))
    assert not (tmp_path / "d" / "a.gz").exists()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.archive(df, str(tmp_path / "w"))).count() == 0


def test_files_roll(spark, tmp_path):
    rows = spark.range(30).select(F.col("id").alias("key"), F.lit("u").alias("url"), F.repeat(F.lit("x"), 1000).cast("binary").alias("payload"), F.lit("00" * 20).alias("digest"), F.lit(None).cast("long").alias("refers_to")).coalesce(1)
    assert [r["records"] for r in warc.write_archives(rows, str(tmp_path), roll=10_000).collect()] == [8, 8, 8, 6]
