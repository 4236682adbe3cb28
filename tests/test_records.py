"""Records with line breaks inside quotes, from files read in many parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillbook import SALES, sources as src
from tillbook.shared import write_and_read
from tillbook.sources import records, uploads


def plain_records(text):
    """Filled records of a text, read character by character."""
    out, record, inside = [], "", False
    i = 0
    while i < len(text):
        c = text[i]
        if c == '"':
            inside = not inside
        if c in "\r\n" and not inside:
            i += text[i : i + 2] == "\r\n"
            out.append(record)
            record = ""
        else:
            record += c
        i += 1
    out.append(record)
    return [r for r in out if r.strip(" \t\r\n")]


def untidy_text(pick, n, feed):
    """Records with quotes, breaks inside quotes, blank lines and few long ones."""
    field = lambda: pick.choice(
        ["a", "", '"x"', '"q ""r"""', '"line\nbreak"', '"two\r\nthree\n\n"', '"' + "long\n" * pick.randrange(40) + '"', "é ü", '"\r"']
    )
    lines = [",".join(field() for _ in range(4)) for _ in range(n)]
    return feed.join(lines[:1] + [pick.choice([line, line, "", "  "]) for line in lines[1:]])


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def lines_of(spark, path):
    text = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )


@pytest.mark.parametrize("feed", ["\n", "\r\n", "\r"])
def test_records_of_parts_are_those_of_the_file(spark, tmp_path, small_parts, feed):
    pick = random.Random(len(feed) + ord(feed[0]))
    texts = {f"f{i}.csv": untidy_text(pick, pick.randrange(1, 150), feed) for i in range(6)}
    texts["open.csv"] = 'a,b\n1,"never closed\n' + "x\n" * 300 + "x"
    texts["empty.csv"] = " \n\n"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = lines_of(spark, str(tmp_path))
    parts = {}
    for r in lines.groupBy("file").agg(F.count_distinct("start").alias("n")).collect():
        parts[r["file"].rsplit("/", 1)[-1]] = r["n"]
    assert feed == "\r" or sum(n > 5 for n in parts.values()) >= 3
    found = {}
    for r in records.quoted_records(lines).orderBy("file", "place").collect():
        found.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["line"])
        assert r["whole"]
    assert found == {name: plain_records(text) for name, text in texts.items() if plain_records(text)}


def test_a_quote_that_is_never_closed(spark, tmp_path, small_parts):
    (tmp_path / "a.csv").write_text('date,product,sales\n2024-01-01,x,1\n2024-01-02,"y,2\n' + "2024-01-03,z,3\n" * 200)
    (tmp_path / "b.csv").write_text('date,product,sales\n2024-01-04,"v\nw",4\n')
    out = records.quoted_records(lines_of(spark, str(tmp_path)), record_bytes=500).orderBy("file", "place").collect()
    assert [(r["line"], r["whole"]) for r in out][2] == ('2024-01-02,"y,2', False) and len(out) == 5
    assert sum(r["whole"] for r in out) == 4


def test_uploads_with_breaks_in_quotes(spark, tmp_path, small_parts, monkeypatch):
    """Rows, headers, tenants and reasons are those of lines read one file at a time."""
    monkeypatch.setattr(records, "RECORD_BYTES", 4000)
    monkeypatch.setattr(records.quoted_records, "__defaults__", (4000,))
    pick = random.Random(5)
    want = []
    for t in range(3):
        folder = tmp_path / f"user_id=t{t}"
        folder.mkdir()
        rows = [(f"2024-01-{i % 28 + 1:02d}", pick.choice(["a", "b\nc", 'd "e"\r\nf', "g\n\n"]), str(i)) for i in range(80)]
        quoted = lambda v: '"' + v.replace('"', '""') + '"'
        body = "\n".join(",".join(map(quoted, (r[1], r[0], r[2]))) for r in rows)
        (folder / "x.csv").write_bytes(("﻿\n\nProduct,\"Date\",SALES\r\n" + body).encode())
        want += [(f"t{t}", r[0], r[1], r[2], None) for r in rows]
    (tmp_path / "user_id=t0" / "open.csv").write_text('date,product,sales\n2024-01-01,"x,1\n' + "y\n" * 3000)
    (tmp_path / "user_id=t1" / "head.csv").write_text("date,product,sales\n")
    (tmp_path / "user_id=t1" / "no.xls").write_text("date,product,sales\n1,2,3\n")
    out = src.read_csv_uploads(spark, str(tmp_path), SALES, multiline=True)
    got = [(r["user_id"], r["date"], r["product"], r["sales"], r["reject_reason"]) for r in out.collect()]
    assert sorted(r for r in got if r[4] is None) == sorted(want)
    reasons = sorted((r[0], r[4]) for r in got if r[4])
    assert reasons == [("t0", "unclosed_quote"), ("t1", "no_rows"), ("t1", "unsupported_file")]
    assert uploads.CSV_GLOB


def test_only_pieces_of_records_are_written(spark, tmp_path, small_parts, monkeypatch):
    """Records that lie in one part of a file are neither moved nor written."""
    kept = []
    monkeypatch.setattr(records, "write_and_read", lambda df: kept.append(write_and_read(df)) or kept[-1])
    (tmp_path / "a.csv").write_text("a,b\n" + '1,"x\ny"\n2,z\n' * 200)
    lines = lines_of(spark, str(tmp_path))
    out = records.quoted_records(lines)
    assert out.count() == 401
    parts = lines.select("start").distinct().count()
    assert parts > 5 and sum(df.count() for df in kept) <= 2 * parts
