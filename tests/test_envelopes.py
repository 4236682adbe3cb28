"""Envelopes decoded in chunks against envelopes decoded in one row."""

from __future__ import annotations

import base64
import random

import pytest

from tillbook import SALES, sources as src


def envelope(data, kind="text/csv"):
    return f"data:{kind};base64," + base64.b64encode(data).decode()


def uploads(spark, multiline):
    pick = random.Random(8)
    product = lambda: pick.choice(["a", "é ü 中文", '"q ""r"""', "x" * 50, "", "NA"] + ['"one\ntwo"', '"three\r\n\n"'] * multiline)
    rows = []
    for i in range(25):
        feed = pick.choice(["\n", "\r\n", "\r"])
        head = pick.choice(["date,product,sales,category", " SALES ,Note,\"Category\",Product,DATE", "﻿Product,Sales"])
        lines = [",".join(pick.choice([product(), "2024-01-02", "5"]) for _ in range(head.count(",") + 1)) for _ in range(pick.randrange(0, 40))]
        text = feed.join([("" if head[0] == "\ufeff" else pick.choice(["", "  " + feed])) + head, *lines]) + pick.choice(["", feed, feed + feed])
        data = text.encode()
        if i % 5 == 0:
            data = data.replace(b"a", b"\xff\xe9")
        rows.append((f"t{i % 3}", pick.choice(["f.csv", "f.csv", "G.CSV"]), envelope(data)))
    good = envelope(b"date,product,sales\n2024-01-01,x,1\n")
    rows += [
        ("t1", "x.xlsx", good), ("t1", None, good), ("t1", "", good), ("t1", "n.csv", None), ("t1", "n.csv", ""), ("t1", "n.csv", "no comma"),
        ("t1", "bad.csv", "data:,@@@@"), ("t1", "bad.csv", good[:-3]), ("t1", "empty.csv", envelope(b"")), ("t1", "head.csv", envelope(b"a,b\n")),
        (None, "f.csv", good), ("t2", "f.csv", good), ("t2", "f.csv", good), ("t2", "wide.csv", envelope(b"date,sales\n1,2,3\n")),
        ("t2", "twice.csv", envelope(b"sales,Sales \n1,2\n")),
    ]
    return spark.createDataFrame(rows, "user_id string, filename string, contents string")


@pytest.mark.parametrize("multiline", [False, True])
@pytest.mark.parametrize("chunk", [16, 64, 1 << 20])
def test_chunks_give_the_rows_of_whole_envelopes(spark, multiline, chunk):
    given = uploads(spark, multiline)
    plain = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    want = plain(src.decode_uploads(given, SALES, multiline))
    assert plain(src.decode_large_uploads(given, SALES, multiline, chunk)) == want
    reasons = {value for row in want for value in row}
    assert reasons >= {"no_file", "unsupported_file", "bad_encoding", "no_rows", "too_many_fields", "duplicate_header"}


def test_no_uploads(spark):
    assert src.decode_large_uploads(uploads(spark, False).limit(0), SALES).count() == 0
    with pytest.raises(ValueError):
        src.decode_large_uploads(uploads(spark, False), SALES, chunk=6)
