"""Mixing, sharding, urls, secrets and licences against plain versions and on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillbook.llm import licenses, mixing, queries, secrets, sharding, urls

from brute import documents, licences, n_words, targets


@pytest.fixture(scope="module")
def mixed(spark):
    """A hot source, a null and a blank one, empty, null, long and repeated texts."""
    pick = random.Random(1)
    rows = [(i, "w " * pick.randrange(0, 60), pick.choice(["hot", "hot", "b", "c", "", "é", None])) for i in range(900)]
    rows += [(900, None, "c"), (901, "", "none at all"), (902, "x " * 4000, "b"), (5, rows[5][1], rows[5][2])]
    return documents(spark, rows)


def test_targets_and_copies(mixed):
    plan = mixing.mix_plan(mixed).select("doc.*", "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for r in plan:
        assert r["size"] == n_words(r["text"]) and r["copies"] in (0, 1, 2)
        sizes[r["source"]] += r["size"]
    want = targets(dict(sizes))
    taken, count = Counter(), Counter()
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["size"] * r["copies"]
        count[r["source"]] += 1
    assert abs(taken["hot"] - want["hot"]) < 0.15 * want["hot"]
    again = mixing.mix_plan(mixed.repartition(7)).select("doc.doc_id", "copies")
    assert sorted(again.collect()) == sorted((r["doc_id"], r["copies"]) for r in plan)
    assert mixing.mix_sources(mixed).count() == sum(r["copies"] for r in plan)


def test_mixing_keeps_columns_and_takes_nothing_from_nothing(spark):
    odd = documents(spark, [(1, "a b", "s")]).withColumns({c: F.lit(c) for c in ("size", "copies", "target", "doc")})
    assert mixing.mix_sources(odd).columns == odd.columns
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mix_sources(documents(spark, [(1, "", "s"), (None, None, None)])).count() == 0


def shards_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out


def test_shards_are_near_equal_and_gapless(spark):
    pick = random.Random(2)
    rows = [(i, "t" * pick.randrange(1, 400)) for i in range(2000)] + [(i, "copy " * 20) for i in range(2000, 3000)]
    rows += [(7, "same row")] * 500 + [(None, None), (None, "")]
    docs = documents(spark, rows).repartition(5).withColumns({"Shard": F.lit("x"), "slot": F.lit("y"), "size": F.lit(1)})
    out = sharding.shard_documents(docs, shards=8)
    assert out.columns == [c for c in docs.columns if c.lower() not in ("shard", "slot")] + ["shard", "slot"]
    parts = shards_of(out.collect())
    assert sorted(parts) == list(range(8)) and sum(map(len, parts.values())) == len(rows)
    sizes = [sum(len(r["text"] or "") + 16 for r in p) for p in parts.values()]
    assert max(sizes) - min(sizes) < 4 * 416
    for p in parts.values():
        assert sorted(r["slot"] for r in p) == list(range(len(p)))
    assert Counter((r["doc_id"], r["text"]) for p in parts.values() for r in p) == Counter(rows)


def test_overfull_ranges_are_subdivided(spark):
    """One key holds all rows: its single range divides by place."""
    rows = spark.range(4000).withColumn("size", F.lit(10).cast("bigint"))
    out = sharding.shard_rows(rows, F.lit(5), F.col("size"), shards=5)
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [800] * 5


def test_few_and_no_rows(spark):
    docs = documents(spark, [(1, "a"), (2, "b")])
    assert {(r["doc_id"], r["slot"]) for r in sharding.shard_documents(docs).collect()} == {(1, 0), (2, 0)}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(4000)]
    listed = set(random.Random(3).sample(keys, 700))
    frame = lambda some: spark.createDataFrame([(k,) for k in some], "key string")
    member = urls.cascade(frame([*listed, *list(listed)[:5]]), frame(keys))
    out = frame(keys).select("key", member(F.col("key"))).collect()
    assert {k for k, yes in out if yes} == listed
    assert not urls.cascade(frame([]), frame(keys))(F.lit("k1")) is None
    assert frame(keys).filter(urls.cascade(frame([]), frame(keys))(F.col("key"))).count() == 0


def test_levels_of_a_cascade_shrink(spark, monkeypatch):
    """A filter of few keys over many others leaves about as few of them to the next."""
    sizes, plain = [], urls.filter_bits
    monkeypatch.setattr(urls, "filter_bits", lambda a, b: sizes.append((a, b)) or plain(a, b))
    keys = spark.range(300_000).selectExpr("concat('k', id) AS key")
    member = urls.cascade(keys.limit(3), keys)
    assert keys.filter(member(F.col("key"))).count() == 3
    assert sizes[0] == (3, 299_997) and all(a <= 10 for a, _ in sizes)
    assert plain(3, 10**10) <= 2048 and plain(700, 3300) == 8192 and plain(0, 0) == 64


@pytest.mark.parametrize("rows", [[("http://a.example.com/en/" + "x/" * 100_000, "block")] * 3 + [("http://com/" + "é" * 9, "allow")]])
def test_long_and_repeated_urls(spark, rows):
    pages = spark.createDataFrame([(1, u) for u, _ in rows], "page_id bigint, url string")
    judged = urls.filter_urls(pages, queries.URL_RULES).select("page.page_id", "verdict", "host").collect()
    assert sorted(r["verdict"] for r in judged) == sorted(v for _, v in rows) and len(judged) == len(rows)


URLS = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no scheme/en/": ("", "", None, "allow"),
    "http://A.Example.COM/en/1?x=/es/": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://m.www.example.com/en/x#y": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "x://net/es/a://b": ("net", "/es/a://b", "net/es/", "block"),
    "http://a.net/fr": ("a.net", "/fr", None, "allow"),
    "http://a.net?/fr/": ("a.net", "", None, "allow"),
    "http://a.org/en/": ("a.org", "/en/", None, "allow"),
    "http:///es/": ("", "/es/", None, "allow"),
}


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    out = urls.filter_urls(pages, queries.URL_RULES).select("page.page_id", "host", "path", "rule", "verdict")
    assert [tuple(r[1:]) for r in sorted(out.collect())] == list(URLS.values())
    assert urls.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


SECRETS = [
    "", None, "password=hunter2x", 'Token : "abcdef" and secret=ab', "secret:token:abcdefg", "API_KEY='a1b2c3d4'",
    "AKIA" + "A" * 15, "xAKIA" + "B" * 16 + "c", "AKIAAKIA" + "Z9" * 9, "deadbeef" * 3, "deadbeef" * 3 + "g" + "0" * 23,
    "é" * 50 + " token=abcdefgh " + "0a" * 12, "passwd\u00a0= abcdefg", "apikey:=x", "TOKEN=abcdef" * 3, "a" * 30_000,
]


def plain_spans(text):
    spans = []
    for order, (kind, pattern, group, least) in enumerate(secrets.BASE):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(group)) >= least:
                spans.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def test_base_secrets(spark):
    rows = documents(spark, list(enumerate(SECRETS))).withColumn("hex", F.lit("clash"))
    found = secrets.scan_secrets(rows).select("doc_id", secrets.span_digest("assign", "access", "hex").alias("d"))
    out = {r["doc_id"]: r["d"] for r in found.collect()}
    assert out == {i: ",".join(plain_spans(t)) for i, t in enumerate(SECRETS)}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
    assert secrets.scan_secrets(rows.limit(0)).count() == 0


def test_entropy_spans(spark):
    texts = {
        "the key is tZ8qL0vR3xW7nB5mK2pJ9dF4 here": "entropy:11:35",
        "a perfectly ordinary counterrevolutionaryism": "",
        "id 123e4567-e89b-12d3-a456-426614174000 is a uuid": "",
        "0123456789abcdef0123456789abcdef": "",
        "my EXAMPLE1tZ8qL0vR3xW7nB5mK2pJ9dF4": "",
        "f3a91c07e5d28b46f0c1 in hex": "entropy:0:20",
    }
    rows = documents(spark, list(enumerate(texts)))
    found = secrets.scan_secrets(rows).select("doc_id", secrets.span_digest("entropy").alias("d"))
    assert {r["doc_id"]: r["d"] for r in found.collect()} == dict(enumerate(texts.values()))


def test_hex_beside_marks(spark):
    """Capital, mixed and short small hex after and before the marks of assignments and paths."""
    keys = ("F3A91C07E5D28B46F0C1", "f3A91c07E5d28B46f0C1A9B8", "f3a91c07e5d28b46f0c1")
    texts = [(f"see {a}{key}{b} here", 4 + len(a), len(key)) for key in keys
             for a, b in (("=", ""), ("/", ""), ("-", ""), ("_", ""), ("+", ""), ("KEY=", ""), ("DB_KEY=", ""), ("a/", "/b"), ("", "="))]
    rows = documents(spark, [(i, t) for i, (t, _, _) in enumerate(texts)] + [(99, "z" + keys[2]), (98, keys[2] + "Z")])
    found = secrets.scan_secrets(rows).select("doc_id", secrets.ENTROPY).collect()
    out = {i: {(h["start"], h["end"]) for h in hits} for i, hits in found}
    for i, (_, start, n) in enumerate(texts):
        assert (start, start + n) in out[i], (texts[i], out[i])
    assert all((k, k + 20) not in out[i] for i, k in ((99, 1), (98, 0)))


def test_window_entropy_against_recount(spark):
    import math

    pick, alphabet = random.Random(4), "0123456789abcdef"
    values = ["".join(pick.choice(alphabet[: pick.choice([3, 16])]) for _ in range(40)) for _ in range(30)]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    out = frame.select("v", secrets.high_entropy(F.col("v"), alphabet, 3.3, 20).alias("h")).collect()
    for v, (first, last) in out:
        high = []
        for i in range(21):
            counts = Counter(v[i : i + 20]).values()
            if -sum(c / 20 * math.log2(c / 20) for c in counts) >= 3.3:
                high.append(i)
        assert (first, last) == ((high[0], high[-1] + 20) if high else (-1, -1))


LICENCES = {
    "Some text.\nLicensed under the Apache License, Version 2.0.\nMore": ["Apache 2.0"],
    "Released under the MIT License. All rights reserved.": ["MIT", "AllRightsReserved"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL 3"],
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.": ["CC-BY-NC 4.0"],
    "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."
    " You may obtain a copy of the License at\nhttp://x\nUnless required by applicable law or agreed to in writing,"
    " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS"
    " OF ANY KIND, either express or implied.": ["Apache 2.0"],
    "The license plate was blue. Rights were discussed.": [],
    "": [],
    None: [],
}


def test_licences(spark):
    rows = documents(spark, list(enumerate(LICENCES))).withColumn("licenses", F.lit(1))
    out = licenses.scan_licenses(rows)
    assert {r["doc_id"]: r["licenses"] for r in out.collect()} == dict(enumerate(LICENCES.values()))
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2011, Some Name, Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


def test_real_licence_texts(spark):
    """Unmodified and wrapped, in comments, on one line, after a title."""
    bsd2 = BSD.split("\n\n3.")[0]
    full = ["ApacheUnder 2.0", "ApacheMayNot", "ApacheObtain", "ApacheAsIs"]
    texts = {
        APACHE: (["Apache 2.0"], full), commented(APACHE, "#"): (["Apache 2.0"], full),
        commented(APACHE, " *").replace("\n", "\r\n"): (["Apache 2.0"], full),
        " ".join(APACHE.split()): (["Apache 2.0"], full), "My project\n" + APACHE: (["Apache 2.0"], full),
        MIT: (["MIT"], ["MitGrant", "AsIs"]), commented(MIT, "//"): (["MIT"], ["MitGrant", "AsIs"]),
        BSD: (["BSD-3-Clause", "AllRightsReserved"], None), commented(BSD, "dnl"): (["BSD-3-Clause", "AllRightsReserved"], None),
        BSD.replace("the copyright holder", "Some Name, Inc."): (["BSD-3-Clause", "AllRightsReserved"], None),
        bsd2: (["BSD-2-Clause", "AllRightsReserved"], None),
        GPL: (["GPL 3"], ["GplUnder 3", "GplNoWarranty"]), commented(GPL, ";;"): (["GPL 3"], ["GplUnder 3", "GplNoWarranty"]),
        GPL.replace("This program", "Some tool"): (["GPL 3"], ["GplUnder 3", "GplNoWarranty"]),
        MPL: (["MPL 2.0"], ["MplUnder 2.0"]),
        "A title\nReleased under the MIT License\nno stop anywhere": (["MIT"], ["MitUnder"]),
        "This is not something licensed under the MIT License": ([], []),
    }
    out = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    for i, (names, ids) in enumerate(texts.values()):
        assert out[i]["licenses"] == names and ids in (None, out[i]["sentences"]), (i, out[i])


LOST = {
    "sample_key=tZ8qL0vR3xW7nB5mK2pJ9dF4": (11, 35),
    "see /examples/hook/tZ8qL0vR3xW7nB5mK2pJ9dF4 there": (19, 43),
    "the key tZqLvRxWnBmKpJdFgHsQyCaE": (8, 32),
    "key=QWRKZPLM4TXVNBHJ7CDGFSY": (4, 27),
    "International/BusinessMachines/CorporationLimited and CounterRevolutionaryIsm": None,
    "a/sample/of/" + "abc" * 12: None,
}


def test_values_beside_suppressed_names(spark):
    """The value of an assignment or path is found though a name beside it is on the allow-list."""
    rows = documents(spark, list(enumerate(LOST)))
    found = secrets.scan_secrets(rows).select("doc_id", secrets.ENTROPY).collect()
    for doc_id, hits in found:
        text, span = list(LOST.items())[doc_id]
        assert any(h["start"] <= span[0] + 4 and h["end"] >= span[1] - 4 for h in hits) if span else not hits, (text, hits)
        for h in hits:
            assert text[h["start"] : h["end"]] == h["value"]


def test_many_and_long_candidates(spark):
    """Time grows with the text: very many hits, and one very long run."""
    import math
    import time

    pick = random.Random(6)
    key = lambda n, alphabet: "".join(pick.choice(alphabet) for _ in range(n))
    words = [key(32, "0123456789abcdef") for _ in range(2000)]
    run = key(200_000, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    small = documents(spark, [(0, " ".join(words[:10]))])
    secrets.scan_secrets(small).collect()  # warm
    bits = lambda w: -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
    high = {i for i, w in enumerate(words) if any(bits(w[k : k + 20]) >= 3 for k in range(13))}
    for text, every, want in ((" ".join(words), 33, high), (run, len(run), {0})):
        start = time.perf_counter()
        out = secrets.scan_secrets(documents(spark, [(0, text)])).first()
        assert time.perf_counter() - start < 10
        assert {h["start"] // every for h in out[secrets.ENTROPY]} == want
        for hits in (out[secrets.ENTROPY], out["hex"]):
            assert all(text[h["start"] : h["end"]] == h["value"] for h in hits)
    assert [h["start"] for h in secrets.scan_secrets(documents(spark, [(0, " ".join(words))])).first()["hex"]] == [33 * i for i in range(2000)]


def test_licences_against_plain_rules(spark):
    """Texts made of known and other sentences, wrapped, in comments, in other letters."""
    pick = random.Random(4)
    known = [(name, sentence) for name, every in licenses.SENTENCES for sentence in every]
    texts, want = [], []
    for i in range(300):
        mark, parts, ids = pick.choice(["", "# ", "// ", " * "]), [], []
        chosen = pick.choice(licenses.RULES)[1] if i % 2 else ()
        for name, sentence in [(n, pick.choice([s for m, s in known if m == n])) for n in chosen] + pick.choices(known, k=i % 4):
            version = pick.choice(["2.0", "3", "1.1"])
            words = [version if w == "#" else "Some-tool" if w == "*" else w for w in sentence.split()]
            text = words[0] + "".join(pick.choice([" ", " ", " ", "\n" + mark]) + w for w in words[1:])
            parts.append(pick.choice([text, text.capitalize(), text.upper()]))
            ids.append(f"{name} {version}" if "#" in sentence else name)
            if pick.random() < 0.3:
                parts.append(pick.choice(["Nobody said that the license was lost", "other words", "MIT", "Copyright law is old"]))
        texts.append("".join(mark + p + pick.choice([".\n", "\n" + mark + "\n", "!\n"]) for p in parts))
        want.append((ids, licences(ids, licenses.RULES)))
    out = licenses.scan_licenses(documents(spark, list(enumerate(texts)))).collect()
    for r in out:
        assert (r["sentences"], r["licenses"]) == want[r["doc_id"]], r["text"]


def test_more_licences(spark):
    """Lines of identifiers, lesser and affero, public domain, Creative Commons written out; long and repeated texts."""
    lesser = GPL.replace("GNU General", "GNU Lesser General").replace("This program", "This library")
    texts = {
        "// SPDX-License-Identifier: MIT\ncode": ["MIT"],
        "# SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-or-later 3.0"],
        "/* SPDX-License-Identifier: Apache-2.0 */": ["Apache 2.0"],
        "SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"],
        lesser: ["LGPL 3"], commented(lesser, "--"): ["LGPL 3"], GPL.replace("GNU General", "GNU Affero General"): ["AGPL 3"],
        "This is free and unencumbered software released into the public domain.": ["Unlicense"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA 4.0"],
        "Distributed under the Boost Software License, Version 1.0. (See file)": ["BSL 1.0"],
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.": ["0BSD"],
        "A song in the public domain, they say.": [],
        "word " * 60_000 + "\n" + APACHE + "\n" + "licence " * 30_000: ["Apache 2.0"],
    }
    rows = list(enumerate(texts)) * 2
    out = licenses.scan_licenses(documents(spark, rows)).collect()
    assert len(out) == len(rows) and all(r["licenses"] == list(texts.values())[r["doc_id"]] for r in out), [
        (r["doc_id"], r["licenses"]) for r in out
    ]
