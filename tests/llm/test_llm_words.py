"""Spelling variants, ranked search and token counts against plain versions and on edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillbook.llm import arrow_text, queries, search, spelling, tokens

import brute
from brute import documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def misspelt(pick, n):
    """Texts of words and their variants, some much more frequent than others, of many lengths."""
    parts = ["an", "er", "tion", "é", "ÿ", "Th", "öß", "x", "st", "×"]
    roots = ["".join(pick.choice(parts) for _ in range(pick.randrange(2, 9))) for _ in range(60)]
    roots += ["aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaa", "abababab", "babababa", "l" * 300]

    def word():
        w = roots[int(len(roots) * pick.random() ** 3)]
        if pick.random() < 0.1:
            i = pick.randrange(len(w))
            w = pick.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "z" + w[i + 1 :]])
        return w

    return [pick.choice([" ", "-", "1", "\n"]).join(word() for _ in range(pick.randrange(1, 60))) for _ in range(n)]


def spelling_rows(df):
    return {r["word"]: (r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("packed, block, least", [(192, 512, 7), (30, 7, 7), (5, 2, 3)])
def test_spelling_variants_against_all_edits(spark, monkeypatch, packed, block, least):
    monkeypatch.setattr(spelling, "PACKED", packed)
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = list(enumerate(misspelt(random.Random(11), 200)))
    rows += [(None, "abababab tiontionan"), (5, None), (6, ""), (7, rows[7][1]), (7, rows[7][1]), (8, "abababab " * 3000)]
    docs = documents(spark, rows).withColumns({"word": F.lit("w"), "n": F.lit(1), "base": F.lit(2), "form": F.lit("f")})
    out = spelling.spelling_variants(docs, least=least)
    want = brute.spelling(brute.spelling_counts(rows, least=least))
    assert spelling_rows(out) == want
    assert sum(v[1] is not None for v in want.values()) > 30


def test_roots_at_the_end_of_long_paths(spark):
    chain = ["paaaaaa" + "b" * i for i in range(6)]
    counts = [2 * 3**i for i in range(6)]
    counts = list(zip(chain, counts))
    rows = [(100 * i + j, w) for i, (w, n) in enumerate(counts) for j in range(n)]
    got = spelling_rows(spelling.spelling_variants(documents(spark, rows), times=2))
    assert got == brute.spelling(brute.spelling_counts(rows), times=2)
    assert max(len(v[4]) - len(w) for w, v in got.items()) >= 4


def test_spelling_of_a_table_against_all_edits(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.all_queries()["op11_spelling"](spark, data)
    assert out.dtypes == [
        ("word", "string"), ("n", "bigint"), ("form", "string"), ("form_n", "bigint"), ("n_near", "bigint"), ("root", "string"),
    ]
    assert spelling_rows(out) == brute.spelling(brute.spelling_counts(rows))
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    assert spelling.spelling_variants(empty).count() == 0


def search_case():
    pick = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "ab1", "ABC", "中文"]
    text = lambda most: " ,.\n"[pick.randrange(4)].join(
        vocabulary[int(len(vocabulary) * pick.random() ** 2)] for _ in range(pick.randrange(0, most))
    )
    docs = [(i, text(60)) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "?! --"), (7, docs[7][1]), (None, docs[9][1]), (None, docs[9][1]), (400, "W1 " * 9000)]
    docs += [(500 + i, "same words w1 w2") for i in range(40)]
    items = [(i, text(25)) for i in range(12)] + [(12, None), (13, ""), (3, "w39 extra"), (None, "w1 w2"), (14, "unknown only"), (15, "w1 same")]
    return docs, items


@pytest.mark.parametrize("block, k, run", [(1_000_000, 10, 50), (60, 3, 2), (1, 1, 50)])
def test_search_against_all_scores(spark, monkeypatch, block, k, run):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search.blocks, "__defaults__", (block,))
    monkeypatch.setattr(search, "RUN", run)
    if run == 2:
        monkeypatch.setattr(search, "GROUP_ITEMS", 5)
    docs, items = search_case()
    table = documents(spark, docs).withColumns({"item": F.lit(1), "n": F.lit(2), "term": F.lit("t"), "rank": F.lit(3)})
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    out = [tuple(r) for r in search.search(table.repartition(3), asked, k).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(out, key=order) == sorted(brute.search(docs, items, k), key=order)


def test_search_of_empty_tables(spark):
    docs, items = search_case()
    table = documents(spark, docs)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert search.search(table.limit(0), asked).count() == 0
    assert search.search(table, asked.limit(0)).count() == 0
    assert search.search(table, asked.limit(0)).columns == search.search(table, asked).columns


def test_accumulators_stop_and_nothing_is_lost():
    """The bounds stop new accumulators early, and what remains is scored exactly."""
    pick = np.random.default_rng(13)
    docs = 4000
    held = [np.sort(pick.choice(docs, size, replace=False)) for size in (3, 8, 30, 900, 2500, 4000)]
    weights = np.array([9000, 8000, 6000, 900, 300, 5])
    terms = np.concatenate([np.full(len(h), t) for t, h in enumerate(held)])
    doc = np.concatenate(held)
    order = np.lexsort((terms, doc))
    n = np.full(docs, 100)
    tfs = pick.integers(1, 5, len(terms))
    lists = search.block_lists(n, np.bincount(doc, minlength=docs), terms[order], tfs[order], weights, docs, docs * 100)
    item = np.arange(6)
    found, scores = search.best_of_block(lists, docs, item, 10, 0)
    full = np.zeros(docs, np.int64)
    np.add.at(full, lists.docs, lists.scores)
    assert len(found) < 100 and (scores == full[found]).all()
    best = np.lexsort((np.arange(docs), -full))[:10]
    assert set(best) <= set(found)
    again, _ = search.best_of_block(lists, docs, item, 10, int(full[best[9]]))
    assert set(best) <= set(again) and len(again) <= len(found)


def hard_texts(n):
    pick = random.Random(14)
    bits = [
        "a", "B", "é", " ", "  ", "\n", "'s", "'t", "'", "5", "12", ".", "!!", "<|endoftext|>", " ", "　", "中", "\t", " x", " é",
        "ж", " ж", "\u0085", "٣", "😀", " 😀", "ñ", "\x00", "|", " |", "x|", "×", "a×", "é", "​", "don't", "<|", "endoftext", "|>",
    ]
    return ["".join(pick.choice(bits) for _ in range(pick.randrange(0, 40))) for _ in range(n)]


def plain_counts(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_are_those_of_the_library(spark):
    texts = [*hard_texts(3000), None, "", " ", "word " * 40_000, "Zm9v0YmFy" * 9000, "x" * 20_000, "中" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "a b")]
    docs = documents(spark, rows).withColumns({"n_tokens": F.lit("clash"), "n_bytes": F.lit(None), "definition": F.lit(1)})
    out = tokens.token_report(docs, PATH, 512).collect()
    want = dict(enumerate(plain_counts(texts)))
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            text = (texts[r["doc_id"]] or "").encode()
            assert (r["n_tokens"], r["n_bytes"]) == (want[r["doc_id"]], len(text)), text[:80]
        assert r["over_limit"] == (r["n_tokens"] > 512)
    assert tokens.token_report(docs.limit(0), PATH, 512).count() == 0
    kept = tokens.count_tokens(docs, PATH)
    assert kept.columns == docs.columns and dict(kept.dtypes)["n_tokens"] == "bigint"


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_tokens_of_parts_add_up(monkeypatch, most):
    """Cutting at every safe place, and forgetting pieces again and again, changes no count."""
    monkeypatch.setattr(tokens, "REMEMBERED", 200)
    monkeypatch.setattr(tokens, "CALL", 16)
    monkeypatch.setattr(tokens, "text_parts", lambda texts, places: arrow_text.text_parts(texts, places, most))
    texts = [*hard_texts(400), None, "", "word 12 " * 50]
    lengths = tokens.Lengths(tokens.json_encoder(open(PATH).read()))
    assert tokens.counts_of(pa.array(texts), lengths).tolist() == plain_counts(texts)


def test_token_report_of_a_table(spark, data):
    out = {r["doc_id"]: r for r in queries.all_queries()["op13_token_counts"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    for r, n in zip(rows, plain_counts([r["text"] for r in rows])):
        assert out[r["doc_id"]]["n_tokens"] == n and out[r["doc_id"]]["over_limit"] == (n > 512)


def test_definitions_that_cutting_would_change_are_refused():
    import json

    found = json.load(open(PATH))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            tokens.check_definition(json.dumps(found | change))
    found["added_tokens"][0]["content"] = "<two words>"
    with pytest.raises(ValueError):
        tokens.check_definition(json.dumps(found))
