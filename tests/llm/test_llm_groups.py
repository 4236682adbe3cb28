"""Similarity joins, decontamination, the two learned scores and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillbook.llm import common, decontaminate, embeddings, jaccard, quality, shingles, toxicity
from tillbook.sources import write_and_read

from brute import DOCS, documents, jaccard_roots, leaks, roots, template_tokens, words


def test_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(1, 1)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 3000 + i) for i in range(50)]
    out = dict(map(tuple, common.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()))
    names = sorted({n for e in edges for n in e})
    at, pairs = {n: i for i, n in enumerate(names)}, {tuple(sorted(e)) for e in edges}
    want = roots(len(names), lambda a, b: tuple(sorted((names[a], names[b]))) in pairs)
    lone = {n for e in edges if e[0] == e[1] for n in e} - {n for e in edges if e[0] != e[1] for n in e}
    assert out == {n: names[want[at[n]]] for n in names if n not in lone}


def test_shingle_sets_are_those_of_the_words():
    import pyarrow as pa

    texts = [
        "", None, "a", "A b", "a  b\tc", "x y z w", "x y z w x y z w", "ÀB é c \x1c d\x0be f", "w " * 3000, "b a",
        "Q" * 5000 + " a b c d",
    ]
    sets = list(shingles.text_sets(pa.array(texts), 4))
    for text, found in zip(texts, sets):
        w = words(text)
        plain = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
        assert len(found) == len(plain) and (np.diff(found.astype(object)) > 0).all()
    assert set(sets[5]) == set(next(shingles.text_sets(pa.array(["X  Y\nz W"]), 4)))
    assert set(sets[3]) != set(sets[9])


def near_copies(seed, n=260):
    """Groups of near copies of many sizes, exact copies, a passage that many texts share, tiny texts."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    texts = []
    while len(texts) < n:
        size = pick.choice([3, 5, 8, 30, 100, 300])
        base = [word() for _ in range(size)]
        for _ in range(pick.choice([1, 1, 2, 5, 20])):
            copy = list(base)
            for _ in range(pick.randrange(0, max(2, size // 25))):
                copy[pick.randrange(size)] = word()
            text = " ".join(copy)
            texts.append(text + " " + passage if pick.random() < 0.3 else text)
        texts.append(texts[-1].upper())
    return [*texts[:n], None, "", "   ", "a b", "A  b", "a b c"]


@pytest.mark.parametrize("width, percent, block", [(4, 85, 192), (5, 80, 16)])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # small blocks: groups are divided
    texts = near_copies(6)
    docs = documents(spark, list(enumerate(texts)))
    out = {r["doc_id"]: r for r in jaccard.linked_documents(docs, width, percent).collect()}
    want, sizes = jaccard_roots(texts, width, percent)
    assert [out[i]["component_id"] for i in range(len(texts))] == want
    assert [out[i]["n_shingles"] for i in range(len(texts))] == sizes
    kept = jaccard.keep_first(docs.withColumns({"_id": F.lit(1), "row": F.lit(2)}), width, percent)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_blocks_of_distant_grades_are_skipped(spark):
    """Every pair of neighbouring grades meets once; larger groups deal no block to one two grades away."""
    pick = random.Random(12)
    rows = [(g, 1000 * g + i, pick.choice([0, 0, 0, 1, 2, 3, 7])) for g, n in enumerate([1, 2, 9, 60, 200]) for i in range(n)]
    members = write_and_read(spark.createDataFrame(rows, "g bigint, number bigint, size bigint"))

    def meet(left, right, same):
        pairs = left[["g", "number"]].merge(right[["g", "number"]], on="g", suffixes=("", "2"))
        pairs = pairs[pairs.number < pairs.number2] if same else pairs
        return pd.DataFrame({"x": pairs[["number", "number2"]].min(axis=1), "y": pairs[["number", "number2"]].max(axis=1)})

    for grade, most in [(F.col("size"), 10), (None, 10), (F.col("size"), 500)]:
        out = common.deal_blocks(members, "g", "number", most, meet, "x bigint, y bigint", grade=grade).collect()
        out = [tuple(r) for r in out]
        want = {
            (a, b)
            for g, a, s in rows for h, b, t in rows
            if g == h and a < b and (grade is None or abs(s - t) <= 1 or sum(r[0] == g for r in rows) <= most)
        }
        assert len(out) == len(set(out)) and set(out) == want


def test_answers_from_the_set_before():
    pick = np.random.default_rng(7)
    base = np.unique(pick.integers(0, 1 << 40, 80))
    vary = lambda: np.unique(np.concatenate([pick.choice(base, 70, replace=False), pick.integers(0, 1 << 40, 5)]))
    left, right = [vary() for _ in range(30)], [vary() for _ in range(20)] + [np.empty(0, np.int64)]
    plain = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert (jaccard.overlaps(left, right) == plain).all()


def test_repeated_and_null_ids(spark):
    a, b, c = "one two three four five six", "other words in a second text here", "third text of some more words"
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, a), (3, None), (3, None), (4, "")]
    docs = documents(spark, rows)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in jaccard.keep_first(docs).collect())
    assert kept == sorted([(1, a), (1, b), (0, c), (3, ""), (3, ""), (4, "")])
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def test_lattice_decoding_is_nearest():
    points = np.random.default_rng(8).normal(0, 2, (500, 8))
    found = embeddings.nearest_e8(points) / 2
    assert ((found * 2 % 2 == (found * 2 % 2)[:, :1]).all(1)).all() and (found.sum(1) % 2 == 0).all()
    near = ((points - found) ** 2).sum(1)
    for v in embeddings.NEIGHBOURS:
        assert (near <= ((points - found - v) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("block", [128, 8])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    pick = np.random.default_rng(9)
    base = pick.normal(size=(60, 32))
    made = [base[i % 60] + pick.normal(0, 0.06, 32) for i in range(400)] + [base[0]] * 30
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(made)]
    n = len(rows)
    rows += [
        (n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [1.0] * 31 + [None], 1), (n + 3, [1.0] * 31 + [float("inf")], 1),
        (n + 4, base[0].tolist(), None), (n + 5, [], 1), (n + 6, (base[0] * 3).tolist(), 0), (n + 7, [1.0, 0.0], 1),
    ]
    schema = "vec_id bigint, embedding array<double>, label int"
    out = {r["vec_id"]: r for r in embeddings.link_vectors(spark.createDataFrame(rows, schema)).collect()}
    usable = {i: embeddings.unit_vector(v, x) for i, v, x in rows}

    def linked(a, b):
        u, v = usable[a], usable[b]
        return u is not None and v is not None and len(u) == len(v) and rows[a][2] == rows[b][2] and u @ v >= 0.98

    links = [sum(linked(a, b) for b in range(len(rows)) if a != b) for a in range(len(rows))]
    found = [out[i]["n_links"] for i in range(len(rows))]
    assert all(f <= w for f, w in zip(found, links))  # none below the threshold
    assert sum(found) >= 0.97 * sum(links) > 1000
    want = roots(len(rows), linked)
    same = [out[i]["component_id"] == want[i] for i in range(len(rows))]
    assert sum(same) >= 0.95 * len(rows) and all(same[n : n + 6])
    assert all(r["kept"] == (r["component_id"] == i) for i, r in out.items())
    assert embeddings.link_vectors(spark.createDataFrame([], schema)).count() == 0


def test_recall_in_large_labels(spark, monkeypatch):
    """Pairs just above the threshold in a label of 12,000 vectors of 64 numbers: at least 0.97 are found, and not
    many more pairs are compared than cells hold."""
    pick = np.random.default_rng(15)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(pick.normal(size=(11_400, 64)))
    aside = unit(pick.normal(size=(600, 64)))
    aside = unit(aside - (aside * base[:600]).sum(1, keepdims=True) * base[:600])
    cosine = pick.uniform(0.98, 0.985, (600, 1)) + 1e-9
    near = cosine * base[:600] + np.sqrt(1 - cosine**2) * aside
    made = np.vstack([base, near])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(made)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    sizes = []
    real = embeddings.deal_blocks

    def counted(members, group, *rest):
        sizes.append(members.groupBy("cell").count().selectExpr("sum(count * (count - 1)) / 2 as pairs").first()[0])
        return real(members, group, *rest)

    monkeypatch.setattr(embeddings, "deal_blocks", counted)
    out = {r["vec_id"]: r for r in embeddings.link_vectors(vectors).collect()}
    cosines = (made[:600] * near).sum(1)
    assert (cosines >= 0.98).all()
    found = sum(out[11_400 + i]["component_id"] == i for i in range(600))
    assert found >= 0.97 * 600
    links = (made @ made.T >= 0.98).sum(1) - 1
    assert all(out[i]["n_links"] <= links[i] for i in range(len(made)))
    assert sizes[0] < 200_000  # of 72 million


def test_pairs_count_in_the_first_cell_they_share():
    pick = np.random.default_rng(16)
    lists = [np.sort(pick.choice(12, pick.integers(1, 7), replace=False)) for _ in range(60)]
    table = embeddings._padded(pd.Series(lists))
    i, j = np.nonzero(np.ones((60, 60)))
    total = np.zeros(len(i), int)
    for cell in range(12):
        held = np.array([cell in x for x in lists])
        both = held[i] & held[j]
        total[both] += embeddings.first_shared(table[i[both]], table[j[both]], np.full(both.sum(), cell), most=500)
    assert (total == [bool(set(lists[a]) & set(lists[b])) for a, b in zip(i, j)]).all()


@pytest.mark.parametrize("kind, labels", [("int", [-1, -2, -1]), ("bigint", [2**60, 2**60 + 1, 2**60]), ("string", ["a", "b", "a"])])
def test_labels_that_look_alike_are_kept_apart(spark, kind, labels):
    rows = [(i, [1.0, 2.0, 3.0], x) for i, x in enumerate([*labels, None])]
    vectors = spark.createDataFrame(rows, f"vec_id bigint, embedding array<double>, label {kind}")
    found = {r["vec_id"]: r["component_id"] for r in embeddings.link_vectors(vectors).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3}


ITEM = "A train leaves the station at 60 km per hour while Anna waits 25 minutes, then Anna drives 60 km home alone"
LEAKS = {
    1: ("intro words here. " + ITEM + " and more follows", True),
    2: ("so: " + ITEM.replace("60", "75").replace("25", "9").replace("Anna", "Peter").lower().replace("peter", "Peter"), False),
    3: ("so: " + ITEM.replace("60 km per", "75 km per").replace("25", "9"), None),  # 60 is both 75 and 60
    4: ("nothing of the kind is in this text at all, it is clean", None),
    5: (" ".join(f"w{i}x" for i in "abcdefgh") + " " + " ".join(ITEM.split()[:6]), None),
    6: ("", None),
    7: (None, None),
    8: ("word " * 5000 + ITEM, True),
}


def test_leaks(spark):
    docs = documents(spark, [(i, t) for i, (t, _) in LEAKS.items()] + [(1, LEAKS[1][0]), (None, LEAKS[1][0])])
    docs = docs.withColumns({"_id": F.lit(0), "item_id": F.lit(0)})
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM), (4, ITEM)], "item_id bigint, text string")
    out = decontaminate.find_leaks(docs, items)
    exact = {(r["doc_id"], r["item_id"]): r["exact"] for r in out.collect()}
    want = {(i, k): e for i, (_, e) in LEAKS.items() for k in (1, 4) if e is not None}
    assert exact == want | {(None, 1): True, (None, 4): True}
    clean = decontaminate.drop_leaks(docs, items)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6, 7] and clean.columns == docs.columns
    assert decontaminate.drop_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == docs.count()


def test_leaks_at_every_offset(spark):
    """Items of one to nine tokens, and two thirds of one of nine, behind any number of other words."""
    asked = "what is the capital of france and of spain".split()
    items = spark.createDataFrame([(n, " ".join(asked[:n])) for n in (3, 4, 5, 6, 8, 9)], "item_id bigint, text string")
    rows = [(100 * n + k, " ".join(["so"] * k + asked[:n] + ["and then some"])) for n in (3, 4, 5, 6, 8, 9) for k in range(7)]
    rows += [(1000 + k, " ".join(["so"] * k + asked[1:8] + ["then"])) for k in range(7)] + [(2000, "what is the"), (2001, "is the capital")]
    out = decontaminate.find_leaks(documents(spark, rows), items).select("doc_id", "item_id").collect()
    for n in (3, 4, 5, 6, 8, 9):
        assert {i for i, m in out if m == n} >= {100 * n + k for k in range(7)}, n
    assert {i for i, m in out if m == 9} >= {1000 + k for k in range(7)}
    assert {m for i, m in out if i == 2000} == {3} and not [m for i, m in out if i == 2001]


def test_leaks_against_a_plain_version(spark):
    """Items of a few templates, set into other words: as they are, with other values, in title case, cut."""
    pick = random.Random(21)
    plain = "the a road to old town is open again after rain but closed by night".split()
    names, items, rows = ["Anna", "Peter", "Maria", "Olga"], [], []
    for i in range(24):
        text = " ".join(pick.choices(plain, k=3)) if i % 8 == 7 else (
            f"On day {i % 3} driver {names[i % 4]} took {i % 5} kg of sand for {i % 7} miles and {names[i % 3]} paid {i % 4} euros"
        )
        items.append((i, text))
    for i in range(160):
        text = pick.choice(items)[1]
        change = i % 8
        if change == 1:
            text = text.title()
        elif change == 2:
            text = "".join(str(pick.randrange(9)) if c.isdigit() else c for c in text)
        elif change == 3:
            text = " ".join(text.split()[: pick.randrange(2, 15)])
        elif change == 4:
            text = text.upper() if i % 16 == 4 else text.lower()
        elif change == 5:
            text = text.replace("3", "4").replace("Anna", "Olga")
        around = [" ".join(pick.choices(plain + names, k=pick.randrange(12))) for _ in range(2)]
        rows.append((i, pick.choice([" ", ". "]).join([around[0], text, around[1]]) if change != 7 else " ".join(pick.choices(plain, k=40))))
    rows += [(1000, None), (1001, ""), (1002, "Of Km 5 Km A Road " * 700)]
    out = decontaminate.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_shared"], r["exact"]) for r in out.collect()}
    want = leaks(rows, items)
    assert found == want and len(want) > 300


def test_two_values_may_become_one_and_titles_have_no_names(spark):
    item = "Tom has 3 red apples and 5 green pears, how many fruits has Tom now if he eats 2 of them"
    rows = [(1, "so " + item.replace("5", "4").replace("3", "4")), (2, "Here Is One. " + item.title() + "."), (3, item.replace("3", "8"))]
    out = decontaminate.find_leaks(documents(spark, rows), spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    assert {(r["doc_id"], r["exact"]) for r in out.collect()} == {(1, False), (2, True), (3, False)}


def test_templates_agree_token_by_token(spark):
    texts = [ITEM, "", None, "1,000.5km x3 #@% Élan vital, Élan", "A 5 Kg bag; b5c é", ITEM.title(), "x " + "Ab, 5 C Dé " * 900]
    docs = documents(spark, list(enumerate(texts)))
    listed = F.array_join(F.transform(decontaminate.tokens(F.col("text")), lambda t: F.concat(t["t"], F.lit(" "))), "")
    for joined, plain in docs.select(listed, decontaminate.template(F.col("text"))).collect():
        assert (joined or " ").strip() == (plain or " ").strip()
    for text, found in docs.select("text", decontaminate.tokens(F.col("text"))).collect():
        assert [tuple(x) for x in found or []] == template_tokens(text)


def _auc(score, label):
    ones, zeros = score[label == 1], score[label == 0]
    return (ones.to_numpy()[:, None] > zeros.to_numpy()[None, :]).mean()


@pytest.fixture(scope="module")
def spoken(spark):
    """Documents of which some hold slurs of an invented language, and labels for most."""
    pick = random.Random(10)
    word = lambda: "".join(pick.choice("bdfglmnr") + pick.choice("aeiou") for _ in range(pick.choice([1, 2, 3])))
    slurs, rows, labels = ["krzat", "krzatik", "vuxul", "qorp"], [], []
    for i in range(700):
        toxic = pick.random() < 0.25
        w = [word() for _ in range(pick.randrange(5, 120))]
        for _ in range(pick.randrange(1, 4) if toxic else 0):
            w.insert(pick.randrange(len(w)), pick.choice(slurs).capitalize() + pick.choice(["", "!", ","]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    schema = "doc_id bigint, quality int, toxic int"
    return documents(spark, rows), spark.createDataFrame(labels, schema)


def test_toxicity_of_unseen_documents(spark, spoken):
    docs, labels = spoken
    model = toxicity.fit_documents(docs, labels)
    out = toxicity.tag_documents(docs.withColumn("score", F.lit("x")), model)
    out = out.select("row.doc_id", "row.text", "score", "spans").toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[[zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]]
    assert _auc(held.score, held.toxic) > 0.97 and ((held.score >= 0.3) == (held.toxic == 1)).mean() > 0.95
    for text, spans in zip(out.text, out.spans):
        assert all(text[s["start"] : s["end"]].lower() in ("krzat", "krzatik", "vuxul", "qorp") for s in spans)
    odd = documents(spark, [(1, None), (2, ""), (3, "ßİ " * 10 + "QORP"), (4, "krzat " * 3000)])
    found = {r["row"]["doc_id"]: r for r in toxicity.tag_documents(odd, model).collect()}
    assert found[1]["score"] == found[2]["score"] < 0.3 and found[1]["spans"] == []
    assert [(s["start"], s["end"]) for s in found[3]["spans"]] == [(30, 34)] and len(found[4]["spans"]) == 3000
    assert toxicity.tag_documents(odd.limit(0), model).count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    model = toxicity.Crf(["a", "b"], np.array([1.2, -0.3]), np.array([-1.0, -0.7, 0.4, 0.2]), np.zeros(3))
    other, c2t, t2c, t2t = model.steps
    for words_, gaps in (([0, 1, 0], [2, 0, 1, 1]), ([1], [0, 3]), ([0, 0], [0, 0, 0])):
        tokens = [None] * gaps[0]
        for w, g in zip(words_, gaps[1:]):
            tokens += [w] + [None] * g
        total, toxic = 0.0, np.zeros(len(tokens))
        for path in itertools.product((0, 1), repeat=len(tokens)):
            score, last = 0.0, 0
            for t, s in zip(tokens, path):
                score += {(0, 0): 0, (0, 1): c2t, (1, 0): t2c, (1, 1): t2t}[last, s]
                score += (other if t is None else model.weights[t]) * s
                last = s
            total += np.exp(score)
            toxic += np.exp(score) * np.array(path)
        chain = toxicity.Chain(words_, [], gaps)
        for _, w, g in toxicity.batches([chain]):
            marginals, logs = model.marginals(w, g)
        want = [toxic[i] / total for i, t in enumerate(tokens) if t is not None]
        assert np.allclose(marginals[0], want) and np.isclose(logs[0], np.log(total))


def test_quality_of_unseen_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_documents(docs, labels)
    assert 0 < len(model.rules) + len(model.linear) < 120
    scored = quality.score_documents(docs, model).select("row.doc_id", "score", quality.held_out(F.col("row.doc_id")).alias("h"))
    out = scored.toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out.h]
    assert _auc(held.score, held.quality) > 0.95 and ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.9
    odd = documents(spark, [(1, None), (2, ""), (3, " \n "), (4, "x" * 200_000)]).withColumn("stats", F.lit(1))
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(odd, model).collect())
    assert quality.keep_good(odd, model).columns == odd.columns


def test_ids_labelled_twice_count_once(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 0, 0), (3, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.training_rows(labels, ~quality.held_out(F.col("doc_id")), "quality", 100)
    assert sorted(map(tuple, rows.filter("doc_id is not null").collect())) == [(1, 1), (2, 0)]


def test_models_without_labels_are_constant(spark):
    docs = documents(spark, [(1, "a b"), (2, "c d")])
    for rows in ([], [(1, 1, None)], [(1, None, 1), (2, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
        scores = {r["score"] for r in quality.score_documents(docs, quality.fit_documents(docs, labels)).collect()}
        tags = {r["score"] for r in toxicity.tag_documents(docs, toxicity.fit_documents(docs, labels)).collect()}
        assert len(scores) == len(tags) == 1


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = write_and_read(stage(spark, docs, data))
        kept.append((name, docs.toPandas()))
    stages = dict(kept)
    labels = pd.read_parquet(f"{data}/labels.parquet")
    assert labels.merge(stages["quality"], on="doc_id").quality.mean() > labels.quality.mean()
    before = stages["quality"].sort_values("doc_id")
    want, _ = jaccard_roots(before.text.tolist(), 5, 80)
    assert sorted(stages["near_duplicates"].doc_id) == sorted(before.doc_id.iloc[sorted(set(want))])
    items = [t.split() for t in pd.read_parquet(f"{data}/benchmark.parquet").text]
    holds = lambda t: any(" ".join(i[1:-1]) in " ".join(t.split()) for i in items)
    assert any(map(holds, stages["near_duplicates"].text)) and not any(map(holds, stages["decontamination"].text))
    mixed, last = stages["mixing"], stages["sharding"]
    assert len(mixed) == len(last) and set(mixed.doc_id) <= set(stages["decontamination"].doc_id)
    assert list(last.columns) == [*mixed.columns, "shard", "slot"]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in last.groupby("shard"))
    assert corpus_pipeline.run(spark, data).count() == len(last)


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_an_entry_may_be_a_token_and_a_beginning():
    """The plain entry is the token itself, the other one stands for longer tokens."""
    automaton = toxicity.automaton_of(["scum", "scum*", "vile", "vil*", "bag*"])
    words = lambda text: [(text[a:b], n) for n, (a, b) in zip(*(lambda c: (c.words, c.spans))(toxicity.chain_of(text, automaton)))]
    assert words("scum scumbags vile viler vil villain bags handbag") == [
        ("scum", 0), ("scumbags", 1), ("vile", 2), ("viler", 3), ("vil", 3), ("villain", 3), ("bags", 4),
    ]
    assert words("handbag") == [] and toxicity.chain_of(None, toxicity.automaton_of([])).words == []


def test_only_small_tables_are_broadcast(spark, monkeypatch):
    hinted = lambda df: "broadcast" in common.small(df)._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in (
        common.small(df)._jdf.queryExecution().analyzed().toString()
    )
    table = spark.range(1000).selectExpr("id", "repeat('x', 100) as text", "array('a', 'b') as many", "cast(null as string) as none")
    assert hinted(table) and hinted(table.limit(0))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000 * 149)  # a row is 24 + 8 + 100 + 18 bytes
    assert not hinted(table) and hinted(table.select("id")) and hinted(table.limit(500))
