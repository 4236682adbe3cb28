"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals give document scores.

Tokens are runs of letters and digits in lower case. Two states, clean and toxic; a token of the lexicon
has a weight of its own in the toxic state, all other tokens share one. Stretches of other tokens are
powers of one 2 x 2 matrix, so that the forward-backward pass is exact and costs a step per lexicon
token instead of one per token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.quality import held_out, training_rows
from tillbook.sources import write_and_read

#: Labelled documents that a model is fitted on at most (expected number; drawn by a hash of the id),
#: and tokens of its lexicon.
MAX_TRAINING_ROWS = 10_000
MAX_LEXICON = 2_000

TOKEN = re.compile(r"[^\W_]+")
NOT_TOKEN = r"[^\p{L}\p{N}]+"


# ---- tokens


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Chain:
    """A text as its lexicon tokens: their numbers and places, and how many other tokens lie before
    each and after the last."""

    words: list[int]
    spans: list[tuple[int, int]]
    gaps: list[int]


def automaton_of(lexicon: list[str]):
    """Finds entries of the lexicon; one that ends in ``*`` stands for all tokens that begin so. An entry may
    occur in both ways: its value is the number of the plain one and that of the other, None for neither."""
    trie = ahocorasick.Automaton()
    entries: dict[str, list[int | None]] = {}
    for number, word in enumerate(lexicon):
        entries.setdefault(word.rstrip("*"), [None, None])[word.endswith("*")] = number
    for plain, (whole, begins) in entries.items():
        trie.add_word(plain, (len(plain), whole, begins))
    if lexicon:
        trie.make_automaton()
    return trie


def chain_of(text: str | None, automaton, always: bool = True) -> Chain:
    """The chain of a whole text; null and empty texts have no tokens. Unless ``always``, the other
    tokens of a text without lexicon tokens are not counted."""
    low = lowered(text or "")
    found: dict[int, tuple[int, int, int]] = {}  # by start: the longest entry
    for last, (size, whole, begins) in automaton.iter(low) if len(automaton) else ():
        start, end = last - size + 1, last + 1
        if start and low[start - 1].isalnum():
            continue
        ended = end == len(low) or not low[end].isalnum()
        number = whole if ended and whole is not None else begins
        if number is None:
            continue
        while end < len(low) and low[end].isalnum():
            end += 1
        # Longer entries are found later and take the place of shorter ones.
        found[start] = (start, end, number)
    hits = list(found.values())
    if not hits and not always:
        return Chain([], [], [0])
    hits.sort()
    begins, ends = [*(h[0] for h in hits), len(low)], [0, *(h[1] for h in hits)]
    gaps = [sum(1 for _ in TOKEN.finditer(low, a, b)) for a, b in zip(ends, begins)]
    return Chain([h[2] for h in hits], [h[:2] for h in hits], gaps)


def batches(chains: list[Chain]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of similar length as ``(rows, words, gaps)``, padded with word -1 and gap 0."""
    lengths = np.array([len(c.words) for c in chains], dtype=int)
    grades = np.ceil(np.log2(lengths + 1)).astype(int)
    for grade in np.unique(grades):
        for rows in np.array_split(np.flatnonzero(grades == grade), max(1, (grades == grade).sum() // 4096)):
            words = np.full((len(rows), lengths[rows].max()), -1)
            gaps = np.zeros((len(rows), words.shape[1] + 1))
            for i, r in enumerate(rows):
                words[i, : lengths[r]] = chains[r].words
                gaps[i, : lengths[r] + 1] = chains[r].gaps
            yield rows, words, gaps


# ---- the field


@dataclass
class Crf:
    """``weights`` of the ``lexicon`` in the toxic state; ``steps`` holds the weight of other tokens
    there and of the transitions clean-toxic, toxic-clean and toxic-toxic; ``link`` maps what
    ``features`` takes from the marginals of a document to its log-odds."""

    lexicon: list[str]
    weights: np.ndarray
    steps: np.ndarray
    link: np.ndarray

    def marginals(self, words: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of the lexicon tokens of padded chains, and their log partition functions."""
        other, c2t, t2c, t2t = self.steps
        step = np.exp([[0.0, c2t], [t2c, t2t]])
        hops, top = _powers(step * np.exp([0.0, other]), gaps)
        live = words >= 0
        emit = np.ones((*words.shape, 2))
        emit[..., 1] = np.exp(np.where(live, self.weights[words], 0.0)) if len(self.weights) else 1.0
        # From one lexicon token to the next: the tokens between, the transition, the emission.
        onto = np.where(live[..., None, None], (hops[:, :-1] @ step) * emit[..., None, :], np.eye(2))
        state, logs = np.tile([1.0, 0.0], (len(words), 1)), gaps.sum(1) * np.log(top)
        forward, backward = np.empty(emit.shape), np.empty(emit.shape)
        for t in range(words.shape[1]):
            state = np.einsum("ni,nij->nj", state, onto[:, t])
            scale = state.sum(1, keepdims=True)
            state, logs = state / scale, logs + np.log(scale[:, 0])
            forward[:, t] = state
        tail = hops[np.arange(len(words)), live.sum(1)].sum(2)
        logs = logs + np.log((state * tail).sum(1))
        message = tail
        for t in reversed(range(words.shape[1])):
            backward[:, t] = message
            message = np.einsum("nij,nj->ni", onto[:, t], message)
            message = message / message.sum(1, keepdims=True)
        both = forward * backward
        return np.where(live, both[..., 1] / both.sum(2), 0.0), logs

    def features(self, marginals: np.ndarray) -> np.ndarray:
        """Per document: 1, the largest marginal, and the expected number of toxic tokens (logarithm)."""
        most = marginals.max(1, initial=0.0)
        return np.column_stack([np.ones(len(most)), most, np.log1p(marginals.sum(1))])

    def score(self, marginals: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.features(marginals) @ self.link))


def _powers(matrix: np.ndarray, exponents: np.ndarray) -> tuple[np.ndarray, float]:
    """``matrix``, divided by its largest eigenvalue, to each power; and that eigenvalue."""
    values, vectors = np.linalg.eig(matrix)
    top = float(np.abs(values).max())
    powered = (values / top) ** exponents[..., None]
    return np.real((vectors * powered[..., None, :]) @ np.linalg.inv(vectors)), top


def transitions(words: np.ndarray, gaps: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How often each of ``Crf.steps`` occurs on the labelled paths, where other tokens are clean."""
    live = words >= 0
    last = np.zeros((len(words), 1), bool)
    before = np.hstack([last, toxic[:, :-1]]) & (gaps[:, :-1] == 0)  # the token just before is toxic
    next_live = np.hstack([live[:, 1:], last])
    next_toxic = np.hstack([toxic[:, 1:], last])
    leaves = toxic & ((gaps[:, 1:] > 0) | (next_live & ~next_toxic))
    return np.array([0, (toxic & ~before).sum(), leaves.sum(), (toxic & before).sum()], float)


def fit_chains(
    lexicon: list[str], chains: list[Chain], label: np.ndarray, rounds: int = 120, decay: float = 0.05
) -> Crf:
    """Maximum likelihood with weight decay by Adam. A lexicon token counts as toxic in a document with
    label 1 and as clean otherwise. Lexicon weights take the exact gradient (labels minus marginals),
    the four chain weights a central difference of the likelihood."""
    share = (label.sum() + 1) / (len(label) + 2)
    model = Crf(lexicon, np.zeros(len(lexicon)), np.array([-4.0, -2.0, 0.0, 0.0]), np.zeros(3))
    model.link[0] = np.log(share / (1 - share))
    if not lexicon or not 0 < label.sum() < len(label):
        return model
    data = []
    for rows, words, gaps in batches(chains):
        toxic = (words >= 0) & (label[rows, None] == 1)
        data.append((words, gaps, toxic, transitions(words, gaps, toxic), rows))

    def objective() -> float:
        gold = sum(c @ model.steps for *_, c, _ in data)
        return gold - sum(model.marginals(w, g)[1].sum() for w, g, *_ in data)

    first, second = np.zeros(len(lexicon) + 4), np.zeros(len(lexicon) + 4)
    for k in range(1, rounds + 1):
        slope = np.zeros(len(lexicon))
        for words, gaps, toxic, *_ in data:
            live = words >= 0
            np.add.at(slope, words[live], toxic[live] - model.marginals(words, gaps)[0][live])
        chain = np.zeros(4)
        for j in range(4):
            ends = []
            for shift in (1e-4, -2e-4):
                model.steps[j] += shift
                ends.append(objective())
            model.steps[j] += 1e-4
            chain[j] = (ends[0] - ends[1]) / 2e-4
        all_ = np.concatenate([model.weights, model.steps])
        slope = np.concatenate([slope, chain]) - decay * all_
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.2 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        model.weights, model.steps = model.weights + move[:-4], model.steps + move[-4:]

    found = np.zeros((len(label), 3))
    for words, gaps, _, _, rows in data:
        found[rows] = model.features(model.marginals(words, gaps)[0])
    for _ in range(50):  # Newton steps of a logistic regression with weight decay
        p = 1 / (1 + np.exp(-found @ model.link))
        bend = (found * (p * (1 - p))[:, None]).T @ found + 0.1 * np.eye(3)
        model.link = model.link + np.linalg.solve(bend, found.T @ (label - p) - 0.1 * model.link)
    return model


# ---- on Spark


def lexicon_of(known: DataFrame, least: int = 3, odds: float = 1.5, evidence: float = 25.0) -> list[str]:
    """Tokens, and beginnings of tokens (marked ``*``), of ``known(text, label)`` that lean to label 1.

    What counts are distinct contexts (the token with its two neighbours), so that copies of a text
    speak once. ``evidence`` is the least likelihood ratio statistic against the share of label 1.
    """
    words = F.filter(F.split(F.lower("text"), NOT_TOKEN), lambda w: w != "")
    none = F.array(F.lit(""))
    before, after = F.concat(none, "words"), F.slice("words", 2, 1 << 30)
    neighbours = F.arrays_zip(before.alias("p"), F.col("words").alias("w"), after.alias("q"))
    context = F.transform(
        neighbours, lambda o: F.struct(o["w"].alias("w"), F.xxhash64(o["p"], o["w"], o["q"]).alias("c"))
    )
    entries = [F.col("o.w")] + [
        F.when(F.length("o.w") > n, F.concat(F.substring("o.w", 1, n), F.lit("*"))) for n in (5, 4)
    ]
    seen = (
        known.select("label", words.alias("words"))
        .select("label", F.explode(context).alias("o"))
        .filter("o.w is not null")
        .select("label", "o.c", F.explode(F.array_compact(F.array(*entries))).alias("entry"))
        .groupBy("entry", "c")
        .agg(F.max("label").alias("label"))
    )
    counts = seen.groupBy("entry").agg(
        F.sum(F.col("label").cast("double")).alias("ones"), F.count("*").cast("double").alias("n")
    )
    counts = write_and_read(counts)
    total, toxic = counts.agg(F.sum("n"), F.sum("ones")).first()
    if not total or not toxic or toxic == total:
        return []
    base = toxic / total
    ones, rest = F.col("ones"), F.col("n") - F.col("ones")
    lean = F.log((ones + 0.5) / (rest + 0.5)) - F.log(F.lit(base / (1 - base)))
    part = lambda k, p: F.when(k > 0, k * F.log(k / F.col("n") / p)).otherwise(0.0)
    ratio = 2 * (part(ones, base) + part(rest, 1 - base))
    best = counts.filter((ones >= least) & (lean >= odds) & (ratio >= evidence))
    best = best.orderBy(ratio.desc(), "entry").limit(MAX_LEXICON)
    return sorted(r[0] for r in best.select("entry").collect())


def fit_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Crf:
    """Fit on labelled documents outside the held-out fold; at most about ``most`` of them, by a hash."""
    rows = training_rows(labels, ~held_out(F.col("doc_id"), 4, 2), "toxic", most)
    known = write_and_read(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "label"))
    lexicon = lexicon_of(known)

    @F.pandas_udf("struct<words:array<int>,gaps:array<int>>")
    def chains(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(lexicon)
        for texts in parts:
            found = [chain_of(t, automaton) for t in texts]
            yield pd.DataFrame({"words": [c.words for c in found], "gaps": [c.gaps for c in found]})

    sample = known.select(chains("text").alias("c"), "label").select("c.*", "label").toPandas()
    found = [Chain(list(w), [], list(g)) for w, g in zip(sample["words"], sample["gaps"])]
    return fit_chains(lexicon, found, sample["label"].to_numpy(float))


def tag_documents(docs: DataFrame, model: Crf, least: float = 0.5) -> DataFrame:
    """``docs`` as the struct ``row``, with ``score`` (0 to 1) and ``spans``: start, end (code points of
    the whole text, end exclusive) and marginal of the tokens that are toxic with at least ``least``.

    Null and empty texts have the score of a text without lexicon tokens and no spans. Rows are
    independent of each other; memory is bounded by an Arrow batch of texts.
    """

    @F.pandas_udf("struct<score:double,spans:array<struct<start:int,end:int,marginal:double>>>")
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(model.lexicon)
        clean = float(model.score(np.zeros((1, 1)))[0])
        for texts in parts:
            score, spans = np.full(len(texts), clean), [[] for _ in range(len(texts))]
            places, chains = [], []
            for i, text in enumerate(texts):
                chain = chain_of(text, automaton, always=False)
                if chain.words:
                    places.append(i)
                    chains.append(chain)
            for rows, words, gaps in batches(chains) if chains else ():
                marginals, _ = model.marginals(words, gaps)
                score[[places[r] for r in rows]] = model.score(marginals)
                for r, values in zip(rows, marginals):
                    spans[places[r]] = [
                        {"start": a, "end": b, "marginal": float(m)}
                        for (a, b), m in zip(chains[r].spans, values)
                        if m >= least
                    ]
            yield pd.DataFrame({"score": score, "spans": spans})

    tagged = docs.select(F.struct("*").alias("row"), tag(F.col("text")).alias("t"))
    return tagged.select("row", "t.score", "t.spans")
