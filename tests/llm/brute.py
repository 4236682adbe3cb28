"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import regex

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, schema=DOCS):
    """Documents of ``(doc_id, text[, source])``."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def roots(n, linked):
    """Smallest index reachable from each of ``n`` indices."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def jaccard_roots(texts, width, percent):
    sets = [shingles(t, width) for t in texts]

    def linked(a, b):
        common = len(sets[a] & sets[b])
        return common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common)

    return roots(len(texts), linked), [len(s) for s in sets]


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by source: sizes in code point order, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def small_letters(text):
    """Only A-Z in lower case."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spelling_counts(docs, least=7, occurs=2):
    """Occurrences of words over ``(doc_id, text)``."""
    counts = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = small_letters(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= occurs}


def single_edits(word, letters):
    """All words one edit away."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b}
    out |= {a + c + b[1:] for a, b in cut if b for c in letters}
    out |= {a + c + b for a, b in cut for c in letters}
    return out - {word}


def spelling(counts, times=10):
    """``word: (n, form, form_n, n_near, root)``."""
    letters = {c for w in counts for c in w}
    out, form = {}, {}
    for word, n in counts.items():
        near = [w for w in single_edits(word, letters) if w in counts]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= times * n else None
        out[word] = (n, form[word], counts.get(form[word]), len(near))
    for word in counts:
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] += (root,)
    return out


def search(docs, items, k=10):
    """``(item_id, rank, doc_id, score)`` over ``(doc_id, text)`` and ``(item_id, text)``."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(doc_id, [small_letters(t) for t in term.findall(text or "")]) for doc_id, text in docs]
    found = [(doc_id, t) for doc_id, t in found if t]
    many, length = len(found), sum(len(t) for _, t in found)
    held = [(doc_id, len(t), Counter(t)) for doc_id, t in found]
    df = Counter(t for *_, c in held for t in c)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(small_letters(t) for t in term.findall(text or ""))
    out = []
    for item_id, terms in asked.items():
        scored = []
        for doc_id, n, tfs in held:
            m = 100 - 90 + 90 * n * many // length
            score = sum(
                math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * tfs[t] // (1000 * tfs[t] + 8 * m))
                for t in terms if t in tfs
            )
            scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        best = [r for r in sorted(scored, key=lambda r: r[:3]) if r[0] < 0][:k]
        out += [(item_id, rank, r[3], -r[0]) for rank, r in enumerate(best, 1)]
    return out


UNITS = (
    "km hm dm cm mm nm m kg mg g lb lbs oz l ml s ms min h hour hours minute minutes second seconds day days week weeks"
    " month months year years mile miles foot feet ft inch inches meter meters metre metres dollar dollars euro euros"
    " percent kb mb gb tb hz khz mhz ghz w kw v kv"
).split()


def template_tokens(text):
    """``(template token, value)`` of a text."""
    text = text or ""
    number = r"[0-9]+(?:[.,][0-9]+)*"
    letters = {m.start(): m.end() for m in regex.finditer(r"\p{L}+", text)}
    names = [m.start() for m in regex.finditer(r"(?<=[\p{Ll},;:0-9] )\p{Lu}\p{Ll}+", text)]
    chains = []
    for at in names:
        gap = rf"[,;:]? (?:(?:{number}|\p{{Lu}}\p{{L}}*)[,;:]? ){{0,3}}"
        if chains and regex.fullmatch(gap, text[letters[chains[-1][-1]] : at]):
            chains[-1].append(at)
        else:
            chains.append([at])
    names = {at for c in chains if len(c) < 4 for at in c}
    out = []
    for m in regex.finditer(rf"\p{{L}}+|{number}", text):
        word, at = m.group().lower(), m.start()
        kind = word
        if "0" <= word[0] <= "9":
            kind = "#"
        elif at in names:
            kind = "@"
        elif word in UNITS and regex.search(r"[0-9] ?$", text[max(at - 2, 0) : at]):
            kind = "%"
        out.append((kind, word))
    return out


def leaks(docs, items, width=5, share=0.5, run=13):
    """``(doc_id, item_id): (windows, shared windows, exact)`` over ``(id, text)`` with different ids."""
    out = {}
    held = [(doc_id, template_tokens(text)) for doc_id, text in docs]
    for item_id, text in items:
        item = template_tokens(text)
        size = min(width, len(item))
        every = range(len(item) - size + 1) if item else []
        for doc_id, doc in held:
            for shift in range(-len(item), len(doc)):
                both = [
                    (item[at : at + size], doc[at + shift : at + shift + size]) for at in every if at + shift >= 0
                ]
                same = [(a, b) for a, b in both if [x for x, _ in a] == [x for x, _ in b]]
                slots = {(x, y) for a, b in same for x, y in zip(a, b) if x[0] in ("#", "@", "%")}
                enough = len(same) >= len(every) * share or len(same) >= run - width + 1
                if same and enough and len({x for x, _ in slots}) == len(slots):
                    exact = all(x == y for x, y in slots)
                    n, e = out.get((doc_id, item_id), (0, 0, False))[1:]
                    out[doc_id, item_id] = (len(every), max(n, len(same)), e or exact)
    return out


def licences(sequence, rules):
    """Licences of a sequence of ``identifier version`` by ordered rules, each on what the ones before left."""
    rest, out = [tuple((s + " ").split(" ")[:2]) for s in sequence], []
    for name, ids in rules:
        at = 0
        while at + len(ids) <= len(rest):
            if [s and s[0] for s in rest[at : at + len(ids)]] == list(ids):
                out.append(f"{name} {rest[at][1]}".strip())
                rest[at : at + len(ids)] = [None]
            at += 1
    return list(dict.fromkeys(out))
