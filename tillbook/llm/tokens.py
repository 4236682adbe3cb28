"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are worked on in parts of equal bytes, and cut into pieces at places where no token can lie
across: the byte-level pre-tokeniser always begins a match with a blank between two visible characters,
and ends one where an ASCII letter meets a digit or sign. Equal pieces of a task are encoded once and
their lengths remembered; the pieces that are new go to the library in batches of about equal bytes. A
text's count is the sum over its pieces, so no list of tokens is ever kept.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.arrow_text import binary_array, text_parts
from tillbook.llm.common import utf8_bytes

#: Bytes of one call of the library, and of the pieces that a task remembers.
CALL, REMEMBERED = 1 << 18, 16 << 20

BLANK = 0x20
_BYTES = np.arange(256)
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"
#: Bytes that begin a character that is not white space, and ASCII bytes that are one. Lead bytes of which
#: some characters are white space (C2, E1, E2, E3) are left out.
VISIBLE = (_BYTES > 0x20) & (_BYTES < 0x7F)
LEAD2 = (_BYTES >= 0xC3) & (_BYTES <= 0xDF)
BEGINS = VISIBLE | LEAD2 | (_BYTES == 0xE0) | ((_BYTES >= 0xE4) & (_BYTES <= 0xF4))
#: Kinds of ASCII bytes: 1 letter, 2 digit, 3 sign. An apostrophe (contractions) and a bar (special tokens) are none.
KIND = np.select([np.isin(_BYTES, list(kind)) for kind in (_LETTERS, b"0123456789", _SIGNS)], [1, 2, 3], 0).astype(np.uint8)


def blank_places(data: np.ndarray) -> np.ndarray:
    """Places of blanks between two visible characters."""
    at = np.flatnonzero(data[1:-1] == BLANK) + 1
    before = data[at - 1]
    # A character of two bytes is visible if its lead byte says so; at - 2 is its lead byte.
    ended = VISIBLE[before] | ((before >= 0x80) & LEAD2[data[np.maximum(at - 2, 0)]])
    return at[ended & BEGINS[data[at + 1]]]


def class_places(data: np.ndarray) -> np.ndarray:
    """Places where an ASCII letter is followed by an ASCII digit or sign, or a digit by a letter."""
    kind = KIND[data]
    after, before = kind[1:], kind[:-1]
    return np.flatnonzero(((before == 1) & (after >= 2)) | ((before == 2) & (after == 1))) + 1


def safe_places(data: np.ndarray) -> np.ndarray:
    """All places where texts may be cut, in order."""
    return np.sort(np.concatenate([blank_places(data), class_places(data)]))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin."""
    begins = np.zeros(len(data) + 1, bool)
    begins[safe_places(data)] = begins[offsets[:-1]] = True
    return np.flatnonzero(begins[:-1])


class Lengths:
    """Numbers of tokens of pieces, each new one by the library, the others from memory."""

    def __init__(self, encode: Callable[[list[str]], list[int]]):
        self.encode, self.known, self.held = encode, {}, 0

    def of(self, pieces: list[bytes]) -> np.ndarray:
        new = [p for p in pieces if p not in self.known]
        if self.held + sum(map(len, new)) > REMEMBERED:
            self.known, self.held, new = {}, 0, pieces
        batch, size = [], 0
        for p in new:
            batch.append(p)
            size += len(p)
            if size >= CALL:
                self._add(batch)
                batch, size = [], 0
        self._add(batch)
        return np.array([self.known[p] for p in pieces], np.int64)

    def _add(self, batch: list[bytes]) -> None:
        if batch:
            self.known.update(zip(batch, self.encode([p.decode(errors="replace") for p in batch])))
            self.held += sum(map(len, batch))


def counts_of(texts: pa.Array, lengths: Lengths) -> np.ndarray:
    """Tokens of every text."""
    out = np.zeros(len(texts), np.int64)
    for first, data, offsets in text_parts(texts, safe_places):
        if len(data):
            starts = piece_starts(data, offsets)
            pieces = binary_array(data, starts).dictionary_encode()
            found = lengths.of(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
            total = np.concatenate([[0], np.cumsum(found)])
            out[first : first + len(offsets) - 1] += np.diff(total[np.searchsorted(starts, offsets)])
    return out


def check_definition(definition: str) -> None:
    """Raise unless pieces are encoded as they are inside a text: byte-level pre-tokenising by the usual
    pattern without an added blank, no normalising, no special token that a cut could divide."""
    found = json.loads(definition)
    split = found["pre_tokenizer"] or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("texts can be cut for byte-level tokenizers without an added blank only")
    added = found.get("added_tokens", [])
    cut = [a["content"] for a in added if len(safe_places(np.frombuffer(a["content"].encode(), np.uint8)))]
    if found.get("normalizer") or cut or any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added):
        raise ValueError("special tokens or a normalizer would be changed by cutting texts")


def json_encoder(definition: str) -> Callable[[list[str]], list[int]]:
    """Lengths of encoded texts by the ``tokenizers`` library, from a definition in JSON."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text (``to``, BIGINT) as the tokenizer file at ``path`` (a
    ``.json`` definition with byte-level pre-tokenising, known to the driver) gives it, without added
    begin, end or special tokens; the string of a special token inside a text is one token.

    Null and empty texts have no tokens. Repeated rows, clashing names and null ids are kept as they are;
    a column already named ``to`` is replaced. Texts of any length are counted whole. An empty table
    gives an empty table.
    """
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    check_definition(definition)

    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths = Lengths(json_encoder(definition))
        for texts in parts:
            yield pa.array(counts_of(texts, lengths))

    return docs.withColumn(to, F.arrow_udf("bigint")(count)(F.col(text)))


def over_limit(n_tokens: Column, limit: int) -> Column:
    """Whether a text has more tokens than a context holds."""
    return n_tokens > F.lit(limit)


def token_report(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every document."""
    counted = count_tokens(docs.select("doc_id", "text"), path)
    return counted.select("doc_id", utf8_bytes(F.col("text")).alias("n_bytes"), "n_tokens", over_limit(F.col("n_tokens"), limit).alias("over_limit"))
