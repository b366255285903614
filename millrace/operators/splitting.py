"""Sizes of texts in words or in tokens of a public vocabulary, and texts cut at the largest breaks that fit.

Words are counted by columns; tokens by Python, which knows the sizes of
pieces that it has met.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.functions.text import word_count, words

#: Texts that the library encodes at once.
AT_ONCE = 256
#: Where texts are cut, the largest breaks first; at last between characters.
BREAKS = ("\n\n", "\n", " ", "")
MOST = 500


#: White space as vocabularies by bytes have it, and the pieces that none of their tokens crosses.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Pieces whose sizes a worker remembers, of at most so many characters.
KNOWN, KNOWN_CHARS = 400_000, 64


class _Pieces(dict):
    """Sizes of pieces, each of which the library encodes once."""

    def __init__(self, library):
        self.library = library

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= KNOWN_CHARS:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = n
        return n


class Library:
    """Sizes in tokens of a vocabulary file, and ends of texts.

    Where the vocabulary is one of bytes that splits texts by the usual
    pattern, no token goes from a character to white space after it; so texts
    are cut there, and repeated pieces are encoded once. Texts that hold the
    library's special strings, and all texts for other vocabularies, go to it whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        told = json.loads(self.library.to_str())
        pattern, model = told["pre_tokenizer"] or {}, told["model"]
        by_bytes = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space")
        self.cut = by_bytes and told["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
        self.special = [x["content"] for x in told["added_tokens"]]
        self.known = _Pieces(self.library)

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or none if it can't be cut."""
        return PIECES.findall(text) if self.cut and not any(x in text for x in self.special) else None

    def sizes(self, texts: list[str]) -> list[int]:
        known, cut = self.known.__getitem__, [self.pieces(x) for x in texts]
        whole = [x for x, own in zip(texts, cut, strict=True) if own is None]
        rest = iter([len(x.ids) for k in range(0, len(whole), AT_ONCE) for x in self.library.encode_batch(whole[k : k + AT_ONCE], add_special_tokens=False)])
        return [next(rest) if own is None else sum(map(known, own)) for own in cut]

    def end(self, text: str, n: int) -> str:
        """The last ``n`` tokens of a text."""
        if n <= 0:
            return ""
        start, own = 0, self.pieces(text)
        if own:
            # One piece more than has them, so that none of them begins what is encoded.
            k, found = len(own), 0
            while k and found <= n:
                k -= 1
                found += self.known[own[k]]
            start = sum(map(len, own[: max(0, k - 1)]))
        places = self.library.encode(text[start:], add_special_tokens=False).offsets
        return text if len(places) <= n else text[start + places[-n][0] :]


@lru_cache(maxsize=2)
def library(vocabulary: str) -> Library:
    """One for each Python worker."""
    return Library(vocabulary)


def _size(vocabulary: str | None) -> Callable[[list[str]], list[int]]:
    if vocabulary is None:
        return lambda texts: [len(x.split()) for x in texts]
    return lambda texts: library(vocabulary).sizes(texts)


def token_count(text: Column, vocabulary: str, in_place: bool = False) -> Column:
    """The tokens of each text by the vocabulary file; a null or empty text has none. ``in_place`` keeps the planner from moving it."""

    @F.arrow_udf(LongType())
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(_size(vocabulary)([x or "" for x in texts.to_pylist()]), pa.int64())

    return (counts.asNondeterministic() if in_place else counts)(text)


def split(text: str, most: int, size: Callable[[list[str]], list[int]], breaks: tuple[str, ...] = BREAKS) -> list[str]:
    """Pieces of at most ``most``, cut at the largest breaks that do; small neighbours stay together up to that size."""
    at = next(k for k, x in enumerate(breaks) if not x or x in text)
    parts = [x for x in (text.split(breaks[at]) if breaks[at] else list(text)) if x]
    out: list[str] = []
    open_, total = [], 0
    for part, own in zip(parts, size([breaks[at] + x for x in parts]), strict=True):
        if open_ and total + own > most:
            out.append(breaks[at].join(open_))
            open_, total = [], 0
        if own <= most:
            open_.append(part)
            total += own
        else:
            out += split(part, most, size, breaks[at + 1 :]) if breaks[at] else [part]
    if open_:
        out.append(breaks[at].join(open_))
    return out


class Words:
    """Sizes in words between Unicode white space."""

    def count(self, text: Column) -> Column:
        return word_count(text)

    def counts(self, texts: Column) -> Column:
        return F.transform(texts, word_count)

    def capped(self, pieces: Column, sizes: Column, most: Column, margin: int) -> Column:
        """Pieces of these sizes, those larger than ``most`` cut to ``margin`` less."""
        step = F.greatest(most - margin, F.lit(1))
        return F.flatten(F.zip_with(pieces, sizes, lambda p, n: F.when(n <= most, F.array(p)).otherwise(word_slices(p, step))))

    def tails(self, pieces: Column, sizes: Column) -> Column:
        """The end of each piece, of so many words."""
        tail = lambda p, n: F.when(n <= 0, "").when(word_count(p) <= n, p).otherwise(F.array_join(F.slice(words(p), -n.cast("int"), n.cast("int")), " "))
        return F.zip_with(pieces, sizes, tail)


class Tokens:
    """Sizes in tokens of a vocabulary file; a null text has none.

    The function counts as not deterministic, so that the planner leaves it
    where it stands: it runs once, and is not moved into a lambda or a generator.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary

    def count(self, text: Column) -> Column:
        return token_count(text, self.vocabulary, in_place=True)


Measure = Words | Tokens


def measure(vocabulary: str | None) -> Measure:
    return Words() if vocabulary is None else Tokens(vocabulary)


def word_slices(text: Column, most: int | Column) -> Column:
    """A text cut after every ``most`` words."""
    step = most if isinstance(most, Column) else F.lit(most)
    found = F.transform(F.array(words(text)), lambda w: F.transform(F.sequence(F.lit(0), F.greatest((F.size(w) - 1).cast("int"), F.lit(0)), step), lambda k: F.array_join(F.slice(w, k + 1, step), " ")))
    return F.filter(F.get(found, F.lit(0)), lambda x: x != "")


def recursive_chunks(docs: DataFrame, most: int = MOST, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, text, token_count) of ``docs`` (doc_id, text): fixed-size chunks without structure.

    Sizes are tokens of the vocabulary file, or words. Joined parts have the sum
    of their sizes, each with the break before it. A null text, or one of breaks only, has no chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = _size(vocabulary)
        for frame in frames:
            found = [(i, x) for i, x in zip(frame["doc_id"], frame["text"], strict=True) if x]
            rows = [(i, k + 1, f"baseline_{i}_{k + 1:03d}", p) for i, x in found for k, p in enumerate(p for p in split(x, most, size) if p.strip())]
            out = pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk_id", "text"])
            yield out.assign(token_count=size(out["text"].tolist()) if rows else [])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_no int, chunk_id string, text string, token_count long")
