"""Token counts by merging ragged arrays of symbols, one lowest-rank pair of every sequence at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import tidy
from millrace.llm.encoding import SPACE, vocabulary
from millrace.llm.grid import slices

#: Bytes that a byte-level vocabulary shows as they are; the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Merger:
    """Counts the tokens of chunks between white space, remembering at most ``most`` of them."""

    def __init__(self, path: str, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        hidden = [x for x in range(256) if x not in _SHOWN]
        shown = [chr(x if x in _SHOWN else 256 + hidden.index(x)) for x in range(256)]
        self.inner = np.asarray([vocab[c] for c in shown], np.int64)
        self.last = np.asarray([vocab[c + self.end] for c in shown], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.size = np.int64(len(vocab))
        keys = np.asarray([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.asarray([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.lowered = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        self.known: dict[str, int] = {}
        self.most = most
        self.library = None
        self.path = path

    def forget(self) -> None:
        self.known = {}

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word ends up with.

        All words are one flat array of symbols. In every round each word
        finds the lowest rank among its neighbouring pairs and merges all
        that have it, from the left; words without a pair that merges are done.
        """
        out = np.zeros(len(words), np.int64)
        size = np.asarray([len(w) for w in words], np.int64)
        symbols = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        none = np.int64(len(self.keys))
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            found = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(found, self.ranks[at], none), none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(first, append=len(word))
            done = lowest == none
            out[word[first[done]]] = length[done]
            live = np.repeat(~done, length)
            hit = (rank == np.repeat(lowest, length)) & live
            spot = np.flatnonzero(hit)
            if len(spot) > 1:  # of touching hits, as in aaa, every second one from the left
                run = np.flatnonzero(np.append(True, np.diff(spot) > 1))
                place = np.arange(len(spot)) - np.repeat(run, np.diff(run, append=len(spot)))
                spot = spot[place % 2 == 0]
            symbols[spot] = self.made[rank[spot]]
            live[spot + 1] = False
            symbols, word = symbols[live], word[live]
        return out

    def pretokens(self, chunk: str) -> list[bytes]:
        """The words of a chunk as bytes, by the library where letters beyond Latin-1 matter."""
        if self.lowered.fullmatch(chunk):
            return [w.encode() for w in self.words.findall(chunk.lower())]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            hidden = [x for x in range(256) if x not in _SHOWN]
            self.back = {chr(x if x in _SHOWN else 256 + hidden.index(x)): x for x in range(256)}
        clean = self.library.normalizer.normalize_str(chunk)
        return [bytes(self.back[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def learn(self, chunks: list[str]) -> None:
        words, owner, extra = [], [], np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            parts = self.cut.split(chunk) if "<" in chunk else [chunk]
            for part in parts:
                if part in self.special:
                    extra[k] += 1
                elif part:
                    found = self.pretokens(part)
                    words += found
                    owner += [k] * len(found)
        if words:
            extra += np.bincount(owner, self.tokens(words), len(chunks)).astype(np.int64)
        self.known.update(zip(chunks, extra.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut = [text.split() if text.isascii() and not _ODD.search(text) else [x for x in self.spaces.split(text) if x] for text in texts]
        missing = set().union(*cut).difference(self.known)
        if len(self.known) + len(missing) > self.most:
            self.known = {}
            missing = set().union(*cut)
        todo = list(missing)
        for k in range(0, len(todo), 20_000):
            self.learn(todo[k : k + 20_000])
        known = self.known.__getitem__
        return [sum(map(known, x)) for x in cut]


_ODD = regex.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One merger for each Python worker."""
    return Merger(path)


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 21):
                rows = [x or "" for x in texts.to_pylist()]
                tokens = np.asarray(merger(path).count(rows), np.int64)
                size = pa.compute.binary_length(texts).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), size, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return tidy(run, lambda: merger(path).forget())


def token_counts(docs: DataFrame, vocab: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text), without added special tokens.

    A null text counts as an empty one, of 0 bytes and tokens. The library's
    special strings inside a text are one token each, as is its default. Rows
    are counted one by one, so ties and repeated rows stay; other columns of
    docs are not read.
    """
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_count(vocabulary(vocab), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
