"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence are shares of kinds of characters and
words, of words and word triples that the document repeats, and the same of
the lines before and after it; the chain adds how labels follow one another.
Forward-backward gives each line's probability of being good. Their mean,
weighted by the lines' lengths, is the document's, which a logistic map turns
into a calibrated score.

Only documents are labelled. The field is first fitted with a document's label
on all its lines, then again after lines that speak plainly against their
document's label have changed sides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, tidy

#: Labelled documents that the field is fitted on, and the most lines and characters of one of them.
SAMPLE, SAMPLE_LINES, SAMPLE_CHARS = 3000, 200, 64_000
#: Characters whose facts are computed at once.
PIECE = 1 << 20
ROUNDS, RATE, DECAY = 60, 0.15, 1e-3
PLAIN = 0.05
GOOD_FROM = 0.7
UPPER, LOWER, DIGIT, SYMBOL, POINT, SPACE, OTHER = range(7)
SYMBOLS = "#*$%&|<>!@^~=_+{}[]\\/`"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane."""
    by = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Nd": DIGIT}
    out = np.asarray([by.get(unicodedata.category(chr(c)), OTHER) for c in range(1 << 16)], np.uint8)
    for c in range(33, 127):
        if not chr(c).isalnum():
            out[c] = SYMBOL if chr(c) in SYMBOLS else POINT
    out[[32, *range(9, 14)]] = SPACE
    return out


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    """Powers of an odd number, by which a word's characters are mixed."""
    return np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def _mixed(codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of characters."""
    place = np.arange(len(codes), dtype=np.int64) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        own = (codes.astype(np.uint64) + np.uint64(1)) * _powers()[place & 4095] * (place.astype(np.uint64) // np.uint64(4096) + np.uint64(1))
        total = np.add.reduceat(own, begins) if len(begins) else np.empty(0, np.uint64)
        return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


BASE = 14


def facts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, characters of each line, facts of each line), all lines one after another.

    Words that the pieces of a text cut count as two.
    """
    whole = "\n".join(texts)
    n_lines = np.asarray([x.count("\n") + 1 for x in texts], np.int64)
    total = int(n_lines.sum())
    kinds = np.zeros((total, 7), np.int64)
    words, lines, sums = [], [], np.zeros((total, 3), np.int64)
    at, line = 0, 0
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        if end < len(whole):
            cut = max(whole.rfind(" ", at + PIECE // 2, end), whole.rfind("\n", at + PIECE // 2, end))
            end = cut + 1 if cut >= 0 else end
        codes = np.frombuffer(whole[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(codes < 1 << 16, _kinds()[np.minimum(codes, (1 << 16) - 1)], OTHER).astype(np.uint8)
        of = line + np.concatenate([[0], np.cumsum(codes == 10)[:-1]])
        kinds[of[0] : of[-1] + 1] += np.bincount((of - of[0]) * 7 + kind, minlength=7 * int(of[-1] - of[0] + 1)).reshape(-1, 7)
        inside = kind != SPACE
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        begins, ends = edge[::2], edge[1::2]
        if len(begins):
            lengths = ends - begins
            kept = np.flatnonzero(inside)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            own = of[begins]
            words.append(_mixed(codes[kept], starts, lengths))
            lines.append(own)
            count = lambda k: np.add.reduceat((kind[kept] == k).astype(np.int64), starts)  # noqa: B023, E731
            letters, upper, odd = count(LOWER), count(UPPER), count(SYMBOL)
            for k, flags in enumerate([(upper > 1) & (letters == 0), odd > 0, (letters + upper) == 0]):
                sums[of[0] : of[-1] + 1, k] += np.bincount(own[flags] - of[0], minlength=int(of[-1] - of[0] + 1))
        line = int(of[-1]) + int(codes[-1] == 10)
        at = end
    chars = kinds.sum(1)
    chars[: total - 1] -= 1  # the break at a line's end
    word = np.concatenate(words) if words else np.empty(0, np.uint64)
    own = np.concatenate(lines) if lines else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_lines)
    n_words = np.bincount(own, minlength=total)
    repeat = lambda flags, at: np.bincount(at, flags, minlength=total)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    again = _seen_again(word, own)
    three = word[:-2] * np.uint64(3) ^ word[1:-1] * np.uint64(5) ^ word[2:] * np.uint64(7) if len(word) > 2 else np.empty(0, np.uint64)
    apart = doc[own[:-2]] == doc[own[2:]] if len(word) > 2 else np.empty(0, bool)
    thrice = _seen_again(three[apart], doc[own[:-2]][apart])
    line_hash = np.zeros(total, np.uint64)
    full = np.flatnonzero(n_words)
    if len(full):
        first = np.cumsum(n_words) - n_words
        line_hash[full] = np.add.reduceat(word * _powers()[(np.arange(len(word)) - np.repeat(first, n_words)) & 4095], first[full])
    copied = _seen_again(line_hash, doc) * (n_words > 0)
    share = lambda x, of: np.divide(x, of, out=np.zeros(total), where=of > 0)
    shown = chars - kinds[:, SPACE] + 1
    shown[total - 1] -= 1
    letters = kinds[:, UPPER] + kinds[:, LOWER]
    found = np.stack(
        [
            share(kinds[:, UPPER], letters), share(kinds[:, DIGIT], shown), share(kinds[:, SYMBOL], shown), share(kinds[:, POINT], shown), share(kinds[:, OTHER], shown),
            share(sums[:, 0], n_words), share(sums[:, 1], n_words), share(sums[:, 2], n_words), share(repeat(same, own), n_words), share(repeat(again, own), n_words),
            share(repeat(thrice, own[:-2][apart] if len(word) > 2 else np.empty(0, np.int64)), n_words), copied,
            np.log1p(n_words) / 8, np.minimum(share(shown, n_words), 20) / 20,
        ], 1,
    ).astype(np.float32)
    return n_lines, np.maximum(chars, 0), found


def _seen_again(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """1 for each value that stands before in its group, 0 for the first."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    out = np.zeros(len(values))
    out[order[1:]] = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
    return out


def evidence(base: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's own facts with steps, and the facts of its neighbours in its document."""
    steps = np.concatenate([base[:, :12] > t for t in (0.02, 0.1, 0.3)], 1)
    first = np.cumsum(n_lines) - n_lines
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[first] = 0
    after[np.cumsum(n_lines) - 1] = 0
    return np.concatenate([base, steps, before, after, np.ones((len(base), 1))], 1).astype(np.float64)


def chain(node: np.ndarray, n_lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, expected moves, log partition of each document) by forward-backward.

    ``node`` is the log odds of good of each line by itself, ``moves`` the 2 x 2
    log weights of a label after another. Documents go in step, longest first.
    """
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    sizes = n_lines[order]
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    score = np.stack([np.zeros(len(node)), node], 1)
    ahead, back = np.zeros_like(score), np.zeros_like(score)
    total = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for t, n in enumerate(alive):
        at = first[:n] + t
        ahead[at] = score[at] + (total(ahead[at - 1][:, :, None] + moves, 1) if t else 0)
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        back[at] = total(moves + (score[at + 1] + back[at + 1])[:, None, :], 2)
    last = (np.cumsum(n_lines) - 1)
    logz = total(ahead[last], 1)
    z = np.repeat(logz, n_lines)
    good = np.exp(np.minimum(ahead[:, 1] + back[:, 1] - z, 0))
    inner = np.ones(len(node), bool)
    inner[last] = False
    a = np.flatnonzero(inner)
    pair = ahead[a][:, :, None] + moves + (score[a + 1] + back[a + 1])[:, None, :] - z[a][:, None, None]
    return good, np.exp(np.minimum(pair, 0)), logz


@dataclass
class Field:
    """Weights of the evidence, log weights of moves, and the map from a mean to a score."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, base: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return chain(evidence(base, n_lines) @ self.weights, n_lines, self.moves)[0]

    def scores(self, good: np.ndarray, chars: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _odds(means(good, chars, n_lines)) + self.shift, -30, 30)))


def means(good: np.ndarray, chars: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """The mean of the lines' probabilities, weighted by their lengths and one more."""
    first, w = np.cumsum(n_lines) - n_lines, chars + 1.0
    return np.add.reduceat(good * w, first) / np.add.reduceat(w, first)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _fit_chain(x: np.ndarray, y: np.ndarray, n_lines: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely weights of labels ``y`` of lines, each document counting as one, by Adam's steps."""
    share = np.repeat(1 / n_lines, n_lines) / len(n_lines)
    last = np.cumsum(n_lines) - 1
    inner = np.ones(len(y), bool)
    inner[last] = False
    a = np.flatnonzero(inner)
    seen = np.zeros((len(a), 2, 2))
    seen[np.arange(len(a)), y[a], y[a + 1]] = 1
    flat = np.concatenate([weights, moves.ravel()])
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for k in range(1, ROUNDS + 1):
        good, pair, _ = chain(x @ flat[:-4], n_lines, flat[-4:].reshape(2, 2))
        slope = np.concatenate([((y - good) * share) @ x, ((seen - pair) * share[a][:, None, None]).sum(0).ravel()]) - DECAY * flat
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        flat = flat + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return flat[:-4], flat[-4:].reshape(2, 2)


def train(base: np.ndarray, chars: np.ndarray, n_lines: np.ndarray, labels: np.ndarray) -> Field:
    """The field of documents with these lines and labels (0 or 1)."""
    x = evidence(base, n_lines)
    y = np.repeat(labels, n_lines)
    weights, moves = _fit_chain(x, y, n_lines, np.zeros(x.shape[1]), np.zeros((2, 2)))
    alone = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    y = np.where(alone > 1 - PLAIN, 1, np.where(alone < PLAIN, 0, y))
    weights, moves = _fit_chain(x, y, n_lines, weights, moves)
    odds = _odds(means(chain(x @ weights, n_lines, moves)[0], chars, n_lines))
    design = np.stack([odds, np.ones(len(odds))], 1)
    line = np.zeros(2)
    for _ in range(25):  # Newton's steps of a logistic map with two numbers
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        line += np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-3 * np.eye(2), design.T @ (labels - p) - 1e-3 * line)
    return Field(weights, moves, float(line[0]), float(line[1]))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with their texts (last column), of at most 256 rows; a text of a piece or more is alone, so that it is cut alike in any batch."""
    texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
    first = 0
    for k, x in enumerate(texts):
        if k > first and (k - first == 256 or len(x) >= PIECE or len(texts[k - 1]) >= PIECE):
            yield batch.slice(first, k - first), texts[first:k]
            first = k
    if texts:
        yield batch.slice(first), texts[first:]


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _parts(batch):
            n_lines, chars, found = facts(texts)
            ends = np.cumsum(n_lines)
            cut = lambda v: pa.array([v[b - n : b].tobytes() for b, n in zip(ends, n_lines, strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_lines), cut(chars), cut(found)], names=["doc_id", "label", "n", "chars", "facts"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field of the labelled rows that aren't held out.

    ``labels`` has doc_id and quality. At most ``sample`` documents, those
    with the lowest hashes of their ids, of at most ``SAMPLE_LINES`` lines and
    ``SAMPLE_CHARS`` characters are learnt from, and their lines' facts alone
    come to the driver. A document with several labels has the lowest. Without
    both labels every document gets the score 0.5.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    fits = docs.filter((F.length("text") <= SAMPLE_CHARS) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < SAMPLE_LINES))
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    own = fits.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")
    rows = own.mapInArrow(tidy(_base), "doc_id long, label int, n long, chars binary, facts binary").toArrow().sort_by("doc_id")
    y = rows["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Field(np.zeros(3 * BASE + 37), np.zeros((2, 2)), slope=0.0)
    n_lines = rows["n"].to_numpy()
    chars = np.frombuffer(b"".join(rows["chars"].to_pylist()), np.int64)
    base = np.frombuffer(b"".join(rows["facts"].to_pylist()), np.float32).reshape(-1, BASE)
    return train(base, chars, n_lines, y.astype(np.int64))


def _scores(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch):
                n_lines, chars, found = facts(texts)
                good = field.lines(found, n_lines)
                bad = np.add.reduceat(good < 0.5, np.cumsum(n_lines) - n_lines)
                own = [pa.array(field.scores(good, chars, n_lines)), pa.array(n_lines), pa.array(bad.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], names=[*batch.schema.names[:-1], "score", "n_lines", "n_bad_lines"])

    return tidy(run)


def scored(docs: DataFrame, field: Field, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` with score (0 to 1), predicted (1 from ``GOOD_FROM``), n_lines and n_bad_lines of each text.

    A null text is an empty one, which is one empty line. Repeated rows are
    scored each. Columns named like results are replaced.
    """
    made = ["score", "n_lines", "n_bad_lines", "predicted"]
    kept = [c for c in (columns if columns is not None else docs.columns) if c not in made]
    rows = docs.select(*kept, F.col("text").alias("text_"))
    kind = ", ".join([*(f"`{c}` {k}" for c, k in rows.dtypes if c != "text_"), "score double, n_lines long, n_bad_lines long"])
    return rows.mapInArrow(_scores(field), kind).withColumn("predicted", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0))
