"""Vector collections: upsert, batches, exact nearest neighbours with metadata filters, and neighbours by cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean, word_count
from millrace.sources.shared import Steps

# Records and words of an embedding batch.
BATCH_RECORDS, BATCH_WORDS = 100, 30_000
#: Texts in a partition, by expectation, of which only the numbers of words come together.
RUN_ROWS = 200_000
#: Bytes of query vectors that go to all tasks in one scan of the collection, and cosines that are computed at once.
QUERY_BYTES, PAIRS = 64 << 20, 1 << 21
#: What rounding may do to a product of unit vectors.
SLACK = 1e-9
#: Rows that cells are fitted on, rounds of fitting, and cells of a collection if its size doesn't ask for fewer.
CELL_SAMPLE, CELL_ROUNDS, MOST_CELLS = 20_000, 8, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; null if one is null or has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of or beside its own."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of ``new`` that ``old`` lacks or has with other values: what a rebuild must embed."""
    mark = F.sha2(F.to_json(F.struct(*columns)), 256)
    return new.withColumn("mark_", mark).join(old.select(key, mark.alias("mark_")), [key, "mark_"], "left_anti").drop("mark_")


def in_sync(old: DataFrame, new: DataFrame) -> bool:
    """Whether a collection has as many rows as its source, by which a rebuild is skipped."""
    return old.count() == new.count()


def _after(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words before each place, and for a batch that begins at each text the place where it ends."""
    total = np.concatenate([[0], np.cumsum(w)])
    at = np.arange(len(w))
    return total, np.maximum(at + 1, np.minimum(at + BATCH_RECORDS, np.searchsorted(total, total[:-1] + BATCH_WORDS, side="right") - 1))


def _begins(words: int, records: int, heads: np.ndarray) -> int:
    """The text of a run at which the open batch of so many words and records ends; the number of ``heads`` if it goes on."""
    full = (words + np.cumsum(heads) > BATCH_WORDS) | (records + np.arange(len(heads)) >= BATCH_RECORDS)
    return int(full.argmax()) if full.any() else len(heads)


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a run does for each text at which its first batch may begin: batches after it, words and records of the last."""
    for frame in frames:
        out = []
        for ws in frame["ws"]:
            w = np.asarray(ws, np.int64)
            total, after = _after(w)
            n = len(w)
            starts = min(BATCH_RECORDS, n - 1) + 1
            steps, last = [0] * n, list(range(n))
            for k in range(n - 1, -1, -1):
                if after[k] < n:
                    steps[k], last[k] = 1 + steps[after[k]], last[after[k]]
            last = np.asarray(last[:starts])
            out.append((n, int(total[-1]), w[: BATCH_RECORDS + 1].tolist(), steps[:starts], (total[-1] - total[last]).tolist(), (n - last).tolist()))
        yield pd.concat([frame[["id", "part"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "total", "heads", "steps", "words", "records"])], axis=1)


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, part, batch, words, records): the open batch with which each run of a group begins."""
    out, batch, words, records = [], -1, 0, BATCH_RECORDS
    for r in rows.sort_values("part").itertuples(index=False):
        out.append((r.id, r.part, batch, words, records))
        k = _begins(words, records, np.asarray(r.heads, np.int64))
        if k >= r.n:
            words, records = words + r.total, records + r.n
        else:
            batch, words, records = batch + 1 + int(r.steps[k]), int(r.words[k]), int(r.records[k])
    return pd.DataFrame(out, columns=["id", "part", "batch", "words", "records"])


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples(index=False):
            w = np.asarray(r.ws, np.int64)
            total, after = _after(w)
            k, batch, found = _begins(int(r.words), int(r.records), w[: BATCH_RECORDS + 1]), int(r.batch), []
            if k:
                found.append((r.id, batch, k, int(total[k])))
            while k < len(w):
                end, batch = int(after[k]), batch + 1
                found.append((r.id, batch, end - k, int(total[end] - total[k])))
                k = end
            yield pd.DataFrame(found, columns=["id", "batch", "records", "words"])


def batches(records: DataFrame, group: str, order: str, text: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """(group, batch, records, words): each group's texts in order, in batches within both limits; a larger text is alone.

    Texts are ranged by group and order, so that a group may lie in many
    partitions. Each run of a group in a partition is summed up for every text
    at which its first batch may begin; the summaries in order give the open
    batch that each run begins with.
    """
    spark = records.sparkSession
    sized = records.select(group, order, word_count(F.col(text)).cast("long").alias("w"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // run_rows))
    ranged = sized.repartitionByRange(parts, group, order, "w").withColumn("part", F.spark_partition_id())
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "w"))), lambda x: x["w"])
    steps = Steps(spark)
    runs = steps.keep(ranged.groupBy(group, "part").agg(listed.alias("ws")).withColumn("id", F.to_json(F.struct(group))))
    facts = runs.select("id", "part", "ws").mapInPandas(_summaries, "id string, part int, n long, total long, heads array<long>, steps array<long>, words array<long>, records array<long>")
    starts = facts.groupBy("id").applyInPandas(_starts, "id string, part int, batch int, words long, records long")
    pieces = runs.select("id", "part", "ws").join(starts, ["id", "part"]).mapInPandas(_pieces, "id string, batch int, records int, words long")
    found = pieces.groupBy("id", "batch").agg(F.sum("records").cast("int").alias("records"), F.sum("words").alias("words"))
    with steps:
        return steps.finish(found.join(runs.select("id", group).distinct(), "id").select(group, "batch", "records", "words"))


def matches(filters: dict[str, str | None]) -> Column:
    """All filters with a value as equalities; true if there is none."""
    return reduce(lambda a, kv: a & (F.col(kv[0]) == kv[1]), ((k, v) for k, v in filters.items() if v not in (None, "")), F.lit(True))


def filter_or_null(x: str, y: str, columns: list[str]) -> Column:
    """Whether row ``x`` of filters allows row ``y``: each is null, empty or equal."""
    return reduce(lambda a, c: a & (clean(F.col(f"{x}.{c}")).isNull() | (F.col(f"{x}.{c}") == F.col(f"{y}.{c}"))), columns, F.lit(True))


def nearest(collection: DataFrame, query: list[float], k: int, filters: dict | None = None) -> DataFrame:
    """The k rows of ``collection`` (vec_id, embedding) nearest to one vector, ties by vec_id; vectors without length are no one's neighbours."""
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    scored = collection.filter(matches(filters or {})).select("vec_id", score.alias("raw")).filter("raw is not null")
    return scored.orderBy(F.desc("raw"), "vec_id").limit(k).select("vec_id", F.round("raw", 4).alias("score"))


@dataclass
class _Queries:
    """Query vectors of one length, with what each asks of each filter (null: any), and the cells that each looks in, a bit a cell."""

    ids: pa.Array
    vectors: np.ndarray
    wanted: list[pa.Array]
    cells: np.ndarray | None = None
    n_cells: int = 0


def _plain(listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the vectors that have a length, all of them finite and of the most usual size."""
    sizes = pc.fill_null(pc.list_value_length(listed), -1).to_numpy(zero_copy_only=False)
    if not (sizes > 0).any():
        return np.empty(0, np.int64), np.empty((0, 0))
    width = int(np.bincount(sizes[sizes > 0]).argmax())
    at = np.flatnonzero(sizes == width)
    m = pc.list_flatten(listed.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    ok = np.isfinite(m).all(1) & (m != 0).any(1)
    return at[ok], m[ok]


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True)) if len(m) else m


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row with the other's, summed in order, so that equal vectors have equal cosines wherever they lie."""
    dot_ = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    return dot_(a, b) / np.sqrt(dot_(a, a) * dot_(b, b))


def _exact(m: np.ndarray, row: np.ndarray, vectors: np.ndarray, who: np.ndarray) -> np.ndarray:
    """``_cosines`` of pairs of rows and queries, so many at once that their vectors stay small: ties may be as many as pairs."""
    step = max(1, PAIRS // max(1, m.shape[1]))
    return np.concatenate([np.empty(0), *(_cosines(m[row[k : k + step]], vectors[who[k : k + step]]) for k in range(0, len(row), step))])


def _near(batch: pa.RecordBatch, q: _Queries, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, places of rows, cosines) of the k nearest rows of a batch, and of all that tie with the last."""
    at, m = _plain(batch.column(1))
    if not len(at) or m.shape[1] != q.vectors.shape[1]:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    units = _units(m)
    filters = []
    for i, wanted in enumerate(q.wanted):
        own = batch.column(2 + i).take(pa.array(at))
        kinds = pc.unique(own).drop_null()
        code = lambda x, none: pc.fill_null(pc.index_in(x, value_set=kinds), none).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        filters.append((pc.is_valid(wanted).to_numpy(zero_copy_only=False), code(wanted, -2), code(own, -3)))
    cell = batch.column(2 + len(q.wanted)).take(pa.array(at)).to_numpy(zero_copy_only=False) if q.cells is not None else None
    step, out = max(1, PAIRS // max(len(at), q.n_cells)), []
    for start in range(0, len(q.vectors), step):
        block = slice(start, start + step)
        score = _units(q.vectors[block]) @ units.T
        for asks, value, own in filters:
            score[asks[block, None] & (value[block, None] != own[None, :])] = -np.inf
        if cell is not None:
            # One more column, of no one, for rows in no cell.
            looked = np.pad(np.unpackbits(q.cells[block], axis=1, count=q.n_cells).astype(bool), ((0, 0), (0, 1)))
            score[~looked[:, cell]] = -np.inf
        if score.shape[1] > k:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None] - SLACK
            who, row = np.nonzero((score >= least) & (score > -np.inf))
        else:
            who, row = np.nonzero(score > -np.inf)
        out.append((who + start, at[row], _exact(m, row, q.vectors, who + start)))
    if not out:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _neighbours(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                who, row, raw = _near(batch, sent.value, k)
                yield pa.RecordBatch.from_arrays([sent.value.ids.take(pa.array(who)), batch.column(0).take(pa.array(row)), pa.array(raw)], names=["query_id", "vec_id", "raw"])

    return run


def _asked(own: pa.Table, columns: list[str], cells: np.ndarray | None = None, probes: int = 0) -> _Queries:
    at, m = _plain(own["query_vector"].combine_chunks())
    take = lambda c: own[c].combine_chunks().take(pa.array(at))
    return _Queries(take("query_id"), m, [take(c) for c in columns], *((None, 0) if cells is None else (_looked_in(m, cells, probes), len(cells))))


def _looked_in(m: np.ndarray, cells: np.ndarray, probes: int) -> np.ndarray:
    """The cells nearest to each vector as bits, a stretch of vectors at a time."""
    step = max(1, PAIRS // max(1, len(cells)))
    out = np.zeros((len(m), -(-len(cells) // 8)), np.uint8)
    for k in range(0, len(m), step):
        own = np.zeros((len(m[k : k + step]), len(cells)), bool)
        if own.size:
            np.put_along_axis(own, _closest(_units(m[k : k + step]), cells, probes), True, axis=1)
        out[k : k + step] = np.packbits(own, axis=1)
    return out


def _closest(units: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """The n cells nearest to each vector, the nearest first."""
    return np.argsort(-(units @ cells.T), axis=1, kind="stable")[:, :n]


def _cell(units: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell nearest to each vector, a stretch of vectors at a time."""
    step = max(1, PAIRS // max(1, len(cells)))
    return np.concatenate([np.empty(0, np.int64), *((units[k : k + step] @ cells.T).argmax(1) for k in range(0, len(units), step))])


def _searched(collection: DataFrame, queries: DataFrame, k: int, columns: list[str], cells: np.ndarray | None, probes: int) -> DataFrame:
    spark = collection.sparkSession
    with Steps(spark) as steps:
        kept = steps.keep(queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"), *(clean(F.col(c).cast("string")).alias(c) for c in columns)))
        size = kept.agg(F.sum(8 * F.size("query_vector"))).first()[0] or 0
        blocks = max(1, -(-size // QUERY_BYTES))
        rows = collection.filter("vec_id is not null").select("vec_id", "embedding", *(F.col(c).cast("string").alias(c) for c in columns), *(["cell"] if cells is not None else []))
        kinds = {"q": queries.schema["query_id"].dataType.simpleString(), "v": collection.schema["vec_id"].dataType.simpleString()}
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "vec_id"))
        best = None
        for block in range(blocks):
            own = _asked(kept.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow(), columns, cells, probes)
            if cells is not None:  # only the cells that are asked for are read
                asked = np.bitwise_or.reduce(own.cells, axis=0) if len(own.cells) else np.zeros(own.cells.shape[1], np.uint8)
                rows = rows.filter(F.col("cell").isin(np.flatnonzero(np.unpackbits(asked, count=len(cells))).tolist())) if blocks == 1 else rows
            sent = spark.sparkContext.broadcast(own)
            found = rows.mapInArrow(_neighbours(sent, k), f"query_id {kinds['q']}, vec_id {kinds['v']}, raw double")
            part = steps.keep(found.withColumn("rank", rank).filter(F.col("rank") <= k))
            best = part if best is None else best.unionByName(part)
            sent.destroy()
        return steps.finish(best.select("query_id", "vec_id", "rank", F.round("raw", 4).alias("score")))


def nearest_batch(collection: DataFrame, queries: DataFrame, k: int, columns: list[str] | None = None) -> DataFrame:
    """(query_id, vec_id, rank, score): the k nearest rows of each of ``queries`` (query_id, query_vector, filters), ties by vec_id.

    Queries are a stated set; ``QUERY_BYTES`` of their vectors go to all tasks
    in one scan. A task multiplies its rows by all of them and looks at the
    nearest again, with sums in order; only the k nearest of a task leave it.
    Vectors that are null, of another size, not finite or without length are
    no one's neighbours and have none. Filters with a value must be equal.
    """
    return _searched(collection, queries, k, columns or [], None, 0)


def fit_cells(collection: DataFrame, n: int | None = None, sample: int = CELL_SAMPLE) -> np.ndarray:
    """Centres of cells as unit vectors, by k-means over a bounded sample: the ``sample`` rows with the lowest hashes of their ids.

    About the square root of the collection's rows, or ``n`` of them; fewer where the sample has fewer vectors.
    """
    n = n or max(1, min(MOST_CELLS, int(collection.count() ** 0.5)))
    rows = collection.filter("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    _, m = _plain(rows.select(F.col("embedding").cast("array<double>").alias("embedding")).toArrow()["embedding"].combine_chunks())
    if not len(m):
        return np.empty((0, 0))
    units = _units(m)
    cells = units[np.unique(np.linspace(0, len(units) - 1, min(n, len(units))).astype(int))]
    for _ in range(CELL_ROUNDS):
        own = _cell(units, cells)
        total = np.zeros_like(cells)
        np.add.at(total, own, units)
        cells = np.where((total != 0).any(1, keepdims=True), total, cells)
        cells = _units(cells)
    return cells


def in_cells(collection: DataFrame, cells: np.ndarray) -> DataFrame:
    """``collection`` with the cell of each row, -1 for a vector that no one is near to; every row is in a cell, whatever the sample was."""
    kind = ", ".join([*(f"`{c}` {t}" for c, t in collection.dtypes if c != "cell"), "cell int"])
    names = [c for c in collection.columns if c != "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(len(batch), -1, np.int32)
            at, m = _plain(batch.column(batch.schema.get_field_index("embedding")))
            if len(at) and len(cells) and m.shape[1] == cells.shape[1]:
                out[at] = _cell(_units(m), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "cell"])

    return collection.select(*names).mapInArrow(run, kind)


def nearest_in_cells(collection: DataFrame, cells: np.ndarray, queries: DataFrame, k: int, probes: int, columns: list[str] | None = None) -> DataFrame:
    """As ``nearest_batch``, among the rows of the ``probes`` cells nearest to each query only; with all cells it is the same.

    ``collection`` is one that ``in_cells`` gave, best stored partitioned by
    cell, so that a few queries read a few cells.
    """
    return _searched(collection, queries, k, columns or [], cells, probes)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, exact.count())
