"""Vector collections kept as Parquet: built from chunks, brought up to date by what changes, and asked.

A collection is a folder of a base, a table (id, text, metadata columns, mark,
embedding), and of deltas, each the rows that one change put in or, as
tombstones, took out. A reader takes the last base and what later deltas say
of an id. A change writes as much as it changes; when the deltas have grown to
a share of the base they are merged into a new one. Bases and deltas are
written aside and then given their names, so readers and failed writers do no
harm to each other, and two writers at once each add a delta of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.vectors import nearest_batch
from millrace.sources import shared

#: An embedder adds a column ``embedding`` to rows with ``text``.
Embedder = Callable[[DataFrame], DataFrame]
SLOTS = 64
#: The share of the base's bytes at which deltas are merged, and the bases that stay for readers who began before.
MERGE_AT, KEEP_BASES = 0.25, 2


def hashed(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Embeddings without a model: counts of a text's words by the slots of their hashes."""
    own = F.transform(F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.pmod(F.xxhash64(w), F.lit(slots)))
    bag = lambda at: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("float"))
    return df.withColumn("embedding", F.get(F.transform(F.array(own), bag), F.lit(0)))


def mark(columns: list[str]) -> Column:
    """What tells whether a record has changed."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


class Collection:
    """The collection in ``path``, with an embedder for records and questions."""

    def __init__(self, spark: SparkSession, path: str, embed: Embedder = hashed, merge_at: float = MERGE_AT):
        self.spark, self.path, self.embed, self.merge_at = spark, path.rstrip("/"), embed, merge_at

    def _named(self, kind: str) -> list[str]:
        """Names of bases or deltas in the order of their numbers: kind-number-writer."""
        return [n for n in shared.names(self.spark, self.path) if n.startswith(f"{kind}-")]

    def _state(self) -> tuple[str | None, list[str]]:
        """The last base, and the deltas that it hasn't taken in, in order."""
        bases = self._named("base")
        if not bases:
            return None, []
        taken = set(shared.names(self.spark, f"{self.path}/{bases[-1]}/_taken"))
        return bases[-1], [d for d in self._named("delta") if d not in taken]

    def _put(self, rows: DataFrame, kind: str, taken: list[str] | None = None) -> str:
        """Write a base or a delta aside and give it its name, after all that there are."""
        aside = f"{self.path}/_new-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        store, _ = shared.place(self.spark, self.path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in taken or []:
            store.mkdirs(path(f"{aside}/_taken/{name}"))
        numbers = [int(n.split("-")[1]) for n in [*self._named("base"), *self._named("delta")]]
        name = f"{kind}-{max(numbers, default=0) + 1:08d}-{uuid.uuid4().hex[:12]}"
        store.rename(path(aside), path(f"{self.path}/{name}"))
        return name

    def _merged(self, base: str, deltas: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{base}")
        if not deltas:
            return rows
        read = lambda k, d: self.spark.read.parquet(f"{self.path}/{d}").withColumn("at_", F.lit(k))
        said = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read(k, d) for k, d in enumerate(deltas)))
        last = said.withColumn("last_", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at_")))).filter("last_ = 1").drop("at_", "last_")
        return rows.join(said.select("id").distinct(), "id", "left_anti").unionByName(last.filter("not gone").drop("gone"), allowMissingColumns=True)

    def read(self) -> DataFrame | None:
        """The records as they are now; None before the first build."""
        base, deltas = self._state()
        return None if base is None else self._merged(base, deltas)

    def _size(self, name: str) -> int:
        store, at = shared.place(self.spark, f"{self.path}/{name}")
        return store.getContentSummary(at).getLength()

    def _changed(self, rows: DataFrame) -> DataFrame:
        """The collection after a delta of ``rows``; merged if the deltas have grown large, without what no reader needs."""
        self._put(rows, "delta")
        base, deltas = self._state()
        if sum(map(self._size, deltas)) > self.merge_at * self._size(base):
            self.merge()
        return self.read()

    def merge(self) -> None:
        """Take all deltas into a new base, and drop old bases and what they had taken in."""
        base, deltas = self._state()
        if base is not None:
            self._put(self._merged(base, deltas), "base", deltas)
        self._tidy()

    def _tidy(self) -> None:
        bases = self._named("base")
        if len(bases) > KEEP_BASES:
            oldest = bases[-KEEP_BASES]
            gone = shared.names(self.spark, f"{self.path}/{oldest}/_taken")
            for name in [*bases[:-KEEP_BASES], *(d for d in self._named("delta") if d in set(gone))]:
                shared.remove(self.spark, f"{self.path}/{name}")

    def count(self) -> int:
        rows = self.read()
        return 0 if rows is None else rows.count()

    def status(self) -> dict:
        """Whether questions can be answered, and over how many records."""
        n = self.count()
        return {"ready": n > 0, "records": n}

    def get(self, ids: DataFrame) -> DataFrame:
        """The records of ``ids`` (id)."""
        return self.read().join(ids.select("id").distinct(), "id", "left_semi")

    def delete(self, ids: DataFrame) -> DataFrame:
        """Take the records of ``ids`` (id) out: a tombstone for each that is there."""
        there = self.read().select("id").join(ids.select("id").distinct(), "id", "left_semi")
        return self._changed(there.withColumn("gone", F.lit(True)))

    def embedded(self, records: DataFrame) -> DataFrame:
        return self.embed(records.withColumn("mark", mark(records.columns)))

    def upsert(self, records: DataFrame) -> DataFrame:
        """The records in place of or beside those that there are; only new or changed ones are embedded and written."""
        old = self.read()
        if old is None:
            self._put(self.embedded(records), "base")
            return self.read()
        marked = records.withColumn("mark", mark(records.columns))
        fresh = self.embed(marked.join(old.select("id", "mark"), ["id", "mark"], "left_anti"))
        return self._changed(fresh.withColumn("gone", F.lit(False)))

    def index(self, records: DataFrame, force: bool = False) -> tuple[DataFrame, bool]:
        """The collection of exactly these records, and whether it was built: it is skipped while counts agree, unless forced.

        Counts don't tell changed records; ``upsert`` does.
        """
        old = self.read()
        if old is not None and not force and old.count() == records.count():
            return old, False
        self._put(self.embedded(records), "base", self._named("delta"))
        self._tidy()
        return self.read(), True

    def search(self, questions: DataFrame, k: int, filters: list[str] | None = None) -> DataFrame:
        """``search`` in the records as they are now."""
        return search(self.read(), self.embed, questions, k, filters)


def search(records: DataFrame, embed: Embedder, questions: DataFrame, k: int, filters: list[str] | None = None) -> DataFrame:
    """(question_id, chunk_id, text, score, rank): the k nearest of ``records`` (id, text, embedding) to each question, under its filters with a value."""
    asked = embed(questions.withColumn("text", F.coalesce("rewritten", "question"))).select("question_id", F.col("embedding").alias("query_vector"), *(filters or []))
    rows = records.withColumnRenamed("id", "vec_id")
    found = nearest_batch(rows, asked.withColumnRenamed("question_id", "query_id"), k, filters)
    found = found.join(rows.select("vec_id", "text"), "vec_id")
    return found.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("chunk_id"), "text", "score", "rank")


def records(chunks: DataFrame) -> DataFrame:
    """Chunks as records: chunk_id is the id, a null speaker is empty, as filters compare plain values."""
    out = chunks.withColumnRenamed("chunk_id", "id")
    return out.withColumn("speaker", F.coalesce("speaker", F.lit(""))) if "speaker" in out.columns else out


def build_index(spark: SparkSession, chunks: DataFrame, baseline: DataFrame, path: str, embed: Embedder = hashed, force: bool = False) -> dict[str, int]:
    """Both collections, of chunks with metadata and of baseline chunks without, and how many records each has."""
    out = {}
    for name, rows in (("enhanced", records(chunks)), ("baseline", baseline.select(F.col("chunk_id").alias("id"), "text"))):
        built, _ = Collection(spark, f"{path.rstrip('/')}/{name}", embed).index(rows, force)
        out[name] = built.count()
    return out
