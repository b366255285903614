"""Secret scanning with a ledger of blobs: each text is scanned once for each version of the rules.

A blob is a text by its SHA-256. The ledger holds (blob, rules, spans) for
every blob that was scanned under a rule version, with or without findings;
it is a Parquet folder that each update extends. An update takes the distinct
blobs of all rows, be they versions of one path or copies at several, drops
those that the ledger has for the current rules, and scans the rest. Findings
are joined back to every row. The rule version is a hash of the rules.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, shared_dir, tidy

KINDS = ("assign", "access", "hex", "pem", "jwt", "forge")
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_names = "|".join(_either(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"({_names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
#: Kinds beyond the base ones.
MORE = {
    "pem": re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "forge": re.compile("(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
}
#: A run of characters of a web token, of which each part is a whole run but the first, which begins in one.
RUN = re.compile("[A-Za-z0-9_-]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_PART = 6, 20, 8
RULES = hashlib.sha256(repr([LEAST_VALUE, LEAST_ACCESS, *((k, x.pattern) for k, x in [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *MORE.items()])]).encode()).hexdigest()[:16]
LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>"


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """The spans of ``MORE["jwt"]``, in time linear in the text.

    What follows ``eyJ`` to the end of its run is the first part, so if it is
    no token, neither is another ``eyJ`` of that run.
    """
    at = text.find("eyJ")
    while at >= 0:
        end = RUN.match(text, at).end()
        ends = [end] if end - at >= 3 + LEAST_PART else []
        while ends and len(ends) < 3 and text.startswith(".", ends[-1]):
            part = RUN.match(text, ends[-1] + 1)
            if part is None or part.end() - part.start() < LEAST_PART:
                break
            ends.append(part.end())
        if len(ends) == 3:
            yield at, ends[-1]
            end = ends[-1]
        at = text.find("eyJ", end)


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, rule in MORE.items():
        found += [(kind, *x) for x in (web_tokens(text) if kind == "jwt" else (m.span() for m in rule.finditer(text)))]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = [scan(x.as_py()) for x in batch.column(1)]
        base = [[x for x in r if x[0] in KINDS[:3]] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([RULES] * len(rows), pa.string()),
                *(pa.array([sum(x[0] == k for x in r) for r in rows], pa.int64()) for k in KINDS[:3]),
                pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string()),
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], spans),
            ],
            names=["blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def blob(col: str = "text"):
    return F.sha2(F.coalesce(F.col(col), F.lit("")), 256)


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: str = RULES) -> DataFrame:
    """(blob, text) of each text of ``docs`` that the ledger lacks for the rules, once.

    Copies are folded within each task before any text is moved.
    """
    texts = docs.select(blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return texts
    # Not an anti join, which the planner would move below the folding of the copies.
    seen = ledger.filter(F.col("rules") == rules).select("blob", F.lit(True).alias("seen"))
    return texts.join(seen.hint("merge"), "blob", "left").filter("seen is null").drop("seen")


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in the folder; None if there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return spark.read.schema(LEDGER).parquet(folder) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None


def update(docs: DataFrame, folder: str) -> DataFrame:
    """The ledger in ``folder``, extended by an entry for each blob of ``docs`` (text, any more) under the current rules.

    Only unseen blobs are scanned. An update that is run again, or two at
    once, may give a blob the same entry twice, which readers pass over.
    """
    spark = docs.sparkSession
    unseen(docs, load(spark, folder)).mapInArrow(tidy(_scan), LEDGER).write.mode("append").parquet(folder)
    return load(spark, folder)


def findings(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` (text, any more, such as path and version) with blob, n_assign, n_access, n_hex, base_sha256, spans.

    ``ledger`` is one that ``update`` gave for these rows; without one, all
    blobs are scanned into a new one. A null text is scanned as an empty one.
    Repeated rows each get the findings of their blob. Columns of docs named
    like results are replaced. Spans count code points, the end is exclusive;
    they may overlap between kinds, not within one.
    """
    made = ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    docs = docs.drop(*made)
    ledger = update(docs, shared_dir(docs.sparkSession)) if ledger is None else ledger
    # Written, so that the rows of a blob that many hold can be split between tasks.
    entries = materialise(ledger.filter(F.col("rules") == RULES).drop("rules").dropDuplicates(["blob"]))
    out = docs.withColumn("blob", blob()).alias("d").join(entries.alias("e"), F.col("d.blob") == F.col("e.blob"), "left")
    return out.select(*(F.col(f"d.`{c}`") for c in docs.columns), *(F.col(f"{'d' if c == 'blob' else 'e'}.{c}") for c in made))
