"""Sections to chunks: size limits, greedy packing, overlap, labels and ids. Sizes are in words, or in tokens of a vocabulary."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import box_label, chapter_label, normalise_speaker, subsection_label, word_count
from millrace.operators.folds import bind, cut_at, packed_at
from millrace.operators.sections import body, categorised, merged, sections
from millrace.operators.splitting import Library, Measure, Tokens, Words, library, measure, split, word_slices

# The limits of chunks.
BASELINE_WORDS, MOST_WORDS, BOX_MOST_WORDS = 500, 1200, 2000
OVERLAP, BOX_MARK, MARGIN = 50, 60, 50
DROP_BELOW = 15
#: What joining two texts by a blank line may add to their tokens.
JOINT = 2
#: Paragraphs as columns tell them, whose white space is that of ASCII.
BLANK, ASCII_SPACE = re.compile(r"\n\s*\n", re.ASCII), " \t\n\x0b\x0c\r"
KEEP_ANY_SIZE = ["vote", "member", "box"]


def pack(units: Column, sizes, most: int | Column, separator: str, most_units: int | None = None) -> Column:
    """Units joined in order to pieces of at most ``most``; a larger unit is a piece of its own.

    ``sizes`` gives a unit's size. ``most_units`` bounds the units of a piece.
    Null units give no pieces.
    """
    return bind(F.coalesce(units, F.array().cast("array<string>")), lambda own: bind(F.transform(own, sizes), lambda w: cut_at(own, packed_at(w, most, most_units), lambda x: F.array_join(x, separator))))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def token_pieces(text: str, box: bool, heading: str, own: Library) -> list[tuple[str, int, int]]:
    """(text, lead, size) of the pieces of a section by tokens, as ``with_pieces`` tells them."""
    sizes: dict[str, int] = {}

    def size(texts: list[str]) -> list[int]:
        new = [x for x in dict.fromkeys(texts) if x not in sizes]
        sizes.update(zip(new, own.sizes(new), strict=True))
        return [sizes[x] for x in texts]

    n = size([text])[0]
    if n <= (BOX_MOST_WORDS if box else MOST_WORDS):
        return [(text, 0, n)] if text else []
    most = MOST_WORDS - (BOX_MARK if box else OVERLAP)
    blocks = [x for x in (b.strip(ASCII_SPACE) for b in BLANK.split(text)) if x]
    packed: list[list[str]] = []
    total = 0
    for block, n in zip(blocks, size(blocks), strict=True):
        if packed and total + n <= most:
            packed[-1].append(block)
            total += n
        else:
            packed.append([block])
            total = n
    whole = ["\n\n".join(x) for x in packed] if len(blocks) > 1 else [text]
    cut = [y for x, n in zip(whole, size(whole), strict=True) for y in ([x] if n <= most else [z for z in split(x, max(1, most - MARGIN), own.sizes) if z.strip()])]
    if box:
        leads = ["" if x.startswith("[BOX START:") else f"[BOX START: {heading}] (continued)\n\n" for x in cut[1:]]
    else:
        room = [max(0, min(OVERLAP, MOST_WORDS - JOINT - n)) for n in size(cut)[1:]]
        leads = [f"{x}\n\n" if x else "" for x in map(own.end, cut, room)]
    found = [(lead + x, len(lead)) for lead, x in zip(["", *leads], cut, strict=False)]
    return [(x, lead, n) for (x, lead), n in zip(found, size([x for x, _ in found]), strict=True)]


def _by_tokens(text: Column, box: Column, heading: Column, vocabulary: str) -> Column:
    @F.arrow_udf("array<struct<text:string,lead:int,size:long>>")
    def pieces(texts: pa.Array, boxes: pa.Array, headings: pa.Array) -> pa.Array:
        own, kind = library(vocabulary), pa.list_(pa.struct([("text", pa.string()), ("lead", pa.int32()), ("size", pa.int64())]))
        rows = zip(texts.to_pylist(), boxes.to_pylist(), headings.to_pylist(), strict=True)
        return pa.array([[dict(zip(("text", "lead", "size"), x, strict=True)) for x in token_pieces(t or "", bool(b), h or "", own)] for t, b, h in rows], kind)

    return pieces.asNondeterministic()(text, box, heading)


def with_pieces(found: DataFrame, by: Measure | None = None) -> DataFrame:
    """``found`` (text, category, heading) with the pieces of each section: whole within its limit, else packed paragraphs.

    A piece is a struct of its text and lead, the characters at its head that
    the piece before it ends with, or that mark a box as going on, and of its
    size, if that is in tokens. The lead is the last ``OVERLAP`` of the piece
    before as it was, or less where the piece would be too large with it.

    Tokens are measured at every step, so one function does all of them for a
    section, which keeps its text in one place and what it has measured in mind.
    """
    by = by or Words()
    box = F.col("category") == "box_analysis"
    if isinstance(by, Tokens):
        return found.withColumn("pieces", _by_tokens(F.col("text"), box, F.col("heading"), by.vocabulary))
    no_texts = F.array().cast("array<string>")
    sized = found.withColumn("fits_", by.count(F.col("text")) <= F.when(box, BOX_MOST_WORDS).otherwise(MOST_WORDS))
    sized = sized.withColumn("most_", F.when(box, MOST_WORDS - BOX_MARK).otherwise(MOST_WORDS - OVERLAP))
    # What fits has no blocks, so that nothing is measured or packed there.
    cut = sized.withColumn("blocks_", F.when(~F.col("fits_"), paragraphs(F.col("text"))).otherwise(no_texts))
    cut = cut.withColumn("sizes_", by.counts(F.col("blocks_")))
    packed = cut_at(F.col("blocks_"), packed_at(F.col("sizes_"), F.col("most_")), lambda x: F.array_join(x, "\n\n"))
    cut = cut.withColumn("whole_", F.when(F.size("blocks_") > 1, packed).when(~F.col("fits_"), F.array("text")).otherwise(no_texts))
    cut = cut.withColumn("sizes_", by.counts(F.col("whole_")))
    cut = cut.withColumn("cut_", by.capped(F.col("whole_"), F.col("sizes_"), F.col("most_"), MARGIN))
    cut = cut.withColumn("sizes_", by.counts(F.when(box, no_texts).otherwise(F.col("cut_"))))
    following = F.concat(F.slice("sizes_", F.lit(2), F.greatest(F.size("sizes_") - 1, F.lit(0))), F.array(F.lit(MOST_WORDS).cast("long")))
    room = F.transform(F.when(F.size("sizes_") > 0, following).otherwise(F.array().cast("array<long>")), lambda n: F.greatest(F.least(F.lit(OVERLAP).cast("long"), MOST_WORDS - n), F.lit(0).cast("long")))
    cut = cut.withColumn("room_", room).withColumn("tails_", by.tails(F.when(box, no_texts).otherwise(F.col("cut_")), F.col("room_")))
    mark = F.concat(F.lit("[BOX START: "), F.col("heading"), F.lit("] (continued)\n\n"))
    tail = lambda x: F.when(F.coalesce(x["tail"], F.lit("")) == "", "").otherwise(F.concat(x["tail"], F.lit("\n\n")))
    lead = lambda x, i: F.when(i == 0, "").when(box, F.when(x["piece"].startswith("[BOX START:"), "").otherwise(mark)).otherwise(tail(x))
    made = lambda x, i: bind(lead(x, i), lambda y: F.struct(F.concat(y, x["piece"]).alias("text"), F.length(y).alias("lead")))
    zipped = F.arrays_zip(F.col("cut_").alias("piece"), F.concat(F.array(F.lit("")), F.col("tails_")).alias("tail"))
    zipped = F.slice(zipped, F.lit(1), F.size("cut_"))
    whole = F.transform(F.when(F.col("text") == "", no_texts).otherwise(F.array("text")), lambda p: F.struct(p.alias("text"), F.lit(0).alias("lead")))
    pieces = F.when(F.col("fits_") | (F.col("text") == ""), whole).otherwise(F.transform(zipped.cast("array<struct<piece:string,tail:string>>"), made))
    return cut.withColumn("pieces", pieces).drop("fits_", "most_", "blocks_", "sizes_", "whole_", "cut_", "room_", "tails_")


def paragraph_range(document_type: Column, piece: Column, n_pieces: Column) -> Column:
    numbers = F.col("paragraph_numbers")
    low, high = F.array_min(numbers).cast("string"), F.array_max(numbers).cast("string")
    first = lambda *c: F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in c], F.lit(""))
    minutes = (
        F.when(F.size(numbers) > 0, F.when(low == high, low).otherwise(F.concat_ws("-", low, high)))
        .when(F.col("section_type") == "vote", "Vote")
        .when((F.col("section_type") == "member") & (F.col("speaker") != ""), F.col("speaker"))
        .otherwise(first("heading", "parent_h3", "parent_h2"))
    )
    refs = F.filter(F.array(chapter_label(first("parent_h2", "heading")), subsection_label(first("parent_h3", "heading"))), lambda x: x != "")
    part = F.when(n_pieces > 1, F.concat(F.lit("pt"), (piece + 1).cast("string")))
    report = F.when(F.col("section_type") == "box", box_label(F.col("heading"))).when(F.size(refs) > 0, F.concat_ws(" ", F.array_join(refs, " "), part)).otherwise(F.col("heading"))
    return F.when(document_type == "MPC_minutes", minutes).when(document_type.isin("MPR", "FSR"), report).otherwise(F.col("heading"))


def chunk_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The chunks of ``docs`` (doc_id, text, document_type, date, title, source_url, speaker) in order.

    Gives chunk_id, chunk_no (from 1 over what is kept), text, token_count,
    lead (characters at its head that aren't its own) and the metadata. Sizes
    are words, or tokens of the ``vocabulary`` file. Pieces below
    ``DROP_BELOW`` go unless they are votes, statements or boxes.
    """
    by = measure(vocabulary)
    facts = docs.select("doc_id", "document_type", "date", "title", "source_url", F.col("speaker").alias("doc_speaker"))
    known = sections(docs.select("doc_id", "text")).join(docs.select("doc_id", F.col("document_type")), "doc_id")
    joined = merged(categorised(known, F.col("document_type"), by.count)).withColumn("text", body(F.col("lines")))
    found = with_pieces(joined, by).drop("text")
    sized = F.col("own_.size") if isinstance(by, Tokens) else by.count(F.col("own_.text"))
    found = found.select("*", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece", "own_")).drop("pieces").select("*", "own_.text", "own_.lead", sized.alias("token_count"))
    found = found.filter(F.col("section_type").isin(KEEP_ANY_SIZE) | (F.col("token_count") >= DROP_BELOW))
    found = found.join(facts, "doc_id").withColumn("chunk_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "piece")))
    speech = F.col("document_type") == "speech"
    place = F.when(speech, F.col("chunk_no").cast("string")).otherwise(paragraph_range(F.col("document_type"), F.col("piece"), F.col("n_pieces")))
    own = F.when((F.col("section_type") == "member") & (F.col("speaker") != ""), normalise_speaker(F.col("speaker"))).when(speech & (F.col("doc_speaker") != ""), F.col("doc_speaker"))
    return found.select(
        "doc_id", "chunk_no", F.format_string("%s_%s_%03d", F.col("doc_id").cast("string"), "category", "chunk_no").alias("chunk_id"), "text", "token_count", "lead",
        "document_type", "date", F.col("category").alias("section_category"), own.alias("speaker"), "source_url", place.alias("paragraph_range"), "title",
    )


def baseline_chunks(docs: DataFrame, most: int = BASELINE_WORDS) -> DataFrame:
    """Fixed-size chunks without structure: lines packed in order, longer ones cut by words."""
    units = F.filter(F.split("text", "\n+"), lambda x: F.trim(x) != "")
    cut = F.flatten(F.transform(units, lambda u: F.when(word_count(u) <= most, F.array(u)).otherwise(word_slices(u, most))))
    found = docs.select("doc_id", F.posexplode(pack(cut, word_count, most, "\n")).alias("chunk_no", "text"))
    return found.select("doc_id", (F.col("chunk_no") + 1).alias("chunk_no"), F.format_string("baseline_%s_%03d", F.col("doc_id").cast("string"), F.col("chunk_no") + 1).alias("chunk_id"), "text", word_count(F.col("text")).alias("token_count"))
