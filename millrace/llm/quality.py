"""Quality rules from line frequencies across the documents of a host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise

SPACE = r"[\x20\x09-\x0D]"
#: A line is boilerplate of its host if more than this share of the host's documents hold it, at least so many, of two texts or more.
SHARE, AT_LEAST = 0.1, 5
#: A document is depleted if less than this share of its words is left without boilerplate.
LEFT = 0.2
MIN_WORDS, MOST_REPEATED = 50, 50
#: Parts among which the documents of a host are dealt where its list of lines is too large to go to all tasks.
SALTS = 64


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), has_word)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_key(line: Column) -> Column:
    """Hash of a line without outer white space, in lower case, digits alike."""
    trimmed = F.trim(F.translate(line, "\t\n\x0b\x0c\r", " " * 5))
    return F.xxhash64(F.translate(F.lower(trimmed), "123456789", "000000000"))


def line_keys(text: Column) -> Column:
    return F.array_distinct(F.transform(lines(text), line_key))


def repeated_words(found: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""

    def covered(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

        def spread(h: Column) -> Column:
            paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def places(s: Column) -> Column:
                m = F.size(s)
                same = lambda x, k: (k >= 0) & (k < m) & (F.get(s, k)["h"] == x["h"])
                return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

            def length(p: Column) -> Column:
                steps = F.zip_with(F.slice(p, F.lit(2), F.size(p)), p, lambda b, a: F.when(b.isNull(), F.lit(3)).otherwise(F.least(b - a, F.lit(3))))
                return F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + x)

            return bind(bind(paired, places), length)

        with_repeats = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(spread(h)))
        return F.when(n < 4, F.lit(0).cast("long")).otherwise(with_repeats)

    return bind(found, covered)


def boilerplate(docs: DataFrame, share: float = SHARE, at_least: int = AT_LEAST) -> DataFrame:
    """(source, common): the keys of each host's lines that too many of its documents hold.

    A line that only copies of one text hold is none: it tells nothing of the
    host. No host has more such keys than 1 / share times the lines of its
    mean document. Written to the shared folder, so that the planner
    broadcasts it only if its size allows.
    """
    held = docs.filter("text is not null").select("source", F.xxhash64("text").alias("t"), F.explode(line_keys(F.col("text"))).alias("key"))
    counts = held.groupBy("source", "key").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).filter((F.col("n") >= at_least) & (F.col("low") != F.col("high")))
    sizes = docs.groupBy("source").agg(F.count("*").alias("of"))
    common = counts.alias("c").join(sizes.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).filter(F.col("n") > share * F.col("of"))
    return materialise(common.groupBy("c.source").agg(F.collect_list("key").alias("common")))


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` with the list ``common`` of their source, if it has one, as columns d.* and b.common.

    The documents of a host are dealt to ``SALTS`` parts, each with a copy of
    the list, so that no host is one key of the join.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    dealt = docs.withColumn("salt_", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in plain)), F.lit(SALTS)))
    parts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    lists = lists.select(F.col("source").alias("host"), "common", F.explode(parts).alias("part"))
    return dealt.alias("d").join(lists.alias("b"), F.col("d.source").eqNullSafe(F.col("b.host")) & (F.col("d.salt_") == F.col("b.part")), "left")


def quality(docs: DataFrame, share: float = SHARE, at_least: int = AT_LEAST, left: float = LEFT) -> DataFrame:
    """``docs`` (text, source, any more) with the base counts, verdicts and clean_text.

    clean_text is the text without its host's boilerplate lines. kept is false
    if base_failed, or if fewer than ``left`` of the words remain in
    clean_text. A null text counts as no words and fails; its clean_text is
    null. Null hosts are one host. Any other null, ties, repeated rows and an
    empty table are as for any text. Columns of docs named like results are
    replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left_words", "base_failed", "depleted", "kept", "clean_text"]
    docs = docs.drop(*made)
    known = with_lists(docs, boilerplate(docs, share, at_least))
    text = F.coalesce(F.col("d.text"), F.lit(""))
    gone = F.when(F.col("b.common").isNotNull(), F.array_intersect(line_keys(text), F.col("b.common")))
    out = known.select(
        *(F.col(f"d.`{c}`") for c in docs.columns),
        words(text).alias("words_"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        gone.alias("gone_"),
    )
    without = bind(F.col("gone_"), lambda g: F.array_join(F.filter(F.split("text", "\n"), lambda line: ~has_word(line) | ~F.array_contains(g, line_key(line))), "\n"))
    out = out.select(
        *docs.columns,
        F.size("words_").cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col("words_")).alias("n_repeat_words"),
        F.when(F.size("gone_") > 0, without).otherwise(F.col("text")).alias("clean_text"),
        F.coalesce(F.size("gone_") > 0, F.lit(False)).alias("lost_"),
    )
    out = out.withColumn("n_left_words", F.when(F.col("lost_"), F.size(words(F.coalesce("clean_text", F.lit("")))).cast("long")).otherwise(F.col("n_words")))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    out = out.withColumn("depleted", F.col("n_left_words") < left * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).select(*docs.columns, *made)
