"""Prompts, tokens as sizes, and recursive splitting."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.prompts import TEMPLATES, prompt
from millrace.operators.splitting import recursive_chunks, split, token_count

words = lambda texts: [len(x.split()) for x in texts]


def test_prompts(spark):
    row = spark.createDataFrame([("why {answer}?", None, "a")], "question string, context string, answer string")
    got = row.select(prompt("answer", question=F.col("question"), context=F.col("context")).alias("p")).first()["p"]
    assert "Question: why {answer}?\nAnswer:" in got and "{question}" not in got and "{context}" not in got and len(TEMPLATES) == 7
    with pytest.raises(ValueError):
        prompt("grade", question=F.col("question"))


def test_split():
    para = lambda n, w: " ".join([w] * n)
    assert split(f"{para(3, 'a')}\n\n{para(3, 'b')}\n\n{para(6, 'c')}", 6, words) == [f"{para(3, 'a')}\n\n{para(3, 'b')}", para(6, "c")]
    assert split(f"{para(2, 'a')}\n{para(9, 'b')}\n{para(2, 'c')}", 4, words) == [para(2, "a"), para(4, "b"), para(4, "b"), "b", para(2, "c")]
    chars = lambda texts: [len(x) for x in texts]
    assert split("abcdefgh", 3, chars) == ["abc", "def", "gh"] and split("", 3, chars) == []


def test_recursive_chunks(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n \n"), (-4, "x" * 5000)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for vocabulary, most in ((None, 100), (path, 60)):
        found = {}
        for r in recursive_chunks(docs, most, vocabulary).orderBy("doc_id", "chunk_no").collect():
            found.setdefault(r.doc_id, []).append(r)
        assert {d for d, x in texts.items() if x and x.strip()} == set(found)
        for d, own in found.items():
            assert "".join("".join(r.text.split()) for r in own) == "".join(texts[d].split())
            assert [r.chunk_no for r in own] == list(range(1, len(own) + 1))
            assert all(r.token_count <= 1.1 * most + 2 or len(r.text) < 3 for r in own)
    assert [r.n for r in docs.filter("doc_id < 0").orderBy("doc_id").select(token_count(F.col("text"), path).alias("n")).collect()][1:] == [len(__import__("tokenizers").Tokenizer.from_file(path).encode("\n \n").ids), 0, 0]


def test_sizes_and_ends_by_pieces():
    """Sizes and ends from pieces are those of whole texts, and a repeated piece goes to the library once."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.operators.splitting import Library

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = Library(path), Tokenizer.from_file(path)
    rng = random.Random(7)
    parts = ["a", "é", "straße", "'ll", "12", " ", "  ", "\n", "\n\n", "\t", "\x85", "\xa0", " ", "　", "\x1c", "x'", "日本", "🙂", ".", "!?", "\r\n", "é", "antidisestablished", "_", "\x00"]
    texts = ["", *("".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(3000)), *(x["content"] + " b" for x in __import__("json").loads(plain.to_str())["added_tokens"])]
    whole = [plain.encode(x, add_special_tokens=False) for x in texts]
    assert own.cut and own.sizes(texts) == [len(x.ids) for x in whole]
    for text, found in zip(texts, whole, strict=True):
        for n in (0, 1, 3, 50):
            assert own.end(text, n) == ("" if n == 0 else text if len(found.offsets) <= n else text[found.offsets[-n][0] :])
    asked = []
    own.known.clear()
    own.known.library = type("Told", (), {"encode": lambda self, x, **k: asked.append(x) or plain.encode(x, **k)})()
    own.sizes(["one two two two"] * 100)
    assert sorted(asked) == [" two", "one"]
    other = Library(public_tokenizers.path("word_bpe_49k.json"))
    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert other.sizes(texts[:500]) == [len(known.encode(x, add_special_tokens=False).ids) for x in texts[:500]]
