"""What a task holds of the texts at once."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import bpe, langid, shingles

VOCABULARY = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("prepare", [lambda d: bpe.encode_decode(d, VOCABULARY), langid.train, shingles.near_duplicates], ids=["bpe", "langid", "shingles"])
def test_texts_come_to_python_in_small_batches(spark, prepare):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    one = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    prepare(one)

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches)

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))  # 15 MB
    found = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 3000 and max(r.size for r in found) < 3 << 20


def test_a_value_of_the_user_stays(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    bpe.encode_decode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), VOCABULARY)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_numbers_of_parts_are_those_of_the_whole():
    parts = [[], ["b", "a", "b"], [], ["c", "", "a"], ["é"]]
    distinct, numbers = bpe._numbered([pa.array(p, pa.string()) for p in parts])
    assert distinct.to_pylist() == ["b", "a", "c", "", "é"] and numbers.tolist() == [0, 1, 0, 2, 3, 1, 4]
    distinct, numbers = bpe._numbered([pa.array([], pa.string())])
    assert len(distinct) == 0 and np.array_equal(numbers, [])


def test_bpe_of_more_texts_than_a_slice(spark):
    texts = [f"w{i % 7} and  {i} x" if i % 3 else f"t{i} {'ab ' * (i % 5)}c" for i in range(2500)] + ["", None, " ", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: bytes(r.decoded).decode() for r in bpe.encode_decode(docs, VOCABULARY).collect()}
    assert found == {i: t or "" for i, t in enumerate(texts)}


def test_plain_units_are_cut_as_by_the_pattern():
    import itertools

    import regex

    assert bpe.PLAIN == public_tokenizers.PATTERN
    find, cut = regex.compile(bpe.PLAIN).findall, bpe._finder(bpe.PLAIN)
    for unit in ("".join(x) for n in range(5) for x in itertools.product("aS's.,?1é\n", repeat=n)):
        assert cut(" ", unit) == find(" " + unit) and cut("", unit) == find(unit)
    for letter in map(chr, range(0x300)):  # the first of no Latin letters included
        assert all(cut(" ", u) == find(" " + u) for u in (letter, letter + ",", "a" + letter))
    assert bpe._finder(r"\p{L}|.")(" ", "ab") == [" ", "a", "b"]  # another pattern has cuts of its own
    assert bpe._listed(pa.array(["b", "", "é"]).cast(pa.binary())) == [b"b", b"", "é".encode()]


def test_plain_units_are_not_searched(monkeypatch):
    import regex

    searched, compiled = [], regex.compile(bpe.PLAIN)
    monkeypatch.setattr(regex, "compile", lambda p: type("Searches", (), {"findall": staticmethod(lambda s: [searched.append(s), compiled.findall(s)][1])}))
    cut = bpe._finder(bpe.PLAIN)
    assert [cut(" ", u) for u in ("ab", "é,", "a'b", "ж")] == [[" ab"], [" é", ","], [" a", "'", "b"], [" ж"]] and searched == [" a'b", " ж"]
