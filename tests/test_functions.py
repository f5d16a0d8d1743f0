import json
import re
import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmap.functions import text, works
from corpusmap.functions.fixed import STOPWORDS


def value(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "index, wanted",
    [
        (None, ""),
        ({}, ""),
        ({"a": [0], "b": [5]}, "a b"),
        ({"a": [0, 2], "b": [1]}, "a b a"),
        ({"a": [0], "b": [0, 1]}, "b b"),
        ({"a": [1], "": [0, 1]}, ""),
        ({"": [0], "a": [1]}, "a"),
        ({"a": [], "b": []}, ""),
        ({"a": None, "b": [3]}, "b"),
    ],
)
def test_abstract_from_inverted_index(spark, index, wanted):
    # JSON keeps the order of the entries.
    parsed = F.from_json("j", "map<string,array<int>>")
    raw = None if index is None else json.dumps(index)
    got = value(spark, works.abstract_from_inverted_index(parsed), "j string", (raw,))
    assert got == wanted


AUTHORS = "a array<struct<institutions:array<struct<id:string,ror:string,display_name:string>>>>"


@pytest.mark.parametrize(
    "authors, wanted",
    [
        (None, ""),
        ([], ""),
        ([(None,), ([],), ([("i", "r", "Second")],), ([("j", "r", "Third")],)], "Second"),
        ([([("i", "r", None), ("i", "r", "Other")],)], ""),
    ],
)
def test_first_institution(spark, authors, wanted):
    assert value(spark, works.first_institution(F.col("a")), AUTHORS, (authors,)) == wanted


@pytest.mark.parametrize("landing, wanted", [(None, "W"), ("", "W"), ("http://x", "http://x")])
def test_best_url(spark, landing, wanted):
    got = value(spark, works.best_url(F.col("l"), F.lit("W")), "l string", (landing,))
    assert got == wanted


@pytest.mark.parametrize(
    "external, native, wanted",
    [("https://ror.org/0abc", "https://x/I1", "0abc"), (None, "https://x/I1", "I1"), ("https://y/z", "https://x/I1", "I1")],
)
def test_institution_key(spark, external, native, wanted):
    got = value(
        spark, works.institution_key(F.col("e"), F.col("n")), "e string, n string", (external, native)
    )
    assert got == wanted


def test_downcast_raises_on_overflow(spark):
    fits = spark.createDataFrame([(2147483647,)], "v bigint")
    assert works.downcast(fits).first()["v"] == 2147483647
    over = spark.createDataFrame([(2147483648,)], "v bigint")
    with pytest.raises(PySparkException):
        works.downcast(over).collect()


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2), (None, 3)], "v double, k int")
    assert [r["v"] for r in works.nan_to_null(df).orderBy("k").collect()] == [None, 2.0, None]


def test_minmax_scale_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r["scaled"] for r in works.minmax_scale(df, "v").collect()} == {0.0}


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([("a", None), ("é", 2)], "s string, n int")
    written = works.to_json_rows(df)
    assert '"n":null' in written.where("json like '%\"a\"%'").first()["json"]
    assert sorted(works.parse_json_rows(written, "json", df.schema).collect()) == sorted(df.collect())


@pytest.mark.parametrize(
    "title, abstract, wanted", [(None, "b", ". b"), ("a", None, "a. "), (None, None, ". ")]
)
def test_embedding_text(spark, title, abstract, wanted):
    got = value(
        spark, text.embedding_text(F.col("t"), F.col("a")), "t string, a string", (title, abstract)
    )
    assert got == wanted


def test_strip_jats(spark):
    raw = "<Title>A</title> &lt;jats:p&gt;b&lt;/JATS:P&gt; <i>c</i> <title&gt;"
    assert value(spark, text.strip_jats(F.lit(raw))) == "A b <i>c</i> <title&gt;"


@pytest.mark.parametrize("n, wanted", [(3, "abc…"), (4, "abcd")])
def test_truncate(spark, n, wanted):
    assert value(spark, text.truncate(F.lit("abcd"), n, "…")) == wanted


def test_source_name(spark):
    assert value(spark, text.source_name(F.lit("openalex"))) == "OpenAlex"
    assert value(spark, text.source_name(F.lit("other"))) == "other"


TEXTS = [
    "Año niños ESPAÑA abcd1 word_x Hello-world don't",
    "école coöperate ﬁnally ﬂower straße ǆabcd ｆｕｌｌ Ｗidth",
    "Привет words слово 你好abcd wörld² naïve",
    "ábcd éclair plain ascii text only",
    "𝐀𝐁𝐂𝐃 carbon™ ℡line ㎏ abcd⅓ x²abcd",
    "Ελληνικά γράμματα Ά ΐ words ｶﾞabcd ﷺ and",
]


def python_tokens(raw):
    # Fixed value: the pattern of a label word.
    low = unicodedata.normalize("NFKD", raw.lower())
    folded = "".join(c for c in low if not unicodedata.combining(c))
    return folded, re.findall(r"(?u)\b[a-zA-Z]{4,}\b", folded)


@pytest.mark.parametrize("raw", TEXTS)
def test_tokens_match_unicode_rules(spark, raw):
    folded, tokens = python_tokens(raw)
    df = spark.createDataFrame([(raw,)], "t string")
    fast = text.normalize_text(F.col("t"))
    row = df.select(
        text.tokenize(fast).alias("tokens"), text.normalize_any_text(F.col("t")).alias("any")
    ).first()
    assert row["tokens"] == tokens
    assert row["any"] == folded


def test_stopwords_keep_repeats_of_other_words(spark):
    assert len(STOPWORDS) == len(set(STOPWORDS))
    words = F.array(*map(F.lit, ["this", "cell", "this", "cell", "with"]))
    assert value(spark, text.remove_stopwords(words)) == ["cell", "cell"]


def test_term_counts(spark):
    words = F.array(*map(F.lit, ["b", "a", "b"]))
    assert [tuple(r) for r in value(spark, text.term_counts(words))] == [("a", 1), ("b", 2)]
    assert value(spark, text.term_counts(F.array().cast("array<string>"))) == []


def test_capitalize(spark):
    assert value(spark, text.capitalize(F.lit("wORD"))) == "Word"


@pytest.mark.parametrize("words", [["b", "a", "b", "", "a", "b"], [""], ["é", "E", "é"], []])
def test_inverted_index(spark, words):
    index = value(spark, works.inverted_index(F.col("w")), "w array<string>", (words,))
    assert index == {w: [i for i, x in enumerate(words) if x == w] for w in words}
    assert value(spark, works.abstract_from_inverted_index(works.inverted_index(F.col("w"))), "w array<string>", (words,)) == " ".join(
        w for w in words if w
    )


def test_only_indexes_of_repeated_keys_are_exchanged(spark):
    rows = [(1, ["a", "b"]), (2, ["x", "y", "x"]), (2, ["x", "y", "x"]), (None, ["n"]), (None, ["n", "m"]), (3, [])]
    indexes = spark.createDataFrame(rows, "id int, words array<string>").select("id", works.inverted_index(F.col("words")).alias("index"))
    merged = works.merge_indexes(indexes, "id")
    got = [(r["id"], {w: sorted(at) for w, at in r["index"].items()}) for r in merged.collect()]
    want = [(None, {"n": [0, 0], "m": [1]}), (1, {"a": [0], "b": [1]}), (2, {"x": [0, 0, 2, 2], "y": [1, 1]}), (3, {})]
    assert sorted(got, key=lambda r: r[0] or 0) == want
    # Before: two exchanges of every word.
    single = works.merge_indexes(indexes.where("id = 1 OR id = 3"), "id").where("id IS NOT NULL")
    assert single.count() == 2
