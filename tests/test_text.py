"""Analysis of texts."""

from collections import Counter

import regex
import pytest
from pyspark.sql import functions as F

from lumenary.functions import text
from lumenary.functions.stem import stem
from lumenary.functions.text import ENGLISH_STOP_WORDS, Analyzer, trigrams
from lumenary.functions.values import RequestError

TEXTS = ["The quick, brown fox—jumps! over 2 lazy dogs", "ÉCOLE Straße café", "", None, "日本語 text", "a b  c d", "foo_bar it's x2y", "ok 👍🏽 done"]


@pytest.mark.parametrize("own", [Analyzer(), Analyzer(case_sensitive=True), Analyzer(remove_stopwords=True), Analyzer(max_token_length=4), Analyzer(tokenizer="whitespace"), Analyzer(stemming=True), Analyzer(ascii_folding=True), Analyzer(tokenizer="word_v2"), Analyzer(tokenizer="word_v3")])
def test_columns_and_strings_agree(spark, own):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    got = {r.id: r.x for r in df.select("id", own.column(df.t).alias("x")).collect()}
    assert got == {i: own.terms(t) for i, t in enumerate(TEXTS)}


def test_terms():
    assert Analyzer().terms(TEXTS[0]) == ["the", "quick", "brown", "fox", "jumps", "over", "2", "lazy", "dogs"]
    assert Analyzer(remove_stopwords=True, stemming=True).terms(TEXTS[0]) == ["quick", "brown", "fox", "jump", "over", "2", "lazi", "dog"]
    assert Analyzer(ascii_folding=True).terms(TEXTS[1]) == ["ecole", "straße", "cafe"]
    assert Analyzer(tokenizer="word_v2").terms("日本語 text 👍🏽") == ["日", "本", "語", "text", "👍🏽"]
    assert Analyzer(tokenizer="word_v3").terms("it's 3.14 ok") == ["it's", "3.14", "ok"]
    assert Analyzer(max_token_length=3).terms("abc abcd") == ["abc"]
    assert Analyzer().terms(["Two words", None, "more"]) == ["two", "words", "more"]
    assert Analyzer(tokenizer="pre_tokenized_array").terms(["Two words", "more"]) == ["two words", "more"]


def test_arrays_of_texts(spark):
    df = spark.createDataFrame([(["Two words", None, "more"],), (None,), ([],)], "t array<string>")
    assert [r.x for r in df.select(Analyzer().column(df.t, array=True).alias("x")).collect()] == [["two", "words", "more"], [], []]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("hoping", "hope"), ("falling", "fall"), ("relational", "relat"), ("conditional", "condit"), ("rationalize", "ration"), ("electricity", "electr"), ("hopefulness", "hope"), ("goodness", "good"), ("adjustment", "adjust"), ("communism", "communism"), ("generally", "general"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("sky", "sky"), ("happy", "happi"), ("say", "say"), ("knightly", "knight"), ("consistency", "consist"), ("knackeries", "knackeri"), ("inning", "inning"), ("by", "by"), ("archeology", "archeolog"), ("controlling", "control")])
def test_stems(word, want):
    assert stem(word) == want


def test_stop_words_and_options():
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 33
    for bad in ({"tokenizer": "ngram"}, {"stemming": True, "language": "german"}, {"remove_stopwords": True, "language": "german"}, {"k1": 4}, {"b": 2}, {"k3": 0}, {"max_token_length": 0}, {"unknown": 1}):
        with pytest.raises(RequestError):
            Analyzer.declared(bad)
    assert Analyzer.declared({"remove_stopwords": True, "language": "german", "stopwords": ["der"]}).terms("Der Hund") == ["hund"]


def test_trigrams(spark):
    df = spark.createDataFrame([("Banana",), ("ab",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(trigrams(df.t).alias("x")).collect()][:3] == [["ban", "ana", "nan"], [], []]


def test_word_classes_agree_with_unicode(spark):
    chars = "".join(chr(c) for c in range(32, 0x3000) if not 0xD800 <= c < 0xE000 and regex.match(r"\p{Assigned}", chr(c)))
    df = spark.createDataFrame([(chars,)], "t string")
    got = df.select(Analyzer(case_sensitive=True).column(df.t).alias("x")).first().x
    want = Analyzer(case_sensitive=True).terms(chars)
    both = set("".join(got)) ^ set("".join(want))
    assert len(both) < 0.02 * len(set("".join(want)))  # the two Unicode versions differ in a few letters


@pytest.mark.parametrize("own", [Analyzer(), Analyzer(stemming=True, ascii_folding=True, remove_stopwords=True), Analyzer(tokenizer="whitespace", stemming=True), Analyzer(tokenizer="word_v2"), Analyzer(max_token_length=4, ascii_folding=True)])
def test_counts_of_terms(spark, own):
    texts = [*TEXTS, "Dogs and dogs' École écoles", "the running DOG ran, dogs run"]
    got = own.counts(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"))
    assert {r.term: r.n for r in got.collect()} == Counter(t for x in texts for t in own.terms(x))


def test_stems_are_of_distinct_words_not_of_texts(spark):
    from lumenary.plans.catalogue import QUERIES

    plan = QUERIES["terms_stemmed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("EvalPython") :]
    assert "Aggregate [word" in below and plan.count("EvalPython") == 1


def test_few_terms_are_held_at_a_time(monkeypatch):
    class Held(list):
        now = most = 0

        def __init__(self, n):
            super().__init__(["x"] * n)
            Held.now += n
            Held.most = max(Held.most, Held.now)

        def __del__(self):
            Held.now -= len(self)

    monkeypatch.setattr(text, "HELD_TERMS", 100)
    out = text.listed([30] * 50 + [0, 250], Held)
    assert [len(x) for x in out] == [30] * 50 + [0, 250] and Held.most <= 350
    assert text.listed([], Held).to_pylist() == []
