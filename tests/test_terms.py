"""Terms of a dictionary in texts, against a search text by text."""

import random

from pyspark.sql import functions as F

from trialkit.operators.joins import match_terms


def _found(spark, texts, terms, ends=()):
    t = spark.createDataFrame([(x,) for x in texts], "name string")
    d = spark.createDataFrame([(x,) for x in terms], "term string")
    return {(r["text"], r["term"]) for r in match_terms(t, "name", d, "term", ends).collect()}


def test_terms_equal_a_plain_search(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [word(rng.randrange(0, 30)) for _ in range(200)] + [None, "", "a", "a"]
    terms = {word(n) for n in (1, 2, 3, 4, 5, 7, 8, 9, 16) for _ in range(6)} | {"zzz" * 40}
    ends = sorted(terms)[:10]
    want = {(x, k) for x in texts if x for k in terms if (x.endswith(k) if k in ends else k in x)}
    assert want and _found(spark, texts, [*terms, *terms, None, ""], ends) == want


def test_terms_of_nothing(spark):
    assert _found(spark, ["a"], []) == set() and _found(spark, [], ["a"]) == set() and _found(spark, [None], [None, ""]) == set()


def test_a_large_dictionary(spark):
    n = 1_000_000
    terms = spark.range(n).select(F.concat(F.lit("code-"), F.col("id").cast("string"), F.lit("x")).alias("term"))
    texts = spark.range(300).select(F.concat(F.lit("drug code-"), (F.col("id") * 7919).cast("string"), F.lit("x mg")).alias("name"))
    found = match_terms(texts, "name", terms, "term")
    assert found.count() == sum(7919 * i < n for i in range(300))
