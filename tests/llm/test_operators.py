"""General interfaces of the operators: rare paths, parameters and properties that the queries do not reach."""

import collections
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_queries import plain_groups, plain_marks
from trialkit.llm import chat, decontamination, jaccard, language, quality_model, quality_rules, sharding, token_spans, toxicity, words
from trialkit.llm.components import components

DOCS = "doc_id long, text string"


def buffers(texts):
    import pyarrow as pa

    return words.buffers(pa.array(texts, pa.string()))


# --- near duplicates


def families(rng, count=12, size=14, length=60):
    out, doc = [], 0
    passage = [f"shared{i}" for i in range(25)]
    for f in range(count):
        base = [f"f{f}w{i}" for i in range(length)]
        if f % 3 == 0:
            base[10:35] = passage
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            out.append((doc, " ".join(text)))
            doc += 1
    return out


@pytest.mark.parametrize(("small", "block", "num"), [(8, 256, 75), (2, 256, 75), (2, 3, 75), (2, 4, 60)])
def test_much_shared_keys_lose_no_link(spark, monkeypatch, small, block, num):
    monkeypatch.setattr(jaccard, "COMPARE_BLOCK", block)
    rows = families(random.Random(small * 100 + block + num))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), num=num, small=small).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == plain_groups(rows, num)


def test_stragglers_meet_all_texts_of_a_key_much_shared_in_one_run(spark):
    rng, base = random.Random(55), [f"w55x{i}" for i in range(60)]  # numbers for which a link has no other key than much shared ones

    def edited(at):
        return " ".join([*base[:at], f"e{rng.randrange(10**9)}", *base[at + 1 :]])

    loose = [(i, edited(6 * (i % 9) + 4)) for i in range(54)]
    stragglers = [(100 + i, edited(at)) for i, at in enumerate((7, 25, 43))]
    parts = spark.sparkContext.union([spark.sparkContext.parallelize(loose, 1), spark.sparkContext.parallelize(stragglers, 3)])
    got = jaccard.near_duplicates(spark.createDataFrame(parts, DOCS)).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == plain_groups(loose + stragglers)


def test_every_linked_pair_shares_a_key():
    rng, law = np.random.default_rng(3), jaccard.Similarity()
    for n in (1, 2, 3, 4, 5, 7, 8, 15, 16, 31, 32, 60, 127, 128, 300, 1000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            common = rng.choice(a, 40) if rng.random() < 0.5 else a[: rng.integers(0, len(a) + 1)]
            drop = rng.integers(0, max(1, len(a) // 4 + 1))
            b = np.union1d(rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, max(1, len(a) // 6 + 1))).astype(np.uint64))
            if not len(b) or not law.linked(len(a), len(b), len(np.intersect1d(a, b))):
                continue
            common = np.unique(common)
            assert len(np.intersect1d(jaccard.keys(a, law, common), jaccard.keys(b, law, common)))
            x, y = (np.frombuffer(jaccard.parity(s), np.uint64) for s in (a, b))
            assert jaccard.distance(x, y) <= len(np.setxor1d(a, b)) <= law.difference(len(a), len(b))


def test_components_of_a_chain_and_of_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (None, 5), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "d"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 9])))) for i in range(9)]
    docs = [(i, " ".join(rng.choice([*vocabulary, "x"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    marked = decontamination.mark(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), "found", window=5)
    got = []
    for r in marked.collect():
        f = r["found"]
        covered = {i for s in f["spans"] for i in range(s["first"], s["last"] + 1)}
        assert len(covered) == f["n_hit"] and r["text"] is not None
        got.append((r["doc_id"], f["n_words"], f["n_hit"], len(f["items"]), decontamination.digest(f["items"]), f["n_hit"] > 0 and 20 * f["n_hit"] >= f["n_words"]))
    assert sorted(got, key=repr) == plain_marks(docs, items, 5)


def test_result_name_must_be_free(spark):
    with pytest.raises(ValueError):
        decontamination.mark(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, found long"), spark.createDataFrame([], "item_id long, text string"), "found")


# --- sharding


def test_weighted_shards_and_growth(spark):
    weights = {0: 1.0, 1: 2.0, 2: 5.0}
    df = spark.range(40_000).select(sharding.shard_of(F.col("id"), weights).alias("s"), sharding.shard_of(F.col("id"), weights | {3: 2.0}).alias("g"))
    counts = collections.Counter((r["s"], r["g"]) for r in df.collect())
    total = collections.Counter()
    for (s, g), n in counts.items():
        total[s] += n
        assert g in (s, 3)
    assert all(abs(total[s] / 40_000 - w / 8) < 0.01 for s, w in weights.items())
    assert abs(sum(n for (s, g), n in counts.items() if g == 3) / 40_000 - 0.2) < 0.01


def test_many_copies_of_one_row_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPY_BLOCK", 7)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    df = spark.createDataFrame([(1, "x")] * 50 + [(i, "y") for i in range(2, 80)] + [(None, None)] * 3, DOCS)
    rows = sharding.assign(df, shards=4).collect()
    assert len(rows) == 131
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_a_key_on_many_texts_is_numbered_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    df = spark.createDataFrame([(None, f"text {i}") for i in range(400)] + [(i, "y") for i in range(60)], DOCS)
    got = sharding.assign(df, shards=4)
    rows = got.collect()
    assert len(rows) == 460 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    hashes = df.where("doc_id IS NULL").select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 50).alias("top")).distinct().count()
    assert hashes > 100  # the order that cuts the buckets does not follow the key alone


def test_shards_do_not_replace_a_column(spark):
    df = spark.range(3).withColumn("Shard", F.lit("kept"))
    with pytest.raises(ValueError):
        sharding.with_shard(df, "id", 4)
    assert sharding.with_shard(df, "id", 4, "part").columns == ["id", "Shard", "part"]


# --- quality rules


def test_upper_bounds_are_exact():
    for n, k in ((1, 0), (20, 0), (20, 3), (300, 7), (50, 49)):
        p = quality_rules.upper_bound(k, n, 0.05)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(tail, 0.05, rel_tol=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1 and quality_rules.upper_bound(0, 0, 0.05) == 1
    assert math.isclose(quality_rules.upper_bound(0, 1000, 0.05), 1 - 0.05 ** (1 / 1000))


def test_cutoffs_keep_their_promise_in_each_stratum(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(6000):
        lang = ["aa", "bb", "few"][0 if i % 2 else 1] if i >= 20 else "few"
        good = rng.random() < 0.7
        symbols = 0 if good and rng.random() > (0.0 if lang == "aa" else 0.2) else 60
        rows.append((i, lang, " ".join(["word"] * 0 + [f"w{rng.randrange(10**6)}" for _ in range(60)] + ["#"] * symbols)))
        labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, known).collect()}
    rejected, total = collections.Counter(), collections.Counter()
    for (i, lang, _), (_, good) in zip(rows, labels):
        if good:
            total[lang] += 1
            rejected[lang] += not got[i]["kept"]
    assert rejected["aa"] == 0 and rejected["bb"] / total["bb"] <= 0.02 and rejected["few"] == 0
    assert any("symbols" in got[i]["rejected_by"] for i, lang, _ in rows if lang == "aa")


# --- classifiers


def test_isotonic_is_monotone_and_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0.5)).astype(float)
    trees = toxicity.Trees(rounds=60).fit(x[:2000], y[:2000])
    iso = toxicity.Isotonic(trees.margin(x[:2000]), y[:2000])
    out = iso(np.sort(trees.margin(x)))
    assert (np.diff(out) >= 0).all() and out.min() >= 0 and out.max() <= 1
    assert ((iso(trees.margin(x[2000:])) >= 0.5) == y[2000:]).mean() > 0.95
    assert ((quality_model.Additive(coarse=24).fit(x[:2000], y[:2000]).probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85  # needs a pair table


def test_models_without_rows_or_with_one_label():
    for y in (np.zeros(0), np.zeros(50), np.ones(50)):
        x = np.zeros((len(y), 3), np.float32)
        for p in (quality_model.Additive().fit(x, y).probability(np.ones((4, 3), np.float32)), 1 / (1 + np.exp(-toxicity.Trees().fit(x, y).margin(np.ones((4, 3), np.float32))))):
            assert len(set(p.tolist())) == 1 and 0 <= p[0] <= 1


def test_features_do_not_depend_on_the_slice():
    texts = ["You are a fool, you!!", "", None, "AAAA bbbb\nAAAA bbbb\n", "é" * 50, "x1y @here c0de", "one two three " * 40]
    data, at = buffers(texts)
    lexicon = toxicity.Lexicon(words.split(*buffers(["fool here"]), words.ALNUM_LOWER).hash, np.array([3.0, 2.0]))
    for run in (quality_model.features, lexicon.features, lambda d, a: language.gram_counts(d, a)):
        whole = run(data, at)
        for i in range(len(texts)):
            assert np.allclose(run(data, at[i : i + 2]), whole[i : i + 1])
    hit = lexicon.features(data, at)
    assert hit[0, toxicity.FEATURES.index("near_second")] > 0 and hit[5, toxicity.FEATURES.index("obfuscated")] > 0


# --- token spans


def test_allocation_rules():
    token = np.array([0, 3, 5, 9, 12]), np.array([3, 5, 9, 12, 14])
    start, end = np.array([0, 4, 4, 8]), np.array([4, 4, 7, 12])
    most, crossing = token_spans.allocate(*token, start, end, "most")
    assert most.tolist() == [0, 0, 2, 3, -1] and crossing.tolist() == [False, True, True, False, False]
    first, _ = token_spans.allocate(*token, start, end, "first")
    assert first.tolist() == [0, 0, 2, 3, -1]
    later, _ = token_spans.allocate(np.array([6]), np.array([12]), start, end, "most")
    assert later.tolist() == [3] and token_spans.allocate(np.array([6]), np.array([12]), start, end, "first")[0].tolist() == [2]


# --- chat


RECORDS = [
    ("messages", {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("system", "s"), ("user", "q"), ("assistant", "")]),
    ("shared", {"conversations": [{"from": "human", "value": "[INST] x"}, {"from": "gpt", "value": "</s>"}]}, [("user", "[INST] x"), ("assistant", "</s>")]),
    ("instruction", {"instruction": "do", "input": "it", "output": "done"}, [("user", "do\n\nit"), ("assistant", "done")]),
    ("instruction", {"output": "done", "input": "", "instruction": "do"}, [("user", "do"), ("assistant", "done")]),
    ("instruction_only", {"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ("prompt", {"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ("completion", {"prompt": "p", "completion": None}, [("user", "p"), ("assistant", "")]),
    ("prompt_system", {"system": "s", "prompt": "p", "response": "r \\[INST] \\\\[/OUT] <s>"}, [("system", "s"), ("user", "p"), ("assistant", "r \\[INST] \\\\[/OUT] <s>")]),
    (None, {"prompt": "p", "unknown": 1}, None),
]


def test_layouts_are_told_apart_by_their_paths_and_read_back(spark):
    rows = [(i, json.dumps(r)) for i, (_, r, _) in enumerate(RECORDS)] + [(99, "{broken"), (100, None)]
    done = chat.format_records(spark.createDataFrame(rows, "id int, record string"))
    got = {r["id"]: r for r in done.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("mask"))).collect()}
    for i, (name, _, turns) in enumerate(RECORDS):
        assert got[i]["layout"] == name
        if turns is None:
            assert got[i]["formatted"] is None
            continue
        assert [(t["role"], t["text"]) for t in got[i]["back"]] == turns
        assert got[i]["loss"] == "".join(t for r, t in turns if r == "assistant")
        assert sum(m["chars"] for m in got[i]["mask"]) == len(got[i]["formatted"])
    assert got[99]["layout"] is None and got[100]["turns"] is None


def test_texts_too_long_for_json_are_formatted_all_the_same(spark, monkeypatch):
    monkeypatch.setattr(chat, "JSON_TEXT", 30)
    rows = spark.createDataFrame([(1, 0, "user", "short"), (1, 1, "assistant", "long " * 20), (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    done = chat.format_records(chat.records_of(rows), given="given").withColumn("back", chat.read_turns(F.col("formatted")))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in done.collect()}
    assert got == {1: [("user", "short"), ("assistant", "long " * 20)], 2: [("user", "q")]}


def test_conversations_too_large_for_a_variant_are_formatted_all_the_same(spark):
    """Texts below the limit of one string, together beyond the 128 MB of a variant."""
    rows = spark.range(9).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("x"), F.lit(16_000_000)).alias("text"))
    rows = rows.union(spark.createDataFrame([(2, 0, "user", "q")], "conv_id int, turn long, role string, text string"))
    done = chat.format_records(chat.records_of(rows), given="given").select("conv_id", F.size("turns").alias("n"), F.length("formatted").alias("chars"))
    assert sorted(tuple(r) for r in done.collect()) == [(1, 9, 7 + 9 * (16_000_000 + 15)), (2, 1, 23)]


def test_turns_count_with_their_field_bytes(spark, monkeypatch):
    monkeypatch.setattr(chat, "JSON_BYTES", 200)
    rows = spark.createDataFrame([(1, i, "user", "") for i in range(7)] + [(2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["record"] is None, r["given"] is None) for r in chat.records_of(rows).collect()}
    assert got == {1: (True, False), 2: (False, True)}


def test_escapes_are_undone_exactly(spark):
    rng = random.Random(8)
    parts = ["[", "]", "\\", "/", "INST]", "[INST]", "</s>", "<s>", "OUT]", "X:41]", " ", "a", "<", "s>", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    done = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in done.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("[INST]", "[/INST]", "[OUT]", "<s>", "</s>", "[X:41]"))
