"""Merkle manifest, packing and prefix trie against plain versions, on awkward, empty and given tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import tables
from trialkit.llm import merkle, numbering, packing, prefix_trie, words
from trialkit.llm.queries import QUERIES, branched, word_vocabulary

GIVEN = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return tables.awkward(spark, str(tmp_path_factory.mktemp("awkward")))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables.empty(spark, str(tmp_path_factory.mktemp("empty")))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def read(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_least_squares_packing", "op13_prefix_trie"])
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


# --- manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(digests, fanout=16):
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, p in enumerate(at):
            first = p // fanout * fanout
            paths[i].append(("".join(digests[first:p]), "".join(digests[p + 1 : first + fanout])))
        at = [p // fanout for p in at]
        digests = [h("".join(digests[i : i + fanout])) for i in range(0, len(digests), fanout)]
    return digests[0], paths


def plain_manifest(rows):
    def leaf(r):
        return h("".join("-" if r[k] is None else f"{len(str(r[k]).encode())}:{r[k]}" for k in ("doc_id", "source", "lang", "n_chars", "text")))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = plain_tree([x[2] for x in groups[s]])
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, above):
        for (_, _, own, r), path in zip(groups[s], trees[s][1]):
            steps, folded = path + top, own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                folded = leaf({**r, "text": r["text"] and r["text"].translate(LOWER)})
            for left, right in steps:
                folded = h(left + folded + right)
            out.append((r["doc_id"], own, trees[s][0], root, h("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def test_manifest_equals_a_plain_one(spark, awkward):
    for folder in (GIVEN, awkward):
        got = ordered(QUERIES["op11_merkle_manifest"](spark, folder).collect())
        assert got == sorted(plain_manifest(read(spark, folder, "documents")), key=repr)
        assert {r[-1] for r in got} == {True, False}


def test_manifest_of_other_fanout_and_of_single_rows(spark):
    rows = [(i, "one" if i < 30 else f"s{i}", f"t{i}") for i in range(34)]
    docs = spark.createDataFrame(rows, "k long, g string, t string")
    made = merkle.build(docs, ["k", "t"], "g", "k", fanout=3)
    trees = {g: plain_tree([h("".join(f"{len(str(v))}:{v}" for v in (k, t))) for k, own, t in rows if own == g], 3) for g in {r[1] for r in rows}}
    assert dict(map(tuple, made.subroots.collect())) == {g: t[0] for g, t in trees.items()}
    assert made.root == plain_tree([trees[g][0] for g in sorted(trees)], 3)[0]
    proofs = merkle.proofs(made).collect()
    assert len(proofs) == 34
    for r in proofs:
        own = r["leaf"]
        for step in r["path"]:
            own = h(step["left"] + own + step["right"])
        assert own == made.root


def test_numbers_have_no_gaps_for_hot_groups_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ROWS_PER_TASK", 50)
    rows = [("hot", 7)] * 300 + [("hot", i) for i in range(200)] + [(f"g{i % 40}", None if i % 3 else i) for i in range(400)]
    random.Random(1).shuffle(rows)
    got = numbering.numbered(spark.createDataFrame(rows, "g string, v long"), "g", ["v"], len(rows), "n").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r["n"], r["v"]) for r in got if r["g"] == g)
        assert [n for n, _ in own] == list(range(len(own)))
        values = [v for _, v in own]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))


# --- packing


def check_packing(spark, folder):
    tokenizer = Tokenizer.from_file(word_vocabulary())
    want = sorted((repr(r["doc_id"]), tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in read(spark, folder, "documents"))
    packed = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), word_vocabulary()).collect()
    pieces, got = {}, []
    for r in sorted(packed, key=lambda r: (repr(r["doc_id"]), r["start"])):
        pieces.setdefault((repr(r["doc_id"]), r["start"]), []).append(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(r["ids"]) == 4 * r["length"]
    total = sum(len(ids) for _, ids in want)
    assert sum(r["length"] for r in packed) == total
    known = {}
    for doc, ids in want:
        known.setdefault(doc, []).append(ids)
    for (doc, start), parts in pieces.items():  # rows with one id may stand on several texts
        allowed = [ids[start : start + len(p)] for p in parts for ids in known[doc]]
        assert all(p in allowed for p in parts)
        got.append(doc)
    assert set(got) == set(known)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(sum(n for _, n in own) < packing.WINDOW for own in sequences.values()) <= 11
    digest = QUERIES["op12_least_squares_packing"](spark, folder).collect()
    assert ordered((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in digest) == ordered(
        (r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"]) for r in packed
    )


def test_packing_of_given_and_awkward_tables(spark, awkward):
    check_packing(spark, GIVEN)
    check_packing(spark, awkward)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_token_once(seed):
    rng = np.random.default_rng(seed)
    window = 64
    histogram = np.zeros(window + 1, np.int64)
    histogram[1:] = rng.integers(0, [1, 2, 50, 1000][seed % 4] + 1, window) * (rng.random(window) < (0.2, 1)[seed % 2])
    made = packing.plan(histogram, window)
    seen = {n: [np.zeros(n, int) for _ in range(histogram[n])] for n in range(1, window + 1)}
    filled = {}
    for origin, first, last, start, take, per, skip, sequence, offset in made.rows:
        for j, number in enumerate(range(first, last)):
            seen[origin][number][start : start + take] += 1
            slot = skip + j
            filled.setdefault(sequence + slot // per, []).append((offset + slot % per * take, take))
    assert all((part == 1).all() for own in seen.values() for part in own)
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    assert len(filled) == made.sequences
    if histogram.sum() > 5000:
        assert made.fitted > 0.5 * made.sequences


def test_runs_are_encoded_as_the_library_does():
    rng = random.Random(3)
    alphabet = [*"abcXYZ ÉéßäÖñ'st.,!?;:-#$%09\n\t\x0b\x1c", " ", " ", "İ", "ſ", "K", "日", "́", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "the"]
    library, runs = Tokenizer.from_file(word_vocabulary()), packing._Runs(word_vocabulary())
    assert runs.plain and runs.lowers
    for _ in range(300):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(5)]
        ids, counts = runs.encode(*words.buffers(pa.array(texts)))
        ends = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# --- trie


def plain_trie(rows):
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            own.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends, children = {}, {}, {}
    for c, turns in own.items():
        k = zlib.crc32(str(c).encode()) % 4
        full = tuple(own.get(c - c % 20, [])[:k] + turns[k:])
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append(c)
        ends.setdefault(full, []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        below = [sums[c] for c in children.get(node, [])]
        sums[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    return [
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), *sums[n], h(",".join(map(str, sorted(ends.get(n, []))))))
        for n, m in members.items()
    ]


def test_trie_equals_a_plain_one(spark, awkward):
    for folder in (GIVEN, awkward):
        assert ordered(QUERIES["op13_prefix_trie"](spark, folder).collect()) == sorted(plain_trie(read(spark, folder, "conversations")), key=repr)


def test_trie_of_chains_hubs_and_copies_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    monkeypatch.setattr(prefix_trie, "HUB_CHILDREN", 5)
    monkeypatch.setattr(prefix_trie, "BUCKET_NODES", 10)
    rows = [(2000, i, "user", f"long {i}") for i in range(90)]
    rows += [(c, i, "user", "same words here" if i < 2 else f"c{c % 7} t{i}") for c in range(60) for i in range(4)]
    rows += [(c, 0, "user", f"first of {c}") for c in range(100, 160)]
    rows += [(c, i, "assistant", f"copy {i}") for c in range(300, 340) for i in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = prefix_trie.trie(*branched(prefix_trie.turns_of(frame)), task_nodes=6).collect()
    got = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found]
    assert ordered(got) == sorted(plain_trie([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]), key=repr)


@pytest.mark.parametrize("seed", range(8))
def test_sums_of_random_forests(seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 7, 60, 300, 300, 300, 2000][seed]
    parent = np.array([-1 if i == 0 or rng.random() < 0.05 else (i - 1 if seed == 5 else int(rng.integers(max(0, i - [1, 50][seed % 2] * 4), i))) for i in range(n)])
    depth, order = np.zeros(n, np.int64), rng.permutation(n)
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else rng.integers(0, 3)
    values, added = rng.integers(0, 9, (n, 2)), rng.integers(0, 9, (n, 2))
    weight, sums = rng.integers(1, 5, n), values.copy()
    for i in reversed(range(n)):
        if parent[i] >= 0:
            weight[parent[i]] += weight[i]
            sums[parent[i]] += sums[i]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    moved = np.where(parent[order] >= 0, place[parent[order]], -1)
    assert (prefix_trie.decompose(moved, depth[order], weight[order], values[order], added[order]) == (sums + added)[order]).all()


# --- pipeline


def test_an_id_on_several_texts_loses_only_the_copies(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a"), 1), (2, text("a"), 2), (2, text("b"), 3), (3, text("c"), 4), (3, text("d"), 5), (3, text("d"), 6), (None, text("c"), 7), (None, text("e"), 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["row"] for r in kept.collect()) == [1, 3, 4, 5, 8]
