"""Every query on awkward and on empty tables, and against SQL or a plain version on the smallest given ones."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import tables
from tools.check import compare, connect
from trialkit.llm import toxicity
from trialkit.llm.queries import QUERIES, SQL, vocabulary

GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return tables.awkward(spark, str(tmp_path_factory.mktemp("awkward")))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables.empty(spark, str(tmp_path_factory.mktemp("empty")))


def docs_of(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, folder, name):
    return [r.asDict(recursive=True) for r in QUERIES[name](spark, folder).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(rows_of, *names):
    return sorted((tuple(r[n] for n in names) for r in rows_of), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    got = rows(spark, empty, name)
    assert len(got) == (1 if name.startswith("op9") else 0)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op8", "op9"))])
def test_one_row_for_each_document(spark, awkward, name):
    want = collections.Counter(d for d, _ in tables.awkward_documents_ids())
    assert collections.Counter(r["doc_id"] for r in rows(spark, awkward, name)) == want


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, awkward, name):
    for folder in (GIVEN, awkward):
        con = connect(folder) if folder == GIVEN else tables.connect(folder)
        verdict, _, _, detail = compare(spark, con, folder, name, QUERIES[name], SQL[name])
        assert verdict == "ok", detail


# --- decontamination


def plain_marks(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    patterns = collections.defaultdict(set)
    for item, text in items:
        w = low(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns[tuple(w[i : i + window])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = low(text), set(), set()
        for size in {len(p) for p in patterns}:
            for i in range(len(w) - size + 1):
                if own := patterns.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= own
        out.append((doc, len(w), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination_against_plain_search(spark, awkward):
    for folder in (GIVEN, awkward):
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["item_id"] is not None]
        got = order(rows(spark, folder, "op1_decontamination"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == plain_marks(docs_of(spark, folder), items)


# --- sharding


def plain_shard(doc, n):
    key = "null" if doc is None else f"={doc}"
    return max(range(n), key=lambda s: (xxhash.xxh64(f"{s}:{key}".encode(), seed=42).intdigest() >> 11, -s))


def test_shards_against_plain_hashing(spark, awkward):
    for folder in (GIVEN, awkward):
        got = rows(spark, folder, "op3_rendezvous_shards")
        texts = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs_of(spark, folder))
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
        for r in got:
            assert r["law"] == "key" and r["shard"] == plain_shard(r["doc_id"], 16) and r["grown_shard"] == plain_shard(r["doc_id"], 17)
            assert r["grown_shard"] in (r["shard"], 16)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- quality rules


def test_rule_counts_against_plain_ones(spark, awkward):
    for folder in (GIVEN, awkward):
        want = []
        for doc, text in docs_of(spark, folder):
            text = text or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            seen, again = set(), 0
            for line in text.split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", line):
                    again += line in seen
                    seen.add(line)
            threes = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            repeated = {i + k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in range(3)}
            failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
            want.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated), failed))
        got = rows(spark, folder, "op4_risk_controlled_rules")
        assert order(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
        assert not any(r["kept"] and r["base_failed"] for r in got)


# --- near duplicates


def plain_groups(docs, num=75, den=100):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(docs[i][0])
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)), key=repr)


def test_near_duplicates_against_all_pairs(spark, awkward):
    for folder in (GIVEN, awkward):
        got = order(rows(spark, folder, "op6_parity_sketch_join"), "doc_id", "n_shingles", "component_id")
        assert got == plain_groups(docs_of(spark, folder))


# --- encoding


def test_ids_against_the_tokenizers_library(spark, awkward):
    plain = Tokenizer.from_file(vocabulary())
    for folder in (GIVEN, awkward):
        want = []
        for doc, text in docs_of(spark, folder):
            ids = plain.encode(text or "", add_special_tokens=False).ids
            want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))))
        assert order(rows(spark, folder, "op10_prefix_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_token_counts_against_offsets_of_the_tokenizers_library(spark, awkward):
    plain = Tokenizer.from_file(vocabulary())
    for folder in (GIVEN, awkward):
        table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "text").collect()
        got = collections.defaultdict(list)
        for r in rows(spark, folder, "op8_token_spans"):
            got[r["doc_id"]].append(r)
        for r in table:
            if r["doc_id"] is None or len(r["text"] or "") > 100_000:
                continue
            parts, whole = [], " ".join([r["source"] or "", r["lang"] or "", r["text"] or ""])
            at = 0
            for name, value, pieces in (("source", r["source"], None), ("lang", r["lang"], None), ("text", r["text"], 1)):
                for k, piece in enumerate((value or "").split("\n") if pieces else [value or ""]):
                    parts.append([name, k, at, at + len(piece.encode()), 0, 0])
                    at += len(piece.encode()) + 1
            n_outside, ids = 0, plain.encode(whole, add_special_tokens=False).ids
            stop = 0
            for i in ids:
                raw = byte_length(plain, i)
                start, stop = stop, stop + raw
                share = [max(0, min(stop, p[3]) - max(start, p[2])) for p in parts]
                best = max(share)
                if not best:
                    n_outside += 1
                    continue
                own = parts[share.index(best)]
                own[4] += 1
                own[5] += best < raw
            copies = sum(x["doc_id"] == r["doc_id"] for x in table)
            want = sorted([(p[0], p[1], p[3] - p[2], p[4], p[5], len(ids), n_outside) for p in parts] * copies)
            assert sorted((g["field"], g["part"], g["n_bytes"], g["n_tokens"], g["n_crossing"], g["doc_tokens"], g["n_outside"]) for g in got[r["doc_id"]]) == want


def byte_length(plain, i):
    token = plain.id_to_token(i)
    return len(token)  # one letter stands for each byte


# --- classifiers


def test_language_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in rows(spark, "/root/testdata/sf0.01", "op5_centroid_language") if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in got) >= 0.98 * len(got)


@pytest.mark.parametrize(("name", "label", "least"), [("op2_boosted_toxicity", "toxic", 0.95), ("op7_additive_quality", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in rows(spark, folder, name) if r["held_out"] and r["doc_id"] in known]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == known[r["doc_id"]] for r in got) >= least * len(got)


def test_empty_text_scores_and_unknown_language(spark, awkward):
    lang = {r["doc_id"]: r for r in rows(spark, awkward, "op5_centroid_language")}
    for doc in (1, 2, 3, 13):
        assert lang[doc]["lang_pred"] == "und" and lang[doc]["score"] == 0 and lang[doc]["rejected"]
    assert lang[4]["lang_pred"] == "en"
    for name in ("op2_boosted_toxicity", "op7_additive_quality"):
        got = collections.defaultdict(set)
        for r in rows(spark, awkward, name):
            got[r["doc_id"]].add(r["score"])
        assert all(0 <= s <= 1 for v in got.values() for s in v) and got[1] == got[2] and len(got[4]) == 1


# --- pipeline


def test_pipeline_stage_by_stage(spark, awkward, tmp_path):
    for folder in (GIVEN, awkward):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs_of_frame(docs)
            result = stage(spark, docs, folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert result.columns == docs.columns
            path = str(tmp_path / f"{'given' if folder == GIVEN else 'awkward'}-{name}")
            result.write.parquet(path)
            docs = spark.read.parquet(path)
            if name == "near_duplicates":
                groups, left = plain_groups(before), docs_of_frame(docs)
                want = {c for d, n, c in groups if n and d is not None}
                counts = collections.Counter(d for d, _ in left)
                assert all(counts[c] == 1 for c in want) and not (set(counts) & ({d for d, n, _ in groups if n and d is not None} - want))
            if name == "decontamination":
                items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["item_id"] is not None]
                bad = {m[0] for m in plain_marks(before, items) if m[5]}
                assert sorted((d for d, _ in docs_of_frame(docs)), key=repr) == sorted((d for d, _ in before if d not in bad), key=repr)
        plain = Tokenizer.from_file(vocabulary())
        assert order([r.asDict() for r in docs.collect()], "doc_id", "n_tokens") == sorted(((d, len(plain.encode(t or "").ids)) for d, t in before), key=repr)


@pytest.mark.parametrize("labels", [[], [(4, 1, None, "t", 1)], [(d, 1, 1, "t", 1) for d in range(1, 18)]])
def test_filters_without_anything_to_learn_from_keep_documents(spark, tmp_path, labels):
    documents = [(d, t, None, *rest) for d, t, _, *rest in tables.awkward_documents()]
    folder = tables.write(spark, str(tmp_path), documents, [], labels, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert order([r.asDict() for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()], "doc_id", "text") == sorted(((d[0], d[1]) for d in documents), key=repr)
    if not labels:
        want = [(d[0], d[1]) for d in documents if any(c.isalpha() for c in d[1] or "")]
        assert sorted(docs_of_frame(corpus_pipeline.keep_known_languages(spark, docs, folder)), key=repr) == sorted(want, key=repr)


def test_calibration_on_labels_of_one_kind_leaves_margins_as_they_are():
    rng = np.random.default_rng(2)
    x = rng.random((400, 2)).astype(np.float32)
    trees = toxicity.Trees().fit(x, (x[:, 0] > 0.5).astype(float))
    for label in (0.0, 1.0):
        score = toxicity.calibrated(trees, x[:5], np.full(5, label))(trees.margin(x))
        assert ((score > 0.5) == (x[:, 0] > 0.5)).mean() > 0.95


def docs_of_frame(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_random_texts_encode_like_the_library():
    from trialkit.llm import bpe

    plain, own = Tokenizer.from_file(vocabulary()), bpe.Encoder(bpe.load(vocabulary()))
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice(["ab", "aA 1\n'st", " \n\t", "éèñ日本ab ", "!?.#%$ a", "０①²३x ", "  ​ a"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 60, 300]))) + rng.choice(["", "<|endoftext|>", "<|endoftext|> b"])
        ids = own.encode(text).tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == plain.decode(ids, skip_special_tokens=False) == text
    assert all(own.piece(raw) == (i,) for i, raw in enumerate(own.tokens) if raw and i != own.added["<|endoftext|>"])
