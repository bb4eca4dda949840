"""Quality rules whose cutoffs come with a guarantee: at most a stated share of good documents is rejected in any stratum.

Each rule is a ratio of a document and a fixed ladder of cutoffs from mild to strict. A combination has one step of every ladder, or
none, and rejects what any of its rules rejects. The rules decide on documents that pass the base rules; shares are shares of those. Per stratum
the labelled holdout is dealt by key into two folds. The first orders combinations into one path: from none on, each step goes one rung up the
ladder that costs the fewest good documents and, among equals, catches the most bad ones. The second fold tests the combinations of that path in order: one holds if the exact (Clopper-Pearson) upper bound of the share of good
documents it rejects is at most the allowed share, and testing stops at the first that fails. So the whole share and the whole level of a stratum go
to the combination in question, and nothing is set aside for rules that are not used.

The level is divided among the strata that are tested. A stratum with fewer good documents than any test needs goes to a pool with its like,
which is tested as one stratum; its promise holds for the documents of the pool together. With confidence 1 - delta all promises hold at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm import words
from trialkit.llm.frames import map_texts
from trialkit.session import broadcast_if_small, cut

METRICS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])
#: fixed values: the symbol characters of the base rules
SYMBOLS = b"#*$%&|<>"

#: name -> (numerator, denominator, sign, ladder from mild to strict); sign 1 rejects above the cutoff, -1 below it
RULES: Mapping[str, tuple[str, str, int, Sequence[float]]] = {
    "symbols": ("n_symbols", "n_words", 1, [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "dup_lines": ("n_dup_lines", "n_lines", 1, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeat_words": ("n_repeat_words", "n_words", 1, [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "long_words": ("word_chars", "n_words", 1, [30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0]),
    "short_words": ("word_chars", "n_words", -1, [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0]),
}


def _metrics():
    """Function from a slice of documents to their metrics."""
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True

    def run(data: np.ndarray, at: np.ndarray) -> dict:
        found, body = words.split(data, at, words.BLANKS), data[at[0] : at[-1]]
        starts_char = (body & 0xC0) != 0x80
        in_word = (words.BLANKS != 0)[body]
        lines = words.split(data, at, words.LINES)
        spoken = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
        first = np.searchsorted(np.flatnonzero(spoken), lines.first)
        line_key = words.mix(lines.hash[spoken] + _salt(lines.doc[spoken]))
        _, kept = np.unique(line_key, return_index=True)
        again = np.ones(len(line_key), bool)
        again[kept] = False

        h, begin = words.windows(found, 3)
        key = words.mix(h + _salt(found.doc[begin]))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        repeated = np.zeros(len(found.hash), bool)
        if len(twice):
            place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = begin[twice[place] == key]
            for k in range(3):
                repeated[hit + k] = True
        return {
            "n_words": found.counts, "word_chars": words.per_document(starts_char & in_word, at), "n_symbols": words.per_document(is_symbol[body], at),
            "n_dup_lines": words.per_document(again, first), "n_repeat_words": words.per_document(repeated, found.first), "n_lines": np.diff(first),
        }

    return run


def _salt(doc: np.ndarray) -> np.ndarray:
    return words.mix(doc.astype(np.uint64) + np.uint64(0x51ED270B7F4A7C15))


def with_metrics(docs: DataFrame, out: str = "metrics", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the struct of counts of every whole text; a null text has none of anything."""
    return map_texts(docs, METRICS, _metrics, out, text, keep_text)


def upper_bound(rejected: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a binomial share: the share at which `rejected` or fewer of n have probability `level`."""
    if n == 0 or rejected >= n:
        return 1.0
    k = np.arange(rejected + 1)
    choose = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k])
    lo, hi = rejected / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        terms = choose + k * math.log(p) + (n - k) * math.log1p(-p) if p < 1 else np.full(len(k), -np.inf)
        top = terms.max()
        if top + math.log(np.exp(terms - top).sum()) > math.log(level):
            lo = p
        else:
            hi = p
    return hi


def _rejects(rule: str, m: str, cutoff):
    over, under, sign, _ = RULES[rule]
    left, right = F.col(m)[over].cast("double"), cutoff * F.col(m)[under]
    return (F.col(m)["n_words"] > 0) & ((left > right) if sign > 0 else (left < right))


#: the part of the labelled holdout that orders the combinations; the rest tests them
PATH_SHARE = 0.2
CUTOFFS = T.StructType([T.StructField("__group", T.StringType()), T.StructField("cutoffs", T.MapType(T.StringType(), T.DoubleType()))])


def least_good(level: float, allowed: float) -> int:
    """Good documents needed for a bound of at most `allowed` if none of them is rejected."""
    return math.ceil(math.log(level) / math.log1p(-allowed))


def tested_strata(sizes: Mapping[int, int], delta: float, allowed: float) -> int:
    """Number of strata to divide the level among, from strata counted by their number of good documents: the least number k such that at
    level delta / k no more than k strata, the pool of the small ones included, have enough. 0 if none has at any level."""
    for k in range(1, sum(sizes.values()) + 2):
        need = least_good(delta / k, allowed)
        pool = sum(n * times for n, times in sizes.items() if n < need)
        enough = sum(times for n, times in sizes.items() if n >= need) + (pool >= need)
        if enough <= k:
            return k if enough else 0
    return 0


def path_of(rungs: np.ndarray, good: np.ndarray, times: np.ndarray) -> list[tuple[int, ...]]:
    """Combinations from mild to strict: rungs taken of every ladder. A row of `rungs` has the first rung of each ladder that rejects its documents."""
    state = [0] * len(RULES)
    path, heights = [], [len(r[3]) for r in RULES.values()]
    while any(s < h for s, h in zip(state, heights, strict=True)):
        options = []
        for i, h in enumerate(heights):
            if state[i] < h:
                out = (rungs < np.array(state[:i] + [state[i] + 1] + state[i + 1 :])).any(1)
                options.append((int(times[out & good].sum()), -int(times[out & ~good].sum()), i))
        state[min(options)[2]] += 1
        path.append(tuple(state))
    return path


def certified(path: Sequence[tuple[int, ...]], rungs: np.ndarray, times: np.ndarray, level: float, allowed: float) -> tuple[int, ...]:
    """The last combination of the path before the first that fails, by the good documents of the testing fold."""
    held = (0,) * len(RULES)
    for state in path:
        out = int(times[(rungs < np.array(state)).any(1)].sum())
        if upper_bound(out, int(times.sum()), level) > allowed:
            break
        held = state
    return held


def choose_cutoffs(measured: DataFrame, labels: DataFrame, key: str, good: str, stratum: str, metrics: str = "metrics", allowed: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row (__stratum, cutoffs) per stratum with labels: the cutoff of each rule of the combination that holds; rules without one are left out.

    `labels` has `key` and the 0/1 column `good`; several labels of a key count as good if one of them is. Null labels and keys count
    for nothing; a null stratum is the stratum ''. `allowed` is the share of good documents that all rules together may reject.
    Documents are counted by the rungs that first reject them, so a task gets at most as many rows of a stratum as there are combinations of rungs.
    """
    known = labels.filter(F.col(good).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max(good) == 1).alias("__good"))
    rows = measured.select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__stratum"), F.col(metrics).alias("__m")).join(known, key)
    rows = rows.groupBy(key).agg(F.max("__good").alias("__good"), F.min(F.struct("__stratum", "__m")).alias("__row")).select(key, "__good", "__row.*")  # a repeated row is one document
    rung = {r: F.lit(len(spec[3])) - sum((_rejects(r, "__m", F.lit(float(c))).cast("int") for c in spec[3]), F.lit(0)) for r, spec in RULES.items()}
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("path")), 11) / F.lit(float(1 << 53))
    rungs = [F.coalesce(e, F.lit(len(RULES[r][3]))).alias(r) for r, e in rung.items()]
    table = cut(rows.select("__stratum", "__good", (draw < PATH_SHARE).alias("__path"), *rungs).groupBy("__stratum", "__good", "__path", *RULES).agg(F.count(F.lit(1)).alias("__n")))
    most = least_good(delta * 1e-9, allowed)  # more good documents make no difference to the sharing of the level
    strata = cut(table.groupBy("__stratum").agg(F.coalesce(F.sum(F.when(F.col("__good") & ~F.col("__path"), F.col("__n"))), F.lit(0)).alias("__size")))
    sizes = {r["s"]: r["n"] for r in strata.groupBy(F.least("__size", F.lit(most)).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `most` rows
    level = delta / max(1, tested_strata(sizes, delta, allowed))
    grouped = strata.select("__stratum", F.when(F.col("__size") >= least_good(level, allowed), F.col("__stratum")).alias("__group"))
    few = broadcast_if_small(grouped, sum(sizes.values()), 256)
    counted = table.join(few, "__stratum").groupBy("__group", "__good", "__path", *RULES).agg(F.sum("__n").alias("__n"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        at, is_good, times, first = pdf[list(RULES)].to_numpy(), pdf["__good"].to_numpy(bool), pdf["__n"].to_numpy(), pdf["__path"].to_numpy(bool)
        test = is_good & ~first
        held = certified(path_of(at[first], is_good[first], times[first]), at[test], times[test], level, allowed)
        found = {rule: float(spec[3][s - 1]) for s, (rule, spec) in zip(held, RULES.items(), strict=True) if s}
        return pd.DataFrame({"__group": [pdf["__group"].iloc[0]], "cutoffs": [found]})

    chosen = counted.groupBy("__group").applyInPandas(choose, CUTOFFS)
    return grouped.join(chosen, grouped["__group"].eqNullSafe(chosen["__group"])).select("__stratum", "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", stratum: str = "lang", text: str = "text", allowed: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Key, metrics, base_failed, the names of the rules that reject, and kept, for every document.

    base_failed: fewer than 50 words, or more than half of the words in 3-word windows that come again. Null and empty texts have
    no words and so fail. Rules of chosen cutoffs reject on ratios; a document without words fires none. Strata without a label have no
    rules. Repeated rows get equal verdicts. Texts are read whole, once, however long; only counts and keys move. An empty table gives an empty one;
    without labels only base_failed decides. Other columns of `docs` and `labels` are not looked at.
    """
    measured = cut(with_metrics(docs.select(key, F.col(stratum).alias("__s"), text), "metrics", text, keep_text=False))
    m = F.col("metrics")
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    chosen = cut(choose_cutoffs(measured.filter(~base), labels, key, good, "__s", allowed=allowed, delta=delta))  # the rules decide on these only
    joined = measured.withColumn("__stratum", F.coalesce(F.col("__s").cast("string"), F.lit(""))).join(broadcast_if_small(chosen, chosen.count(), 512), "__stratum", "left")
    fired = F.filter(F.array(*[F.when(_rejects(r, "metrics", F.col("cutoffs")[r]), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return joined.select(key, "metrics", base.alias("base_failed"), fired.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
