"""A training corpus from the raw documents: five stages, each on all that the one before it kept.

Toxic documents go, then those whose language is not recognised, then all but one of each group of near duplicates, then those that
hold benchmark passages; what is left is encoded. Every stage returns the columns of its input; the last returns one row of token
digests per document. Stages pass their results on as Parquet.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialkit.llm import decontamination, jaccard, language, queries, toxicity  # noqa: E402
from trialkit.llm.frames import free_name  # noqa: E402
from trialkit.session import broadcast_if_small, cut, scratch_path  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of this table, scores below one half; all, if there was nothing to learn from."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    out = free_name(docs, "toxicity")
    return toxicity.score(docs, model, out).filter(F.col(out)["score"] < 0.5).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language learned from this table; all that have a letter, if no language was learned."""
    model = language.fit(docs, "doc_id", "text", "lang")
    if not model.langs:
        return docs.filter(language.has_letter(F.col("text")))
    out = free_name(docs, "language")
    return language.predict(docs, model, out).filter(~F.col(out)["rejected"]).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: that with the smallest doc_id (one without an id comes last), of several the text with the least digest.

    Documents go by id and text together, so an id that stands on several texts loses only the copies among them. Rows with equal id and text
    count as copies; the least of their other columns stay. Documents with an empty set of shingles belong to no group and stay. What is to be dropped
    is sent to all tasks while it is small, else the texts meet it by a shuffle.
    """
    row, group = free_name(docs, "row"), free_name(docs, "group")
    docs = docs.withColumn(row, F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))
    grouped = cut(jaccard.near_duplicates(docs, keep=[row], group=group).filter("n_shingles > 0").select("doc_id", row, group))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    best = cut(grouped.groupBy(group).agg(F.min_by(row, order).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(group, "best"))
    shared = grouped.join(broadcast_if_small(best, best.count(), 160), group)
    dropped = cut(shared.filter(F.col(row) != F.col("best")).select(row).distinct())
    again = cut(shared.filter(F.col(row) == F.col("best")).groupBy(row).count().filter("count > 1").select(row))
    columns = [c for c in docs.columns if c != row]
    kept = docs.join(broadcast_if_small(dropped, dropped.count(), 128), row, "left_anti")
    repeated = again.count()
    if not repeated:
        return kept.select(*columns)
    near = broadcast_if_small(again, repeated, 128)
    single = kept.join(near, row, "left_semi").groupBy(row).agg(F.min(F.struct(*columns)).alias("one")).select("one.*")
    return kept.join(near, row, "left_anti").select(*columns).unionByName(single.select(*columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    out = free_name(docs, "found")
    marked = decontamination.mark(docs, queries.table(spark, sf_dir, "benchmark"), out)
    return marked.filter(~decontamination.contaminated(F.col(out))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the text they decode to."""
    return queries.bpe_digest(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic), ("language", keep_known_languages), ("near_duplicates", one_of_each_group), ("decontamination", drop_contaminated), ("encoding", encode),
]
#: SQL has no trees, centroids or merges; the tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        path = scratch_path(spark, f"{k}-{name}")
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
