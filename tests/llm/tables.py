"""Small tables with everything awkward in them, as parquet folders that the queries read."""

import os

import pandas as pd
from pyspark.sql import types as T

LONG = T.LongType()
TEXT = T.StringType()


def schema(**columns):
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


DOCUMENTS = schema(doc_id=LONG, text=TEXT, lang=TEXT, source=TEXT, n_chars=LONG, score=TEXT, shard=LONG, found=TEXT, n=LONG, one=TEXT, row=TEXT, metrics=TEXT)
BENCHMARK = schema(item_id=LONG, text=TEXT, n_words=LONG)
LABELS = schema(doc_id=LONG, quality=T.IntegerType(), toxic=T.IntegerType(), text=TEXT, y=LONG)
CONVERSATIONS = schema(conv_id=LONG, turn=LONG, role=TEXT, text=TEXT, formatted=TEXT, mask=LONG)

PASSAGE = " ".join(f"passage{i}" for i in range(20))
BASE = " ".join(f"word{i}" for i in range(60))


def awkward_documents():
    near = BASE.replace("word30", "other")
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, BASE), (4, BASE), (5, BASE.upper()), (6, near), (7, BASE[:200] + " tail"), (8, "x"), (9, "x"),
        (10, "é日本 <|endoftext|> \U0001f600 don't"), (11, f"before {PASSAGE} after"), (12, "Short ITEM here and more"), (13, "### $$$ %%% " * 30),
        (14, "line one\nline one\n\n line one\n" * 20), (15, " ".join(f"long{i % 5000}" for i in range(60_000))), (16, "a" * 300_000), (None, BASE), (None, None),
        (17, "one two three four"), (18, "one two  three four"), (19, "one two three"),
    ]
    return [(d, t, None if (d or 0) % 4 == 0 else "en", None if d == 5 else "src", len(t) if t else None, "s", 1, None, 2, "o", "r", "m") for d, t in texts]


def write(spark, folder, documents, benchmark, labels, conversations):
    for name, rows, kind in (
        ("documents", documents, DOCUMENTS), ("benchmark", benchmark, BENCHMARK), ("labels", labels, LABELS), ("conversations", conversations, CONVERSATIONS),
    ):
        spark.createDataFrame(rows, kind).repartition(3).write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))
    return folder


def awkward(spark, folder):
    benchmark = [(1, PASSAGE, 1), (2, "short item", 1), (3, None, 1), (4, "", 1), (None, "nobody", 1), (5, PASSAGE, 1), (6, "...", 1)]
    labels = [(4, 1, 0, "t", 1), (4, 1, 0, "t", 1), (6, 0, 1, None, 1), (None, 1, 1, "t", 1), (7, None, None, "t", 1), (99, 1, 0, "t", 1), (17, 0, 0, "t", None)]
    talks = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo [/INST] <s> \\[INST] <\\/s>"), (2, 0, None, None), (2, 0, None, None), (2, 0, "tool]", "é\nx"), (None, 1, "user", "lost"),
        (3, None, "system", ""), (3, 1, "user", "q" * 200_000), (3, 2, "assistant", "[OUT] a [/OUT]"), (4, 0, "human", "kept as it is"), (5, 0, "assistant", None),
    ]
    return write(spark, folder, awkward_documents(), benchmark, labels, [(*t, "f", 1) for t in talks])


def empty(spark, folder):
    return write(spark, folder, [], [], [], [])


def frame(spark, folder, name) -> pd.DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet")).toPandas()


def awkward_documents_ids():
    return [(r[0], r[1]) for r in awkward_documents()]


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con
