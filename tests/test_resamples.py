import numpy as np
from pyspark.sql import functions as F

from trialkit.plans import bootstrap


def test_copies_in_tasks_equal_those_of_columns(spark):
    """All resamples of a row are drawn together, also for text ids, null ids and none at all."""
    rows = spark.createDataFrame([(0, "a"), (7, None), (None, "é|b"), (None, None), (-12, "x" * 90)], "id long, name string")
    boots = F.transform(F.sequence(F.lit(0), F.lit(1099)), lambda b: bootstrap.copies_of(b, ["id", "name"], 3))
    text = F.concat(*[F.coalesce(F.concat(F.lit("|"), F.col(c).cast("string")), F.lit("")) for c in ("id", "name")])
    keyed = rows.withColumns({"_n": F.coalesce("id", F.lit(0)), "_want": boots, "_ident": text})
    for r in bootstrap._with_copies(keyed.select("_want", "_ident"), 1100, 3).collect():
        assert np.frombuffer(r["_copies"], np.uint8).tolist() == r["_want"]
