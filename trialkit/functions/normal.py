"""Normal distribution. Spark has no erf; the CDF runs on summary rows as an Arrow batch."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore").astype("float64")


def normal_quantile(p: float) -> float:
    """The quantile is needed for a fixed alpha only, so it is a plan constant."""
    return NormalDist().inv_cdf(p)


def logit(p: Column, clip: float = 1e-9) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return F.log(q / (1 - q))
