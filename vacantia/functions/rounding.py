"""Ratios as the reports show them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(numerator: Column, denominator: Column) -> Column:
    """The unrounded quotient, 0 where the denominator isn't positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(0.0)


@F.pandas_udf(DoubleType())
def rounded4(values: pd.Series) -> pd.Series:
    """Four decimals by the rule of binary floating point (ties to even of the exact value)."""
    return values.map(lambda v: None if v is None or v != v else round(v, 4))
