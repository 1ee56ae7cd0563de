"""Unicode compatibility form, for which Spark SQL has no function: a vectorised function, applied to texts that need it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(s: Column) -> Column:
    """NFKC of a text; ASCII texts pass as they are."""
    return F.when(s.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(s.rlike(r"[^\x00-\x7F]"), s))).otherwise(s)
