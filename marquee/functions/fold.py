"""Folding texts to ASCII, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without what isn't ASCII; null stays null."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())
