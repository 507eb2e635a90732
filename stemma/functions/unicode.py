"""Unicode normal forms, which the engine has no function for. Arrow batches; ASCII texts pass untouched."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(c: Column, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD of a text."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return F.when(c.rlike(r"[^\x00-\x7f]"), convert(c)).otherwise(c)
