"""Text measures and small string helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _entropy(texts: pd.Series) -> pd.Series:
    def bits(text: str | None) -> float | None:
        if not text:
            return None if text is None else 0.0
        share = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1] / len(text)
        return 0.0 - float((share * np.log2(share)).sum())

    return pd.Series([bits(t) for t in texts], dtype="object")


def shannon_entropy(column: Column, long_texts: bool = False) -> Column:
    """Bits per character over the whole text; 0 for an empty text.

    The plain expression reads a text once per distinct character, which suits names; ``long_texts`` counts all characters
    of a text at once, in batches.
    """
    if long_texts:
        return F.pandas_udf(_entropy, "double")(column)
    size = F.length(column)
    letters = F.filter(F.array_distinct(F.split(column, "")), lambda ch: ch != "")

    def term(acc: Column, ch: Column) -> Column:
        share = (size - F.length(F.replace(column, ch, F.lit("")))) / size
        return acc - share * F.log2(share)

    return F.when(column.isNull(), None).otherwise(F.aggregate(letters, F.lit(0.0), term))


def first_label(column: Column) -> Column:
    return F.split(column, r"\.")[0]


def base_name(column: Column) -> Column:
    """Last path component with either slash; null for a missing or slash-terminated path."""
    return F.nullif(F.element_at(F.split(F.translate(column, "\\", "/"), "/"), -1), F.lit(""))


def url_host(column: Column) -> Column:
    """Text between the first ``//`` and the next ``/``; null when there is no ``//``."""
    return F.nullif(F.regexp_extract(column, r"^(?s).*?//([^/]*)", 1), F.lit(""))


def array_text(column: Column, sep: str = ",") -> Column:
    return F.array_join(column, sep)
