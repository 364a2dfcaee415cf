"""String functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _bare(s: str | None) -> str | None:
    return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def composed(blocks: tuple = ((0xC0, 0x250), (0x1E00, 0x1F00))) -> tuple[str, str]:
    """The composed Latin letters that lose their marks to one letter, and those letters."""
    pairs = [(chr(c), _bare(chr(c))) for low, high in blocks for c in range(low, high)]
    pairs = [(c, b) for c, b in pairs if len(b) == 1 and b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


@F.pandas_udf(StringType())
def _stripped(s: pd.Series) -> pd.Series:
    return s.map(_bare, na_action="ignore")


def strip_accents(text: Column | str) -> Column:
    """Text without combining marks, after compatibility decomposition.

    Spark has no normalization function, but texts of ASCII and composed Latin letters only need letters exchanged. The others
    alone go to Python.
    """
    column = F.col(text) if isinstance(text, str) else text
    marked, plain = composed()
    simple = F.translate(column, marked, plain)
    hard = simple.rlike(r"[^\x00-\x7F]")
    return F.when(hard, _stripped(F.when(hard, column))).otherwise(simple)
