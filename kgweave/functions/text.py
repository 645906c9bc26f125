"""Text functions. All but the NFKC step run natively."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s) if s is not None else None)


def nfkc(x: Column | str) -> Column:
    """NFKC form. The Python step is fed null for ASCII text, which is its own NFKC form."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(_nfkc(F.when(F.octet_length(x) != F.length(x), x)), x)


def collapse(x: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends, lower case."""
    x = F.col(x) if isinstance(x, str) else x
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def normalize_text(x: Column | str, unicode: bool = True) -> Column:
    """NFKC, white space collapsed, lower case. ``unicode=False`` leaves NFKC out and stays native."""
    return collapse(nfkc(x)) if unicode else collapse(x)


def singularize(x: Column | str) -> Column:
    """English singular by suffix: -ies, -sses/-shes/-ches/-xes/-zes, -s but for -ss, -us, -is. An approximation."""
    x = F.col(x) if isinstance(x, str) else x
    return (
        F.when(x.rlike("[^aeiou]ies$") & (F.length(x) > 4), F.regexp_replace(x, "ies$", "y"))
        .when(x.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(x, "es$", ""))
        .when(x.rlike("s$") & ~x.rlike("(ss|us|is)$") & (F.length(x) > 2), F.regexp_replace(x, "s$", ""))
        .otherwise(x)
    )


def clean_answer(x: Column | str, unicode: bool = True) -> Column:
    """A model's answer without thinking, answer and box tags; straight quotes; white space collapsed."""
    x = F.col(x) if isinstance(x, str) else x
    x = F.regexp_replace(x, r"(?is)<think>.*?</think>", " ")
    x = F.regexp_replace(x, r"(?is)<answer>\s*(.*?)\s*</answer>", "$1")
    x = F.regexp_replace(x, r"\\boxed\{([^}]*)\}", "$1")
    x = nfkc(x) if unicode else x
    x = F.translate(x, "\u2019\u2018\u201c\u201d", "''\"\"")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
