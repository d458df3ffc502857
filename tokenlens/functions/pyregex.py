"""Regex search with a per-row pattern, evaluated in Arrow batches by Python's ``re``.

Spark's ``rlike``/``regexp`` compile a non-literal pattern again for every row; with one
pattern per query and millions of candidate rows that compile dominates. Here each distinct
pattern is compiled once per Python worker, and the dialect is Python's ``re`` -- the one the
original tool used for ``\\b{query}\\b`` and user patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_compiled: dict[str, re.Pattern] = {}   # of this worker, for its later batches and tasks
_MOST_COMPILED = 100_000


def _search(text: pd.Series, pattern: pd.Series) -> pd.Series:
    out = []
    for t, p in zip(text, pattern):
        if t is None or p is None:
            out.append(None)
            continue
        rx = _compiled.get(p)
        if rx is None:
            if len(_compiled) >= _MOST_COMPILED:
                _compiled.clear()
            rx = _compiled[p] = re.compile(p)
        out.append(rx.search(t) is not None)
    return pd.Series(out, dtype="object")


py_regex_search = F.pandas_udf(_search, T.BooleanType())


def py_boundary_pattern(query: Column, literal: bool = False) -> Column:
    """``\\b{query}\\b`` in Python's dialect (query unescaped unless ``literal``)."""
    if literal:  # a backslash before every ASCII character that may mean something in a pattern
        query = F.regexp_replace(query, r"([\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])", r"\\$1")
    return F.concat(F.lit("\\b"), query, F.lit("\\b"))
