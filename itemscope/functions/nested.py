"""Dict-like text cells: JSON, single-quoted JSON, or Python literals."""

import ast
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_MAP = "map<string,string>"
_OPTIONS = {"allowSingleQuotes": "true"}


def _literal_to_json(text):
    try:
        value = ast.literal_eval(text.strip())
        return json.dumps(value) if isinstance(value, dict) else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def python_literal_to_json(cells: pd.Series) -> pd.Series:
    return cells.map(_literal_to_json, na_action="ignore")


def with_parsed_dict(df, source, target):
    """Add `target`, a string map of the dict written in `source`, or an empty map.

    The JVM parser reads JSON and single-quoted cells; only the text it rejects is sent to Python.
    Nested values stay JSON text and are read by `nested_dict`.
    """
    cell = F.nullif(F.trim(F.col(source)), F.lit(""))
    parsed, rest = f"__{target}_json", f"__{target}_rest"
    return (
        df.withColumn(parsed, F.from_json(cell, _MAP, _OPTIONS))
        .withColumn(rest, python_literal_to_json(F.when(F.col(parsed).isNull(), cell)))
        .withColumn(target, F.coalesce(
            F.col(parsed), F.from_json(F.col(rest), _MAP),
            F.create_map().cast(_MAP)))
        .drop(parsed, rest))


def nested_dict(map_col: Column, key):
    """The inner dict under `key`; absent or no dict gives an empty map."""
    return F.coalesce(F.from_json(map_col[key], _MAP, _OPTIONS), F.create_map().cast(_MAP))


def text_or_blank(map_col: Column, key):
    """A missing key is '', a key whose value is null stays NULL."""
    return F.when(F.map_contains_key(map_col, key), map_col[key]).otherwise(F.lit(""))
