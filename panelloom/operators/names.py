"""Column-name repair. Only metadata is touched, on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def remove_from_names(df: DataFrame, literal: str = "/") -> DataFrame:
    """Remove the first occurrence of ``literal`` from every column name."""
    return df.toDF(*[c.replace(literal, "", 1) for c in df.columns])


def drop_containing(df: DataFrame, text: str) -> DataFrame:
    """Drop the columns whose name contains ``text``, ignoring case."""
    return df.drop(*[c for c in df.columns if text.lower() in c.lower()])


def clean_name(name: str) -> str:
    """ASCII snake_case form of one name; a leading digit gets an ``x`` in front."""
    spelled = name.replace("%", "_percent_").replace("#", "_number_").replace("'", "")
    ascii_name = unicodedata.normalize("NFKD", spelled).encode("ascii", "ignore").decode("ascii")
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", ascii_name)
    snake = re.sub(r"[^0-9a-zA-Z]+", "_", words).strip("_").lower()
    if not snake or snake[0].isdigit():
        snake = "x" + snake
    return snake


def clean_names(df: DataFrame) -> DataFrame:
    """``clean_name`` on all columns; repeated results are numbered from 2."""
    seen: dict[str, int] = {}
    out = []
    for name in map(clean_name, df.columns):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*out)


def set_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename all columns by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)
