"""Registry-driven projections that keep protected columns out of an output."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.model import ALL_DATASETS

HASH, MASK, DROP = "hash", "mask", "drop"


def phi_columns(dataset: str) -> frozenset[str]:
    return ALL_DATASETS[dataset].phi if dataset in ALL_DATASETS else frozenset()


def linkable_columns(dataset: str) -> frozenset[str]:
    return ALL_DATASETS[dataset].linkable if dataset in ALL_DATASETS else frozenset()


def is_phi(dataset: str, column: str) -> bool:
    return column in phi_columns(dataset)


def registry(namespace: "Namespace") -> dict[str, frozenset[str]]:  # noqa: F821
    """Protected columns by landed table name."""
    return {namespace.bronze(name): d.phi for name, d in ALL_DATASETS.items()}


def hashed(column: Column) -> Column:
    return F.sha2(column.cast("string"), 256)


def masked(column: Column) -> Column:
    """First character, then stars: ``P055`` becomes ``P***``."""
    text = column.cast("string")
    return F.when(text.isNotNull(), F.concat(F.substring(text, 1, 1), F.lit("***")))


def protect(df: DataFrame, columns: Iterable[str], how: str = HASH) -> DataFrame:
    """Hash, mask or drop ``columns``; everything else passes through untouched."""
    hidden = set(columns) & set(df.columns)
    if how == DROP:
        return df.drop(*hidden)
    convert = {HASH: hashed, MASK: masked}[how]
    return df.select(*(convert(F.col(c)).alias(c) if c in hidden else F.col(c) for c in df.columns))
