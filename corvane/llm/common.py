"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: A word, as a Java and a Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by whatever store Spark reads it from."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where lambdas inside body use it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does it for texts of one byte a character."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def without(text: Column, characters: str) -> Column:
    """The text without these characters."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def join_summed(rows: DataFrame, summed: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with summed, an aggregate by the same keys (longs), so that Spark can split a key with very many rows.

    Joined by the keys themselves, the aggregate would stay as it lies and all rows of a key would go to its
    task. By another form of the keys both sides are shuffled, the smaller one once more, and adaptive
    execution deals the rows of a hot key to several tasks.
    """
    other = {f"_k{i}": F.bitwise_not(k) for i, k in enumerate(keys)}
    return rows.withColumns(other).join(summed.withColumns(other).drop(*keys), list(other)).drop(*other)


def named_apart(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column bears it (column names differ by more than case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_held: list[Any] = [None, None]


def held(key: Any, make: Callable[[], Any]) -> Any:
    """make(), which the Python worker keeps for this key until another is asked for.

    Spark uses its workers again from stage to stage; so one operator's dictionaries never lie beside another's.
    """
    if _held[0] != key:
        _held[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[:] = [key, make()]
    return _held[1]
