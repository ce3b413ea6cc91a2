"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_value(module_name: str) -> None:
    """Ship a module's functions to Python workers by value, so executors need
    no copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)


def kept_in_worker(name, make):
    """``make()``, once per Python worker process. Modules shipped by value are
    rebuilt for every task, so what tasks should share is kept apart."""
    store = sys.modules.setdefault("_murmur_worker_state", types.ModuleType("_murmur_worker_state")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column of a batch as Python strings, null read as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def parts(batch: pa.RecordBatch, rows: int):
    """The batch in slices of at most ``rows`` rows (bounds working memory)."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def narrow(df: DataFrame, **cols) -> DataFrame:
    """Only the named columns, under the operator's own names, so columns of
    the input that happen to share a name can never clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in cols.items()])
