"""What several operators use: tables, Arrow functions shipped by value, state of a Python worker."""

from __future__ import annotations

import os
import sys
import types

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = "/opt/tokenizers"  # default folder of the vocabulary files; every operator takes a path
MAX_VOCABULARY_BYTES = 64 << 20  # a vocabulary file is broadcast only below this size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Functions of ``module`` reach the executors by value, so a cluster needs no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches are bounded by bytes, so that long texts meet in no batch; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast value; larger files than ``MAX_VOCABULARY_BYTES`` are refused."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


STATES = 3  # what a Python worker keeps of earlier tasks: one state of a kind, so many kinds


def worker_state(key, make):
    """``make()`` once per Python worker and key: functions shipped by value have no lasting globals.

    A key reads ``state:kind:...``. Workers outlive jobs, so a new state of a kind replaces the old one, and the kind
    that was asked for longest ago goes when there are more than ``STATES``.
    """
    store = sys.modules.setdefault("_webtraj_worker_state", types.ModuleType("_webtraj_worker_state")).__dict__
    kept = store.setdefault("states", {})
    kind = key.split(":")[1]
    known, state = kept.pop(kind, (None, None))
    if known != key:
        state = None  # the old one goes before the new one is made
        while len(kept) >= STATES:
            del kept[next(iter(kept))]
        state = make()
    kept[kind] = (key, state)
    return state


ship(__name__)
