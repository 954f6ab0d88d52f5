"""Fitted models kept in the shared folder, so that sibling queries over one table fit once."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

from tastegrid.session import shared_dir


@lru_cache(maxsize=1)
def _code() -> str:
    """A hash of this subpackage's code: what other code fitted isn't read."""
    h = hashlib.sha256()
    for p in sorted(Path(__file__).parent.glob("*.py")):
        h.update(p.read_bytes())
    return h.hexdigest()


def stored(spark: SparkSession, table: str, kind: str, parameters: tuple, sample: Iterable, fit: Callable[[], object]) -> object:
    """The model of a table: read if one was fitted to the very same sample with the same parameters, else fitted and written.

    The key is a hash of the table's place, the kind, the parameters, the code and the whole sample; models are a few MB each. The
    place is part of it so that another table is always fitted anew."""
    h = hashlib.sha256(repr((table, kind, parameters, _code())).encode())
    for x in sample:
        h.update(b"\x00" if x is None else str(x).encode("utf-8", "surrogatepass") + b"\x01")
    path = f"{shared_dir(spark)}/tastegrid-models/{kind}-{h.hexdigest()[:32]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return pickle.loads(spark.read.schema("model binary").parquet(path).first()["model"])
    model = fit()
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model
