"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.session import shared_folder

#: The six ASCII white-space characters, as bytes.split() and bytes.strip() take them.
BLANKS = " \t\n\x0b\f\r"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, for the Python that runs in tasks."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="newsmill-py-")) / "newsmill.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what the operators read, so no other column can clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A folder of its own below the shared one, for data that must outlive executors."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends there: a lost executor costs no recomputation of what lies
    above, and what is read twice is computed once.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z only; Spark's lower() maps all of Unicode."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sizes_to_offsets(sizes: list[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(sizes, dtype=np.int64))))


def long_lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow array of list<int64>."""
    n, width = rows.shape
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 over the links (u, v)."""
    parent = np.arange(n)
    while True:
        pu, pv = parent[u], parent[v]
        if np.array_equal(pu, pv):
            return parent
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
