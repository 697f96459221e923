"""Stored vectors and activation shards (fit once, reuse across runs).

A published table is complete or absent: its rows go to a folder of their own
and a manifest that names the folder is written last.  The manifest is kept
under a key of what the rows were made from, so another corpus or setting never
reads them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "key string, folder string, rows long"
SHARD_MANIFEST = "part int, folder string, rows long"


def corpus_digest(df: DataFrame, *columns: str) -> str:
    """A digest of the rows' ``columns``, whatever their order and partitions (sums of two 64-bit hashes, and the count)."""
    # a null is no empty string, and neighbours do not run together
    row = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns or df.columns])
    sums = [F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")) for salt in (1, 2)]
    r = df.agg(F.count(F.lit(1)), *sums).first()
    return sha256(json.dumps([list(columns or df.columns), *map(str, r)]).encode()).hexdigest()


def settings_digest(**settings) -> str:
    """A digest of named settings; sets and word lists are given sorted."""
    return sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def _rows_of(spark: SparkSession, path: str, schema: str) -> list:
    """The rows of a small JSON folder; none where it is missing or unfinished."""
    try:
        return [r for r in spark.read.schema(schema).json(path).collect() if None not in r]
    except Exception as e:  # noqa: BLE001 - missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return []
        raise


def publish(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write ``df`` under ``path`` and then its manifest for ``key``; returns the stored rows.

    A run that stops on the way leaves no manifest, and the next one writes anew.
    """
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/data/{uuid4().hex}"
    df.write.parquet(folder)
    stored = spark.read.schema(df.schema).parquet(folder)
    manifest = spark.createDataFrame([(key, folder, stored.count())], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/manifest/{key}")
    return stored


def published(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The rows published under ``key``, or ``None``."""
    found = _rows_of(spark, f"{path.rstrip('/')}/manifest/{key}", MANIFEST)
    return spark.read.parquet(found[0]["folder"]) if found and found[0]["key"] == key else None


def vector_path(base: str, method: str, corpus_id: str, k: int | None = None) -> str:
    """Location of a fitted table, keyed by method, k and corpus (a changed corpus
    never silently reuses vectors fitted on another one)."""
    kk = "none" if k is None else str(k)
    return f"{base.rstrip('/')}/method={method}/k={kk}/corpus={corpus_id}"


def save_vectors(df: DataFrame, path: str) -> None:
    """Write a long ``(id, term, weight)`` table (never densified)."""
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """Read stored vectors, or ``None`` when nothing, or nothing whole, was stored at ``path``."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - missing path
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "does not exist", "UNABLE_TO_INFER_SCHEMA")):
            return None
        raise


def save_shards(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Write activations as shards of at most ``rows_per_file`` rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", int(rows_per_file)).parquet(path)


def write_shards_resumable(rows: DataFrame, path: str, id_col: str, make: Callable[[DataFrame], DataFrame] = lambda d: d,
                           parts: int = 16, rows_per_file: int = 100_000) -> int:
    """Write ``make(rows)`` in ``parts`` dealt by a hash of ``id_col``, each published once; returns the parts written now.

    A part's manifest is written after its rows: a run that was stopped goes on with
    the parts that have none, and rows of a part that was not finished are never
    read.  ``rows`` and ``parts`` must be those of the first run (checked).
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    key = settings_digest(parts=parts, corpus=corpus_digest(rows))
    begun = [r["key"] for r in _rows_of(spark, f"{path}/source", "key string")]
    if begun and begun != [key]:
        raise ValueError(f"{path} holds shards of other rows or another number of parts")
    if not begun:
        spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").json(f"{path}/source")
    done = {r["part"] for r in _rows_of(spark, f"{path}/manifest/*", SHARD_MANIFEST)}
    for part in sorted(set(range(parts)) - done):
        folder = f"{path}/data/{part}-{uuid4().hex}"
        own = make(rows.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part))
        own.write.option("maxRecordsPerFile", int(rows_per_file)).parquet(folder)
        n = spark.read.schema(own.schema).parquet(folder).count()
        (spark.createDataFrame([(part, folder, n)], SHARD_MANIFEST).coalesce(1)
         .write.mode("overwrite").json(f"{path}/manifest/{part}"))
    return parts - len(done)


def load_published_shards(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all finished parts, or ``None`` when none is finished."""
    folders = sorted(r["folder"] for r in _rows_of(spark, f"{path.rstrip('/')}/manifest/*", SHARD_MANIFEST) if r["rows"])
    return spark.read.parquet(*folders) if folders else None


def load_shards(spark: SparkSession, path: str) -> DataFrame:
    """Read all shards back; row order is restored by the id columns, not file names."""
    return spark.read.parquet(path)
