"""Helpers that the training-data operators share: durable intermediate tables and input clean-up."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master, whose executors all share this machine's disk, may go without the setting; a temporary
    folder is then used and removed at exit. On a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIRS:
        _OWN_DIRS.append(tempfile.mkdtemp(prefix="tessergraph-"))
    return "file://" + _OWN_DIRS[0]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs
    no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessergraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by :func:`save` that nothing lazy refers to any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        _delete(df.sparkSession, path)
        _TABLES[:] = [t for t in _TABLES if t[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _TABLES:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    for path in _OWN_DIRS:
        shutil.rmtree(path, ignore_errors=True)


#: Keys with more rows than this are not joined by a shuffle, as all their rows would meet in one task.
HOT = 1_000_000


def attach(rows: DataFrame, values: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows.join(values, key, how)`` for ``values`` with one row a key and ``total`` rows, inner or left.

    Keys of more than HOT rows, of which there are at most total / HOT, get their values by broadcast.
    """
    if total <= HOT:
        return rows.join(values, key, how)
    hot = save(rows.groupBy(key).count().filter(F.col("count") > HOT).select(key), "hot")
    if hot.isEmpty():
        return rows.join(values, key, how)
    some = save(values.join(F.broadcast(hot), key, "left_semi"), "hot")
    return rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(some), key, how).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(values, key, how))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator needs, under fixed names, so that no extra column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
