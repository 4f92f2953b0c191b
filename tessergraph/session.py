"""Durable intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a local master that has none set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tessergraph-work-"))
    return f"file://{_OWN[0]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read back, which cuts lineage and survives the loss of executors."""
    path = f"{work_folder(df.sparkSession)}/tessergraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = df.sparkSession
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """Write one file, local or, if the path has a scheme, on any file system that Spark knows."""
    full = path if "://" in path else f"file://{Path(path).absolute()}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(data), 1 << 24):
            out.write(bytearray(data[at : at + (1 << 24)]))
    finally:
        out.close()
    return path


def put_lines(spark: SparkSession, path: str, pieces: Iterable[str | DataFrame], skip: int = 0) -> str:
    """One file from texts and from tables of one string column, a line a row, in their order. Tables are written by tasks,
    compressed, and only copied together by the driver, which holds a buffer of them. The first ``skip`` bytes of each
    table are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{Path(path).absolute()}")
    out = target.getFileSystem(conf).create(target, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode("utf-8", "surrogatepass")))
                continue
            folder = f"{work_folder(spark)}/tessergraph/lines-{uuid.uuid4().hex}"
            piece.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)
            place, left = jvm.org.apache.hadoop.fs.Path(folder), skip
            files = place.getFileSystem(conf)
            for f in sorted((x.getPath() for x in files.listStatus(place) if x.getLen()), key=lambda p: p.getName()):
                if not f.getName().startswith("part-"):
                    continue
                lines = jvm.java.util.zip.GZIPInputStream(files.open(f), 1 << 16)
                left -= lines.skip(left) if left else 0
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(lines, out, 1 << 20, False)
                lines.close()
            files.delete(place, True)
    finally:
        out.close()
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Discards what is materialised inside it; for work whose result is plain values."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            _remove(_WRITTEN.pop(path), path)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``df``; nothing lazy may read it any more."""
    path = getattr(df, "_written_to", None)
    if path and _WRITTEN.pop(path, None) is not None:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_WRITTEN.items()):
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    for folder in _OWN:
        shutil.rmtree(folder, ignore_errors=True)
