"""Whole-file inputs: fingerprints and the document signature check."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadwake.functions.isolated import isolated

#: Bytes of a file held at a time.
CHUNK = 1 << 20
TASKS = 10_000


def open_stream(path: str, compression: str | None = None) -> BinaryIO:
    """A file of any store that Arrow knows (local, HDFS, S3, GCS), named as Spark names it."""
    scheme, rest = (path.split(":", 1) if ":/" in path else ("file", path))
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=compression)
    host = urlsplit(path).netloc
    store, root = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}")
    return store.open_input_stream(f"{root.rstrip('/')}/{rest.removeprefix('//' + host).lstrip('/')}", compression=compression)


def open_unpacked(path: str) -> BinaryIO:
    """``open_stream`` of what a packed file (.gz and others that Arrow knows by name) holds; other files as they are."""
    return open_stream(path, "detect")


def _listed(spark: SparkSession, paths: list[str], glob: str | None) -> list[str]:
    """Names of all files once, from Spark's own file index; its scans leave out empty files, so rows are no listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = set()
    for path in paths:
        try:
            found.update(reader.load(path).inputFiles())
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return sorted(unquote(uri) for uri in found)


def fingerprints(spark: SparkSession, paths: str | list[str], glob: str | None = None, chunk: int = CHUNK,
                 opener: Callable[[str], BinaryIO] = open_stream) -> DataFrame:
    """path, sha256, bytes and error of every input file, as a manifest lists them.

    Files may have any size: a task streams one through the digest, ``chunk`` bytes at a time, and no row holds a file.
    Only names pass through the driver, whose file index holds them anyway; up to ``TASKS`` tasks share them.  Paths that don't exist are left out; a file that can't be read gets null digests and its error.
    ``opener`` opens files of stores that Arrow doesn't know; with ``open_unpacked`` digests and bytes are those of the contents.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def digest(path: str) -> dict:
        h, size = hashlib.sha256(), 0
        with opener(path) as stream:
            while piece := stream.read(chunk):
                h.update(piece)
                size += len(piece)
        return {"sha256": h.hexdigest(), "bytes": size}

    names = _listed(spark, paths, glob)
    listed = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), TASKS)))
    done = listed.select("path", isolated(digest, "struct<sha256: string, bytes: bigint>")(F.col("path")).alias("r"))
    return done.select("path", "r.value.sha256", "r.value.bytes", "r.error")


def pdf_signature(content: Column) -> Column:
    """Signature anywhere in the first KiB: what the extractor accepts."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.instr(head, "%PDF-") > 0


def pdf_at_start(content: Column) -> Column:
    """Signature first, after blanks: what the downloader accepts."""
    return F.decode(F.substring(content, 1, 1024), "ISO-8859-1").rlike(r"\A[\s\x00]*%PDF-")
