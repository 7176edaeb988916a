"""Office files as segment tables and back: binaryFile in, one task per group of files, bytes out."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources.ooxml import UnsupportedFormat

FORMATS = ("docx", "xlsx", "pptx", "pdf")
#: No PDF library is available offline: the format is known, reading it raises.
READABLE = ("docx", "xlsx", "pptx")
_SEGMENTS = "doc_id string, format string, seg_ord int, segment_id string, text string, block string, join_before string"


def format_of(path: Column) -> Column:
    """docx, xlsx, pptx or pdf by suffix in any case; NULL for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin(*FORMATS), suffix)


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(doc_id: the path, format, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("doc_id"), format_of(F.col("path")).alias("format"), "content")


def unsupported(files: DataFrame) -> DataFrame:
    """Files that no reader takes."""
    return files.where(F.col("format").isNull() | ~F.col("format").isin(*READABLE)).select("doc_id", "format")


def read_segments(files: DataFrame) -> DataFrame:
    """One row per segment of (doc_id, format, content); an unreadable format raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cloakframe.sources import ooxml

        for batch in batches:
            rows = []
            for doc, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind not in READABLE:
                    raise UnsupportedFormat(f"no reader for {kind or 'this kind of'} files")
                rows += [(doc, kind, i, sid, text, block, "") for i, (sid, text, block) in enumerate(ooxml.read_segments(content, kind))]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "format", "seg_ord", "segment_id", "text", "block", "join_before"])

    return files.select("doc_id", "format", "content").mapInArrow(run, _SEGMENTS)


def write_segments(files: DataFrame, edited: DataFrame) -> DataFrame:
    """(doc_id, format, content, text): files with edited segments (doc_id, segment_id, text, originals) written back, and all text of the output."""
    own = edited.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("segment_id", "text"))).alias("_edits"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("originals", F.array().cast("array<string>"))))).alias("_originals"))
    both = files.select("doc_id", "format", "content").join(own, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cloakframe.sources import ooxml

        for batch in batches:
            docs, kinds, contents, edits, originals = (batch.column(i).to_pylist() for i in range(5))
            made = [ooxml.write_segments(c, k, dict(e or {}), o or []) for c, k, e, o in zip(contents, kinds, edits, originals, strict=True)]
            texts = [ooxml.extract_text(c, k) for c, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(kinds), pa.array(made, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "format", "content", "text"])

    return both.select("doc_id", "format", "content", "_edits", "_originals").mapInArrow(run, "doc_id string, format string, content binary, text string")


def save_files(written: DataFrame, folder: str, root: str | None = None) -> DataFrame:
    """Write the bytes below a folder on shared storage, each file by a rename; (doc_id, path).

    A file's place below the folder is its path below root (by default below the deepest folder that holds
    all of them), so files of one name from several folders don't meet.
    """
    if root is None:
        ends = written.agg(F.min("doc_id"), F.max("doc_id")).first()
        shared = os.path.commonprefix([x for x in ends if x is not None] or [""])
        root = shared[: shared.rfind("/") + 1]
    lead = root.rstrip("/") + "/" if root else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))
        for batch in batches:
            paths = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = doc.removeprefix(lead).split("://")[-1].lstrip("/")
                path = f"{base}/{own}"
                files.create_dir(os.path.dirname(path), recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(content)
                files.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["doc_id", "path"])

    return written.select("doc_id", "content").mapInArrow(run, "doc_id string, path string")
