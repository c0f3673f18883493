"""Files of a folder as rows: listing, gates, digests, contents.

Folders are listed by the data source in ``folder``.  Bytes are read in tasks only, and only
for files that need it: a file whose size and time are those it had when it was last read, long
enough after its last change, keeps the digest it had then.
"""

from __future__ import annotations

import hashlib
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators.blocks import assign_offsets, drop_blank, number_blocks
from passagemill.schemas import LIMITS, MIMES, IngestError, Limits
from passagemill.sources import folder, markup

#: A file that changed this short before it was read may change again without a new time.
RACY_MICROSECONDS = 2_000_000
#: Bytes that a task reads for digests.
DIGEST_BYTES = 64 << 20


def list_files(
    spark: SparkSession, path: str, index_dir: str = "", limits: Limits = LIMITS
) -> DataFrame:
    """Ingestable files under ``path`` (a local path or a URI), or the file itself; ``reason`` names a refused one."""
    fs, inner = folder.opened(path)
    info = fs.get_file_info(inner)
    if info.type == arrow_fs.FileType.NotFound:
        raise IngestError(path, "file not found")
    if info.type == arrow_fs.FileType.Directory:
        spark.dataSource.register(folder.FolderSource)
        listed = spark.read.format(folder.FORMAT).option("path", path).option("skip", index_dir).load()
        return gate_files(listed, limits)
    if os.path.splitext(inner)[1].lower() not in MIMES:
        raise IngestError(path, "unsupported file type")
    parent = os.path.dirname(os.path.abspath(inner) if isinstance(fs, arrow_fs.LocalFileSystem) else inner)
    found = folder.Tree(fs, parent, uri=path.replace(inner, parent)).entry(inner, info)
    rows = [tuple(vars(found).values())] if found else []
    return gate_files(spark.createDataFrame(rows, folder.SCHEMA), limits)


def gate_files(listed: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Add media type and sort order; set the ``reason`` of files that are refused unread."""
    mime = F.create_map(*[F.lit(x) for pair in MIMES.items() for x in pair])
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("size") > limits.max_file_bytes, "larger than a file may be")
    )
    if importlib.util.find_spec("pdfplumber") is None:
        reason = reason.when(F.col("suffix") == ".pdf", "pdfplumber is not installed")
    # Paths sort folder by folder, as their parts do.
    return listed.withColumn("mime", mime[F.col("suffix")]).withColumn("reason", reason).withColumn(
        "path_order", F.translate("path", "/", "\x01")
    )


def _open(real: str):
    fs, path = folder.opened(real)
    return open(path, "rb") if isinstance(fs, arrow_fs.LocalFileSystem) else fs.open_input_stream(path)


def remembered(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """Add ``file_sha256`` of files that are as they were when last read: ``known`` has (doc_id, file_sha256, size, mtime, seen)."""
    if known is None:
        return files.withColumn("file_sha256", F.lit(None).cast("string"))
    last = known.groupBy("doc_id").agg(F.max_by(F.struct("file_sha256", "size", "mtime", "seen"), "seen").alias("was"))
    same = (
        (F.col("was.size") == F.col("size")) & (F.col("was.mtime") == F.col("mtime"))
        & (F.col("was.mtime") < F.col("was.seen") - RACY_MICROSECONDS) & F.col("reason").isNull()
    )
    return files.join(last, "doc_id", "left").withColumn("file_sha256", F.when(same, F.col("was.file_sha256"))).drop("was")


def with_digest(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add ``file_sha256`` and whether the file was ``opened`` for it; contents stay in the task."""
    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = []
            for real in frame["real"]:
                try:
                    with _open(real) as handle:
                        seal = hashlib.sha256()
                        while block := handle.read(1 << 20):
                            seal.update(block)
                    sums.append(seal.hexdigest())
                except OSError:
                    sums.append(None)
            yield frame.assign(file_sha256=sums)

    files = remembered(files, known)
    needed = F.col("file_sha256").isNull() & F.col("reason").isNull()
    size = files.where(needed).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).collect()[0]
    kept = files.where(~needed).withColumn("opened", F.lit(False))
    if not size.n:
        return kept
    # Partitions by bytes; small files are shared out among the cores as well.
    cores = files.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-size.bytes // DIGEST_BYTES), min(cores, size.n))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    read = files.where(needed).repartition(parts, "path").mapInPandas(digest, schema)
    unread = F.when(F.col("file_sha256").isNull(), "unreadable file").otherwise(F.col("reason"))
    return kept.unionByName(read.withColumn("reason", unread).withColumn("opened", F.lit(True)))


def read_contents(files: DataFrame, as_text: bool) -> DataFrame:
    """Rows (doc_id, filename, text or content), one file at a time."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for real, doc_id, name in zip(frame["real"], frame["doc_id"], frame["filename"]):
                with _open(real) as handle:
                    data = handle.read()
                if as_text:
                    data = data.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
                column = "text" if as_text else "content"
                yield pd.DataFrame({"doc_id": [doc_id], "filename": [name], column: [data]})

    kind = "text string" if as_text else "content binary"
    return files.select("real", "doc_id", "filename").mapInPandas(read, f"doc_id string, filename string, {kind}")


_TEXT_PARSERS = {
    "text/plain": markup.txt_blocks,
    "text/markdown": markup.md_blocks,
    "text/html": markup.html_blocks,
    "text/csv": markup.csv_blocks,
}


def parse_texts(texts: DataFrame, mime: str) -> DataFrame:
    """Blocks of texts (doc_id, filename, text) of one media type."""
    return _TEXT_PARSERS[mime](texts)


def parse_files(files: DataFrame, mimes: list[str]) -> DataFrame:
    """Blocks with offsets of files of the given media types; each file is read once."""
    parts = []
    for mime in mimes:
        mine = files.where(F.col("mime") == mime)
        if mime in _TEXT_PARSERS:
            parts.append(parse_texts(read_contents(mine, True), mime))
        elif mime == MIMES[".pdf"]:
            parts.append(markup.page_blocks(markup.pdf_pages(read_contents(mine, False))))
        else:
            parts.append(markup.docx_blocks(read_contents(mine, False)))
    out = parts[0].select(*markup.BLOCK_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*markup.BLOCK_COLUMNS))
    return assign_offsets(number_blocks(drop_blank(out)))


def is_unreadable(kind: Column) -> Column:
    return kind == markup.UNREADABLE


def golden_rows(spark: SparkSession, path: str) -> DataFrame:
    """Golden set from JSON lines, numbered ``qid`` in file order; blank lines are skipped.

    A golden set is written by hand; its lines are numbered by one sort.
    """
    from pyspark.sql import Window

    from passagemill.schemas import GOLDEN

    lines = spark.read.text(path).where(~X.is_blank(F.col("value")))
    at = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    rows = lines.select(F.from_json("value", GOLDEN).alias("row"), at.alias("_at"))
    w = Window.orderBy("_at")
    return rows.select((F.row_number().over(w) - 1).cast("bigint").alias("qid"), "row.*")
