"""Flat token files without an index: writing them, counting tokens per document.

A file is token ids as little-endian unsigned 16-bit numbers, each document
followed by the end-of-document id. Nothing says where a document begins. The
scan cuts files into blocks by size, finds the end ids of a block with one array
comparison, and needs only each block's last end to know how long the document
is that the next block ends: a running maximum over the blocks of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.llm.tokens import text_encoder

END_ID = 49407
WIDTH = 2
BLOCK_TOKENS = 1 << 21


def _file_system(uri: str):
    """A file system that Spark's folder is in, and the path there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, file, place`` of every document; a flat file per task appears in ``folder``.

    ``folder`` is one that all executors share. A file is written under the name
    of the attempt and renamed when whole, so a repeated task replaces it by the
    same file. Strings of special tokens in texts are ordinary text here: no id
    in a text is the end id. A null text is an empty document. The frame
    is lazy: store it once, then the files are there.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = text_encoder(tokenizer, plain_specials=True)
        end = np.array([end_id], "<u2").tobytes()
        task = TaskContext.get()
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}.tokens"
        attempt, place = f"{path}/.{name}-{task.taskAttemptId()}", 0
        with system.open_output_stream(attempt) as out:
            for batch in batches:
                for text in batch.column("text"):
                    ids = np.frombuffer(encode(text.as_py() or ""), "<u4")
                    if len(ids) and int(ids.max()) > 0xFFFF:
                        raise ValueError("ids of this tokenizer need more than 16 bits")
                    out.write(ids.astype("<u2").tobytes() + end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n))],
                    names=["doc_id", "file", "place"],
                )
                place += n
        system.move(attempt, f"{path}/{name}")

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {kind}, file string, place long")


def token_blocks(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, block, first, tokens``: the blocks of all token files of a folder.

    Only names and sizes of files pass through the driver.
    """
    from pyarrow import fs

    system, path = _file_system(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    files = [(f.base_name, f.size // WIDTH) for f in found if f.base_name.endswith(".tokens") and not f.base_name.startswith(".")]
    rows = spark.createDataFrame(files, "file string, size long").filter("size > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_tokens).cast("long"))
    cut = rows.select("file", "size", F.posexplode(starts).alias("block", "first"))
    blocks = cut.select("file", "block", "first", F.least(F.col("size") - F.col("first"), F.lit(block_tokens)).alias("tokens"))
    return blocks.repartition(spark.sparkContext.defaultParallelism * 4, "file", "block")


def scan_blocks(blocks: DataFrame, folder: str, end_id: int = END_ID) -> DataFrame:
    """``file, block, ends, last_end``: where documents end in each block.

    ``ends`` are token positions in the file, ``last_end`` the last of them, or
    null in a block without one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/{row['file']}") as held:
                    held.seek(row["first"] * WIDTH)
                    tokens = np.frombuffer(held.read(row["tokens"] * WIDTH), "<u2")
                ends = np.flatnonzero(tokens == end_id) + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]], pa.string()),
                        pa.array([row["block"]], pa.int32()),
                        pa.array([ends], pa.list_(pa.int64())),
                        pa.array([int(ends[-1]) if len(ends) else None], pa.int64()),
                    ],
                    names=["file", "block", "ends", "last_end"],
                )

    return blocks.mapInArrow(scan, "file string, block int, ends array<long>, last_end long")


def document_lengths(scanned: DataFrame) -> DataFrame:
    """``file, place, start, n_tokens`` of every document of the files.

    The ends before a block, and the last of them, are a prefix sum and a prefix
    maximum over the blocks of its file. Tokens after a file's last end belong to
    no document.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only counts and last ends pass the window; the ends stay where they were found.
    small = scanned.select("file", "block", F.size("ends").cast("long").alias("n"), "last_end")
    carried = small.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ends_before"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("end_before"),
    )
    joined = scanned.filter(F.size("ends") > 0).select("file", "block", "ends").join(carried, ["file", "block"])
    previous = F.concat(F.array("end_before"), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))))
    rows = joined.select("file", "ends_before", F.posexplode(F.arrays_zip(F.col("ends").alias("e"), previous.alias("p"))).alias("k", "z"))
    return rows.select(
        "file",
        (F.col("ends_before") + F.col("k")).alias("place"),
        (F.col("z.p") + 1).alias("start"),
        (F.col("z.e") - F.col("z.p") - 1).alias("n_tokens"),
    )
