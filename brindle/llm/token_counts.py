"""Token counts of documents in flat token files that have no index: a separator scan over blocks, stitched by a prefix scan."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import bpe
from brindle.session import cut, shared_folder, written

#: Tokens a block of a file holds.
BLOCK_TOKENS = 1 << 20


def id_type(end: int) -> np.dtype:
    """The narrowest type of a file's ids, of which `end` is the largest: two bytes or four."""
    if not 0 <= end < 1 << 32:
        raise ValueError(f"no 32-bit id: {end}")
    return np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as pyarrow knows it, and the path in it; a path that only Hadoop's file systems know is refused."""
    return fs.FileSystem.from_uri(f"s3://{uri[6:]}" if uri.startswith("s3a://") else uri)


def write_token_files(docs: DataFrame, encode: Callable[[str], np.ndarray], end: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each task's documents as one flat file of ids of id_type(end), `end` after each document; (file, place, doc_id) of every document.

    end: an id above all others; encode must give smaller ones, and an id that is not ends the job. The files go to `folder` (the
    shared folder, by default); where pyarrow can't write there, the call fails before any job starts. A task writes under a name
    of its own attempt, and only files of attempts that Spark took are in the result, so a task that is run again does no harm.
    A null text has no tokens. Rows that repeat an id, and rows without one, are documents of their own; other columns are ignored.
    """
    folder = folder or written(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}")
    kind = id_type(end)
    opened(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.bin"
        place = 0
        stop = np.array([end], kind).tobytes()
        with store.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for k in range(0, b.num_rows, 500):
                    part = b.slice(k, 500)
                    for t in part.column(1).to_pylist():
                        ids = encode(t or "")
                        if len(ids) and not 0 <= ids.min() <= ids.max() < end:
                            raise ValueError(f"a token id at or above the end of document, {end}")
                        out.write(ids.astype(kind).tobytes() + stop)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n), pa.array(range(place, place + n), pa.int64()), part.column(0)], ["file", "place", "doc_id"])
                    place += n

    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "file string, place long, doc_id long"), "manifest")


def scan_blocks(files: DataFrame, end: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """For every block of every file (column file): block, tokens (without separators), ends, head (tokens before the first separator), tail (after the last), inner (counts between)."""
    kind = id_type(end)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            got = []
            for x in names:
                store, path = opened(x)
                got.append(store.get_file_info(path).size // kind.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(got, pa.int64())], ["file", "size"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, path = opened(x)
                with store.open_input_file(path) as f:
                    f.seek(k * block_tokens * kind.itemsize)
                    ids = np.frombuffer(f.read(block_tokens * kind.itemsize), kind)
                at = np.flatnonzero(ids == end)
                head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (0, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]), pa.array([k], pa.int64()), pa.array([len(ids) - len(at)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    ["file", "block", "tokens", "ends", "head", "tail", "inner"],
                )

    sized = files.select("file").distinct().mapInArrow(sizes, "file string, size long").filter("size > 0")
    blocks = sized.select("file", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block_tokens).cast("long") - 1)).alias("block"))
    return blocks.repartition("file", "block").mapInArrow(scan, "file string, block long, tokens long, ends long, head long, tail long, inner array<long>")


def token_counts(files: DataFrame, end: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, place, n_tokens, ended) of every document in the files (column file): place from 0 in its file.

    Blocks are searched apart. Running sums over a file's blocks, of which there are few, give the documents ended before each
    block and the tokens left open there: sums of tails up to the block, less those up to the last block with a separator.
    Tokens after a file's last separator are a document that has not ended; a file without tokens has no documents, and
    two separators in a row end a document of 0 tokens.
    """
    by_block = Window.partitionBy("file").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    cast = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    blocks = cut(scan_blocks(files, end, block_tokens), "blocks").withColumns({"first": cast(F.sum("ends").over(before)), "tails": cast(F.sum("tail").over(before)), "final": F.lead("block").over(by_block).isNull()})
    blocks = blocks.withColumn("open", F.col("tails") - cast(F.max(F.when(F.col("ends") > 0, F.col("tails"))).over(before)))
    stitched = F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))
    ended = blocks.filter("ends > 0").select("file", "first", F.posexplode(stitched).alias("k", "n_tokens"), F.lit(True).alias("ended"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))
    unended = blocks.filter(F.col("final") & (left > 0)).select("file", (F.col("first") + F.col("ends")).alias("first"), F.lit(0).alias("k"), left.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(unended).select("file", (F.col("first") + F.col("k")).alias("place"), "n_tokens", "ended")


def document_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row of docs: its tokens are written to flat files, and counted from the files alone.

    Documents end with the first id above the vocabulary at `path`, which no text can hold. A null or empty text has 0 tokens; rows that
    repeat an id, and rows without one, are counted one by one; an empty table gives an empty result; other columns are ignored.
    """
    path = path or bpe.public_vocabulary()
    end = bpe.codec(path).top
    manifest = write_token_files(docs, lambda t: bpe.codec(path).encode(t), end)
    counted = token_counts(manifest, end)
    return manifest.join(counted, ["file", "place"]).select("doc_id", "n_tokens")
