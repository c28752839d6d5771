"""Token files: flat unsigned integers and 64-bit document offsets, written and read by many tasks.

Rows are sorted by identifier over the whole table (range partitioning, then a sort in each
partition), and every partition writes one shard of three flat files in the shared folder:
``<shard>.ids`` (identifiers of all its documents one after another, unsigned 16-bit where the
vocabulary allows, else 32-bit, little-endian), ``<shard>.off`` (where each document starts in the
shard, and the end, unsigned 64-bit) and ``<shard>.doc`` (the rows' identifiers, signed 64-bit, and
``<shard>.nul`` one byte per row that marks a missing one). The tasks return the shards' counts,
whose prefix sums are the shards' bases in the whole sequence; they go into ``index.json``. Readers
map the files into memory, so a task touches only the pages of its documents.

A task writes under a name of its own and moves the finished file into place, so a repeated or
speculative task leaves one whole file. The folder may be any that Spark's tasks share and pyarrow
can open. Order: null identifiers first, equal ones by text. Null texts are empty, and an empty text
has the end identifier alone. An empty table gives an index without shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from aestudy.llm.common import keyed_texts
from aestudy.llm.tokens import encoder

SHARD_SCHEMA = "shard int, n_docs long, n_tokens long"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
DOCS_PER_READ = 20_000


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.fs, self.path, self.own = fs, path, f"{path}.{uuid.uuid4().hex}"
        self.stream = fs.open_output_stream(self.own)

    def finish(self) -> None:
        self.stream.close()
        self.fs.move(self.own, self.path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write all rows of ``docs`` into ``folder`` and return the index that was written there."""
    rows = keyed_texts(docs, id_col, text_col).selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    width = encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(width, end_id or 0) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([] if end_id is None else [end_id], dtype=dtype).tobytes()
        files, at, n_docs = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                fs, root = open_folder(folder)
                fs.create_dir(root, recursive=True)
                shard = TaskContext.get().partitionId()
                files = {kind: Output(fs, f"{root}/{shard:07d}.{kind}") for kind in ("ids", "off", "doc", "nul")}
            starts = np.empty(batch.num_rows, dtype="<u8")
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                ids = encode(text.as_py())
                starts[i] = at
                at += len(ids) + (end_id is not None)
                files["ids"].stream.write(ids.astype(dtype).tobytes() + end)
            files["off"].stream.write(starts.tobytes())
            known = batch.column(0)
            files["doc"].stream.write(known.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            files["nul"].stream.write(known.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            n_docs += batch.num_rows
        if files is not None:
            files["off"].stream.write(np.array([at], dtype="<u8").tobytes())
            for file in files.values():
                file.finish()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_tokens": [at]})

    shards = sorted(tuple(r) for r in ordered.mapInArrow(write, SHARD_SCHEMA).collect())
    bases = np.cumsum([0] + [n for _, _, n in shards]).tolist()
    index = {"dtype": dtype, "shards": [{"shard": s, "docs": d, "tokens": n, "base": b} for (s, d, n), b in zip(shards, bases)]}
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    out = Output(fs, f"{root}/index.json")
    out.stream.write(json.dumps(index).encode())
    out.finish()
    return index


def read_index(folder: str) -> dict:
    fs, root = open_folder(folder)
    with fs.open_input_stream(f"{root}/index.json") as stream:
        return json.loads(stream.read())


class Shard:
    """The flat files of one shard, mapped into memory where the folder is a local path."""

    def __init__(self, folder: str, shard: int, dtype: str) -> None:
        self.fs, self.root = open_folder(folder)
        self.dtype = dtype
        self.name = f"{self.root}/{shard:07d}"

    def part(self, kind: str, dtype: str, start: int, stop: int) -> np.ndarray:
        if isinstance(self.fs, pafs.LocalFileSystem):
            return np.memmap(f"{self.name}.{kind}", dtype=dtype, mode="r")[start:stop]
        size = np.dtype(dtype).itemsize
        with self.fs.open_input_file(f"{self.name}.{kind}") as file:
            return np.frombuffer(file.read_at((stop - start) * size, start * size), dtype=dtype)

    def document(self, i: int) -> np.ndarray:
        a, b = self.part("off", "<u8", i, i + 2).tolist()
        return self.part("ids", self.dtype, a, b)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    index = read_index(folder)
    dtype = index["dtype"]
    parts = [(s["shard"], s["base"], at, min(at + DOCS_PER_READ, s["docs"])) for s in index["shards"] for at in range(0, s["docs"], DOCS_PER_READ)]
    jobs = spark.createDataFrame(parts, "shard int, base long, first long, last long")
    if parts:
        jobs = jobs.repartition(len(parts))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for job in frame.itertuples(index=False):
                files = Shard(folder, job.shard, dtype)
                offsets = files.part("off", "<u8", job.first, job.last + 1).astype(np.int64)
                ids = files.part("ids", dtype, int(offsets[0]), int(offsets[-1])) if offsets[-1] > offsets[0] else np.zeros(0, dtype)
                local = offsets - offsets[0]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(local[:-1], local[1:])]
                known = pd.Series(files.part("doc", "<i8", job.first, job.last).astype(np.int64), dtype="Int64")
                known[files.part("nul", "u1", job.first, job.last).astype(bool)] = pd.NA
                yield pd.DataFrame({"doc_id": known, "start": job.base + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": np.array(crc, dtype=np.int64)})

    return jobs.mapInPandas(read, ROW_SCHEMA)
