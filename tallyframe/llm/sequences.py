"""Token ids in Arrow files of fixed-size-list batches.

Documents are dealt to files by ranges of ``doc_id`` and written in that order. A file is an Arrow
file (random access) whose rows are sequences of one length: ``ids``, a fixed-size list of the
smallest unsigned type that holds the vocabulary, and ``mask``, a fixed-size list of booleans that is
false only behind the last id of a file. Nothing is compressed, so a reader that maps the file sees
ids and masks in place. A second Arrow file beside it lists the documents with their place.

Tasks name their files anew on every attempt and report them; only files of the attempts that Spark
kept are in the manifest, so a lost executor leaves at most files that nobody reads.

Defined results: null or empty text is the end id alone; a null ``doc_id`` comes before all others;
rows of equal ``doc_id`` follow each other in no fixed order; an empty table gives an empty manifest.
Other columns are ignored. Memory is bounded by one batch of rows and one text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import parts_for, settle, shared_folder
from tallyframe.llm.tokens import encoder

LENGTH = 2048
ROWS = 128
END = 2
MANIFEST = "part int, path string, n_tokens long, n_docs long"


def _store(folder: str):
    """The folder's file system and its path there; Spark may name a local folder without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class _Writer:
    """Cuts a stream of ids into rows of one length and batches of ``ROWS`` rows."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind, self.held, self.n = length, kind, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        step = ROWS * self.length
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            self._batch(ids[at : min(at + step, whole)])
        self.held, self.n = [ids[whole:]], len(ids) - whole

    def _batch(self, ids: np.ndarray) -> None:
        short = -len(ids) % self.length
        mask = np.ones(len(ids) + short, bool)
        mask[len(ids) :] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.pad(ids, (0, short)), mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.file.close()


def _writing(folder: str, tokenizer: str, length: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, base = _store(folder)
        part = TaskContext.get().partitionId()
        path = f"part-{part:06d}-{uuid.uuid4().hex}"
        encode, dtype = encoder(tokenizer), np.dtype(kind)
        out = places = sink = None
        starts, total, docs = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]), 0, 0
        for batch in batches:
            if out is None:
                store.create_dir(base, recursive=True)
                sink, beside = store.open_output_stream(f"{base}/{path}.arrow"), store.open_output_stream(f"{base}/{path}.docs.arrow")
                out, places = _Writer(sink, length, dtype), pa.ipc.new_file(beside, starts)
            sizes = []
            for text in batch["text"]:
                ids = np.frombuffer(encode.encode(text), "<u4").astype(dtype)
                out.add(np.append(ids, dtype.type(END)))
                sizes.append(len(ids) + 1)
            ends = total + np.cumsum(np.array(sizes, np.int64))
            places.write_batch(pa.record_batch([pa.array(batch["doc_id"], pa.int64(), from_pandas=True), pa.array(ends - sizes), pa.array(np.array(sizes, np.int64))], schema=starts))
            total, docs = int(ends[-1]) if len(ends) else total, docs + len(sizes)
        if out is not None:
            out.close()
            places.close()
            sink.close()
            beside.close()
            yield pd.DataFrame({"part": [part], "path": [path], "n_tokens": [total], "n_docs": [docs]})

    return run


def write(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, vocabulary: int = 49_408) -> DataFrame:
    """Write the files of ``docs`` (``doc_id, text``) under ``folder``; returns their manifest, one row per file."""
    spark = docs.sparkSession
    kind = "uint16" if vocabulary <= 2**16 else "uint32"
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .repartitionByRange(parts_for(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )
    manifest = settle(ordered.mapInPandas(_writing(folder, tokenizer, length, kind), MANIFEST), "manifest")
    # one row per file is ordered as a whole, never a document
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _reading(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        for batch in batches:
            for path, first in zip(batch["path"], batch["first"]):
                with store.open_input_file(f"{base}/{path}.arrow") as f, store.open_input_file(f"{base}/{path}.docs.arrow") as g:
                    file, places = pa.ipc.open_file(f), pa.ipc.open_file(g)
                    at, held = 0, np.empty(0, "<u4")
                    for i in range(places.num_record_batches):
                        docs = places.get_batch(i)
                        sums = []
                        for size in docs["n_tokens"].to_pylist():
                            crc = 0
                            while size:
                                if not len(held):
                                    row = file.get_batch(at)
                                    ids, mask = (x.flatten().to_numpy(zero_copy_only=False) for x in (row["ids"], row["mask"]))
                                    held, at = ids[mask].astype("<u4"), at + 1
                                piece, held = held[:size], held[size:]
                                crc, size = zlib.crc32(piece.tobytes(), crc), size - len(piece)
                            sums.append(crc)
                        yield pd.DataFrame({"doc_id": docs["doc_id"].to_pandas().astype("Int64"), "start": docs["start"].to_numpy() + first, "n_tokens": docs["n_tokens"].to_numpy(), "ids_crc32": np.array(sums, np.int64)})

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    files = manifest.select("path", "first").repartition(parts_for(manifest.sparkSession), "path")
    return files.mapInPandas(_reading(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **how) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "sequences")
    return read(write(docs, folder, **how), folder)
