"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped.

A set of files is a folder with, for each shard ``s``: ``s.ids`` (the ids of its documents one after the other,
little-endian, two bytes each if the vocabulary allows it, else four), ``s.offsets`` (unsigned 64-bit: where each
document starts in the shard, and its end) and ``s.docs`` (signed 64-bit doc_ids; the least value stands for null). Shards
follow each other in ascending doc_id order. The manifest has a row per shard with its base: the number of ids in all
shards before it, a prefix sum of the shards' totals.

Rows with equal doc_id lie in the order of a hash of their text; a null text is empty; a null doc_id comes first.
A task that is run again writes files of a new name, and only the ones of the finished attempt are in the manifest.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teleledger.llm import common, tokens

NULL_ID = -(2**63)
_MANIFEST = "part int, shard string, docs long, tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Documents whose ids are mapped and summed at a time when reading.
_READ_ROWS = 4096


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    dtype: str
    manifest: DataFrame  # part, shard, docs, tokens, base


def _stream(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where the file system is local, else read."""
    from pyarrow import fs

    system, path = _stream(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if system.get_file_info(path).size else np.zeros(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def in_doc_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending order over the partitions; rows of one doc_id may lie in several."""
    n = common.partitions(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    return keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = 0,
          dtype: str = "<u2") -> TokenFiles:
    """Encode ``text`` of ``docs``, append ``end_id`` to each document and write the files into ``folder``."""
    spark = docs.sparkSession
    common.small_batches(spark)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, kind)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        name = f"{part:06d}-{name}"
        system, path = _stream(f"{folder}/{name}")
        offsets, ids = array("Q", [0]), array("q")
        total, out = 0, None
        for batch, _ in tokens.together(batches):
            if out is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(f"{path}.ids")
            found = encoder.ids(batch.column("text"))
            # Each document has an id more than in ``found``.
            starts = total + found.edges[1:] + np.arange(1, batch.num_rows + 1)
            offsets.extend(starts.tolist())
            ids.extend([NULL_ID if doc is None else doc for doc in batch.column("doc_id").to_pylist()])
            values = np.insert(found.flat, found.edges[1:], end_id)
            total += values.size
            narrow = values.astype(dtype)
            if values.size and int(values.max()) > np.iinfo(narrow.dtype).max:
                raise ValueError(f"an id does not fit {dtype}")
            out.write(narrow.tobytes())
        if out is None:
            return
        out.close()
        for suffix, data in (("offsets", np.array(offsets, dtype="<u8")), ("docs", np.array(ids, dtype="<i8"))):
            with system.open_output_stream(f"{path}.{suffix}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "shard": [name], "docs": pa.array([len(ids)], pa.int64()),
            "tokens": pa.array([total], pa.int64())})

    made = common.stored(in_doc_order(docs).mapInArrow(shard, _MANIFEST), "token-shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    manifest = made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))
    return TokenFiles(folder, dtype, common.stored(manifest, "token-manifest"))


def read(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and the CRC of the ids as unsigned 32-bit integers, from the files alone."""
    folder, dtype = files.folder, files.dtype

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(f"{folder}/{row['shard']}.ids", dtype)
                offsets = _mapped(f"{folder}/{row['shard']}.offsets", "<u8").astype(np.int64)
                docs = _mapped(f"{folder}/{row['shard']}.docs", "<i8")
                for i in range(0, len(docs), _READ_ROWS):
                    edge = offsets[i:i + _READ_ROWS + 1]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                    own = np.asarray(docs[i:i + _READ_ROWS])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID),
                        "start": pa.array(row["base"] + edge[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(edge), pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    spark = files.manifest.sparkSession
    spread = files.manifest.repartition(common.partitions(spark), "shard")
    return spread.mapInArrow(documents, _READ)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """Write the files into a new run folder and read every document back."""
    return read(write(docs, common.run_folder(spark, "token-files"), tokenizer, kind, end_id))
