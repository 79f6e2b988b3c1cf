"""Token-id files: ids of fixed bit width, with block offsets.

File layout (little-endian): magic ``BITS0001``, then five int64 (width, ids a
block, number of ids, number of blocks, number of documents), the doc_ids, the
documents' starts within the file (one more than documents), the blocks' byte
offsets from the first block (one more than blocks), and the blocks. A block
holds groups of 64 ids in exactly ``width`` 64-bit words, so any block, and any
group in it, is unpacked on its own by 64 vector operations.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import commit_file, frugal, open_folder, ready, scratch
from .textops import text_slices
from .tokens import encoder_for

MAGIC = b"BITS0001"
BLOCK_IDS = 8192


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit words of ids (padded with 0 to a multiple of 64)."""
    groups = -(-len(ids) // 64)
    v = np.zeros(groups * 64, np.uint64)
    v[:len(ids)] = ids
    v = v.reshape(groups, 64)
    out = np.zeros((groups, width), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, word] |= v[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, k] >> np.uint64(64 - shift)
    return out.ravel()


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed words."""
    words = words.reshape(-1, width)
    out, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = v & mask
    return out.ravel()[:n]


class TokenFile:
    """Random access to one file: document index and blocks."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        head = self.file.read_at(48, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.width, self.block, self.n, blocks, docs = struct.unpack("<5q", head[8:])
        index = np.frombuffer(self.file.read_at(8 * (2 * docs + 2 + blocks), 48), np.int64)
        self.doc_ids, self.starts, self.offsets = np.split(index, [docs, 2 * docs + 1])
        self.base = 48 + 8 * len(index)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b-1 of the file, from the blocks that hold them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        raw = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), self.base + int(self.offsets[first]))
        n = min(self.n, (last + 1) * self.block) - first * self.block
        return unpack(np.frombuffer(raw, np.uint64), self.width, n)[a - first * self.block:b - first * self.block]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _file_parts(doc_ids: np.ndarray, bounds: np.ndarray, chunks: list[np.ndarray], width: int) -> Iterator[bytes]:
    """The file's bytes; ``chunks`` hold whole blocks, but for the last."""
    n = int(bounds[-1])
    blocks = -(-n // BLOCK_IDS)
    ids_in = np.minimum(BLOCK_IDS, n - np.arange(blocks, dtype=np.int64) * BLOCK_IDS)
    offsets = np.concatenate([[0], np.cumsum(-(-ids_in // 64) * width * 8)]).astype(np.int64)
    yield MAGIC + struct.pack("<5q", width, BLOCK_IDS, n, blocks, len(doc_ids))
    yield doc_ids.tobytes() + bounds.astype(np.int64).tobytes() + offsets.tobytes()
    for c in chunks:
        yield c.tobytes()


MANIFEST = "file string, low long, n_docs long, n_ids long, bytes long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
                      vocabulary: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order.

    Rows are range-partitioned and sorted by doc_id, one file a partition.
    Null text counts as empty: a document of the end id alone. Rows without a
    doc_id have no place in the order and are left out. Rows that repeat a
    doc_id are written one after the other, by text. A file is moved from a
    temporary name into place, so a repeated task replaces its own file only.
    Returns the manifest: file, its smallest doc_id, documents, ids, bytes.
    """
    width = bit_width(vocabulary)

    def write(batches):
        encoder = encoder_for(tokenizer)
        doc_ids, lengths, chunks, rest = [], [], [], np.zeros(0, np.uint32)
        for batch in batches:
            doc_ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for _, _, data, offsets in text_slices(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                rest = np.concatenate([rest, np.insert(ids, bounds[1:], end_id)])
                lengths.append(np.diff(bounds) + 1)
                whole = len(rest) // BLOCK_IDS * BLOCK_IDS
                chunks.append(pack(rest[:whole], width))
                rest = rest[whole:]
        if not doc_ids or not sum(map(len, doc_ids)):
            return
        chunks.append(pack(rest, width))
        doc_ids, bounds = np.concatenate(doc_ids), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        task = TaskContext.get()
        fs, at = open_folder(folder)
        name = f"ids-{task.partitionId():06d}.bits"
        size = commit_file(fs, at, name, str(task.taskAttemptId()), _file_parts(doc_ids, bounds, chunks, width))
        yield pa.RecordBatch.from_pydict({"file": [name], "low": [int(doc_ids[0])], "n_docs": [len(doc_ids)],
                                          "n_ids": [int(bounds[-1])], "bytes": [size]})

    rows = ready(docs).select("doc_id", "text").where("doc_id is not null")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(frugal(write), MANIFEST)


def read_token_files(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """Documents of the files in ``manifest`` (rows of write_token_files).

    Returns doc_id, start (ids of all documents before it), n_tokens, ids. The
    manifest has one row a file, so the starts of files are summed here.
    """
    files, start = [], 0
    for row in sorted(manifest, key=lambda r: (r["low"], r["file"])):
        files.append((row["file"], start))
        start += row["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def read(batches):
        fs, at = open_folder(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with TokenFile(fs, f"{at}/{name}") as f:
                    step = 512
                    for i in range(0, len(f.doc_ids), step):
                        starts = f.starts[i:i + step + 1]
                        ids = f.ids(int(starts[0]), int(starts[-1]))
                        rel = starts - starts[0]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": f.doc_ids[i:i + step], "start": first + starts[:-1],
                            "n_tokens": np.diff(starts),
                            "ids": pa.array([ids[a:b].tobytes() for a, b in zip(rel[:-1], rel[1:])], pa.binary())})

    if not files:
        return spark.createDataFrame([], schema)
    listed = ready(spark.createDataFrame(files, "file string, start long"))
    return listed.repartition(len(files), "file").mapInArrow(read, schema)


def token_file_digest(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int,
                      vocabulary: int) -> DataFrame:
    """Write the files to the shared folder, read them back, and digest each document's ids."""
    folder = scratch(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, end_id, vocabulary).collect()
    return read_token_files(spark, folder, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
