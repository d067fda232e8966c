"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in order. Ids are dealt into blocks of BLOCK. A block subtracts
its least id, packs the differences at the width that a given share of them needs, and lists the others as
exceptions (place and whole difference). The index at the end of the file has every block's first byte and
every document's id and length, so any document can be read without the others.

Layout, little-endian: MAGIC | blocks | block starts u64 | doc ids i64 | null flags u8 | lengths u64 | tail.
Block: least u32, count u32, width u8, exceptions u32 | packed words u32 | places u16 | differences u32.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared, tokens

MAGIC, BLOCK, LANES = b"WFPFOR01", 4096, 128
HEAD, TAIL = struct.Struct("<IIBI"), struct.Struct("<QQQQ8s")
ROWS = BLOCK // LANES  # values of a lane; 32 values of w bits fill w words


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """BLOCK values below 2**width as width * LANES words; lane j has values j, j + LANES, ..."""
    rows = values.reshape(ROWS, LANES)
    out = np.zeros((width, LANES), np.uint32)
    for r in range(ROWS):
        word, bit = divmod(r * width, 32)
        if width:
            out[word] |= rows[r] << np.uint32(bit)
            if bit + width > 32:
                out[word + 1] |= rows[r] >> np.uint32(32 - bit)
    return out.reshape(-1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((ROWS, LANES), np.uint32)
    if width:
        rows, mask = words.reshape(width, LANES), np.uint32((1 << width) - 1)
        for r in range(ROWS):
            word, bit = divmod(r * width, 32)
            v = rows[word] >> np.uint32(bit)
            if bit + width > 32:
                v = v | (rows[word + 1] << np.uint32(32 - bit))
            out[r] = v & mask
    return out.reshape(-1)


def encode_block(ids: np.ndarray, share: float = 0.97) -> bytes:
    """At most BLOCK ids; share: of the differences that the packed width must hold."""
    least, n = int(ids.min()), len(ids)
    diff = np.zeros(BLOCK, np.uint32)
    diff[:n] = ids - np.uint32(least)
    at = np.partition(diff[:n], k := min(n - 1, int(share * n)))[k]
    width = int(at).bit_length()
    places = np.nonzero(diff >> np.uint32(width))[0] if width < 32 else np.zeros(0, np.int64)
    rest = diff[places].copy()
    diff[places] = 0
    return HEAD.pack(least, n, width, len(places)) + pack(diff, width).tobytes() + places.astype("<u2").tobytes() + rest.astype("<u4").tobytes()


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    least, n, width, k = HEAD.unpack_from(data, at)
    at += HEAD.size
    words = np.frombuffer(data, "<u4", width * LANES, at)
    at += 4 * width * LANES
    diff = unpack(words, width)
    diff[np.frombuffer(data, "<u2", k, at)] = np.frombuffer(data, "<u4", k, at + 2 * k)
    return diff[:n] + np.uint32(least)


class Writer:
    """Streams documents to a file; memory holds a block and the index."""

    def __init__(self, out):
        self.out, self.at, self.starts, self.rest = out, len(MAGIC), [], np.zeros(0, np.uint32)
        self.doc_ids, self.nulls, self.lengths = [], [], []
        out.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        self.at += self.out.write(encode_block(ids))

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += [0 if x is None else x for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.lengths += lengths.tolist()
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._put(ids[i : i + BLOCK])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        self.out.write(np.array(self.starts, "<u8").tobytes() + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.out.write(TAIL.pack(self.at, len(self.starts), len(self.doc_ids), sum(self.lengths), MAGIC))


class Reader:
    """Documents of a file, in order or by place. f: a seekable file."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - TAIL.size)
        index, blocks, docs, self.n_ids, magic = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        f.seek(index)
        raw = f.read(8 * blocks + 17 * docs)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(index)).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        self.nulls = np.frombuffer(raw, "u1", docs, 8 * blocks + 8 * docs)
        self.ends = np.cumsum(np.frombuffer(raw, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64))

    def blocks(self, first: int, last: int) -> np.ndarray:
        self.f.seek(int(self.starts[first]))
        data = self.f.read(int(self.starts[last] - self.starts[first]))
        return np.concatenate([decode_block(data, int(self.starts[b] - self.starts[first])) for b in range(first, last)])

    def ids(self, k: int) -> np.ndarray:
        """Of the document at place k, by the blocks that hold it."""
        a, b = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        first, last = a // BLOCK, -(-b // BLOCK)
        return self.blocks(first, last)[a - first * BLOCK : b - first * BLOCK] if b > a else np.zeros(0, np.uint32)

    def checksums(self, step: int = 256):
        """The crc32 of each document's ids, step blocks at a time."""
        k, crc, n = 0, 0, len(self.ends)
        for first in range(0, len(self.starts) - 1, step):
            ids = self.blocks(first, min(first + step, len(self.starts) - 1)).astype("<u4")
            base, at = first * BLOCK, 0
            while k < n and self.ends[k] <= base + len(ids):
                to = int(self.ends[k]) - base
                yield zlib.crc32(ids[at:to], crc)
                k, crc, at = k + 1, 0, to
            crc = zlib.crc32(ids[at:], crc)


MANIFEST = "shard int, path string, bytes long, docs long, tokens long"


def write_blocks(docs: DataFrame, spark: SparkSession, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text to files in ascending order of id_col; returns the written manifest.

    Nulls: a null text is empty, a null id comes first. Rows with equal ids are ordered by their text's hash.
    An empty table gives no files. Other columns are not read. A file's name has the task's attempt, and the
    manifest, which Spark commits, names the file that counts, so lost or repeated tasks do no harm.
    """
    folder = shared.work_folder(spark, "token-blocks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def put(batches):
        enc, w, path, sink = tokens.encoder(tokenizer), None, "", None
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for part in shared.slices(batch, "text"):
                if w is None:
                    fs, root = shared.file_system(folder)
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.wfb"
                    sink = fs.open_output_stream(path)
                    w = Writer(sink)
                ids, starts = enc.encode(part.column(1))
                w.add(part.column(0).to_pylist(), np.diff(starts), ids)
        if w is not None:
            w.close()
            n = sink.tell()
            sink.close()
            name = path.rpartition("/")[2]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "bytes": n, "docs": len(w.doc_ids), "tokens": sum(w.lengths)}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return shared.written(rows.mapInArrow(shared.tidy(put), MANIFEST), spark, "token-manifest")


def read_blocks(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names.

    The driver holds one number for each file: the ids in the files before it.
    """
    before, at = {}, 0
    for r in sorted(manifest.select("shard", "tokens").collect()):
        before[r.shard], at = at, at + r.tokens
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def get(batches):
        for batch in batches:
            for shard, path, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, name = shared.file_system(path)
                with fs.open_input_file(name) as f:
                    r = Reader(f, size)
                    starts = np.concatenate([[0], r.ends[:-1]]) if len(r.ends) else r.ends
                    crcs = np.fromiter(r.checksums(), np.int64, len(r.ends))
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, mask=r.nulls.astype(bool)), pa.array(starts + before[shard]), pa.array(r.ends - starts), pa.array(crcs)], schema=out)

    files = manifest.select("shard", "path", "bytes").repartition(max(1, len(before)), "shard") if len(before) > 1 else manifest.select("shard", "path", "bytes")
    return files.mapInArrow(shared.tidy(get), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` as token ids in block files, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    manifest = write_blocks(shared.table(spark, sf_dir, "documents"), spark, public_tokenizers.path("byte_bpe_50k.json"))
    return read_blocks(manifest)
