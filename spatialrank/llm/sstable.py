"""Token-ID output as sorted-string-table shards: documents by identifier, looked up by binary search.

A shard is a file::

    data block*   zstd of entries; an entry is  varint shared, varint rest, varint size, key[shared:], ids
    index block   one entry for each data block: its first key, offset, stored size, first key's position
    bloom filter  bits over the identifiers of the shard
    footer        offsets and sizes of both, number of documents, number of ids, version, magic

A key is the identifier as 8 bytes, big-endian with its sign bit turned, so that byte order is number
order; within a block each key leaves out the bytes it shares with the one before.  A null identifier
is the empty key, which sorts first.  Ids are little-endian unsigned integers of 16 bits, or of 32 where
the document has a larger one.

Writing shuffles the texts once by ranges of (identifier, hash of the text) and tokenises them in order, so a shard is a
range, of about ``SHARD_BYTES`` of text at most, and many rows with one identifier or none spread over several.  A task writes
under a name of its own attempt; only the shards named by tasks that ended well are in the manifest, so tasks
may be lost and repeated.  Rows with the same identifier all stay, ordered by the text's hash and then the text.  A null
or empty text is a document of its end id alone.  An empty table gives no shard and no rows.  Very long texts are
entries as any other; other columns of the table aren't read.  Identifiers are any 64-bit integers.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .bytesops import mix
from .tokens import encoder, with_end

MAGIC = b"SRSSTBL1"
SHARD_BYTES = 1 << 28
_FOOTER = struct.Struct("<QQQQQQI8s")
_INDEX = struct.Struct("<QQQ")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (int(doc_id) + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    h = mix(np.array([(int.from_bytes(k, "big") + len(k)) % 2**64 for k in keys], np.uint64))
    step = (h >> np.uint64(33)) | np.uint64(1)
    return (h[:, None] + np.arange(hashes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class Writer:
    """Appends documents in ascending order of identifier to an open binary file."""

    def __init__(self, out, block_bytes: int = 1 << 16, bloom_bits: int = 10, bloom_hashes: int = 7):
        self.out, self.block_bytes, self.bloom = out, block_bytes, (bloom_bits, bloom_hashes)
        self.block, self.last, self.first = bytearray(), None, None
        self.index, self.keys, self.offset, self.n_ids = [], [], 0, 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("documents must come in ascending order")
        shared = 0
        if self.last is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        wide = len(ids) and int(ids.max()) > 0xFFFF
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value) << 1 | bool(wide)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.last is not None:
            data = self.pack.compress(bytes(self.block))
            self.out.write(data)
            self.index.append((self.first, self.offset, len(data), len(self.block)))
            self.offset += len(data)
            self.block, self.last = bytearray(), None

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _INDEX.pack(*rest) for k, *rest in self.index)
        bits = max(64, len(self.keys) * self.bloom[0])
        filled = np.zeros(bits, np.uint8)
        if self.keys:
            filled[_bloom_places(self.keys, bits, self.bloom[1]).ravel()] = 1
        bloom = struct.pack("<QI", bits, self.bloom[1]) + np.packbits(filled, bitorder="little").tobytes()
        footer = _FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), len(self.keys), self.n_ids, 1, MAGIC)
        self.out.write(index + bloom + footer)


class Reader:
    """Reads a shard; ``open_at(offset, size)`` gives bytes, so only what is needed is fetched."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_ids, _, magic = _FOOTER.unpack(read_at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data, at, self.keys, self.blocks = read_at(index_at, index_size) if index_size else b"", 0, [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            self.blocks.append(_INDEX.unpack_from(data, at + n))
            at += n + _INDEX.size
        bloom = read_at(bloom_at, bloom_size)
        self.bits, self.hashes = struct.unpack_from("<QI", bloom)
        self.bloom = np.frombuffer(bloom, np.uint8, offset=12)
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, size, whole = self.blocks[i]
        data, at, key = self.unpack.decompress(self.read_at(offset, size), max_output_size=whole), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, "<u4" if n & 1 else "<u2", (n >> 1) // (4 if n & 1 else 2), at).astype(np.uint32)
            at += n >> 1

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, ids in self._block(i):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        p = _bloom_places([key_of(doc_id)], self.bits, self.hashes)[0].astype(np.int64)
        return bool((self.bloom[p >> 3] >> (p & 7).astype(np.uint8) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The documents with this identifier, by Bloom filter, binary search for the block, and a scan of it."""
        if not self.blocks or not self.may_hold(doc_id):
            return []
        key, found = key_of(doc_id), []
        for i in range(max(0, bisect.bisect_left(self.keys, key) - 1), bisect.bisect_right(self.keys, key)):
            found += [ids for k, ids in self._block(i) if k == key]
        return found


def _file(path: str):
    from pyarrow import fs

    # other names of the same stores
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^dbfs:/+", "file:///dbfs/", path)))


def open_shard(path: str) -> Reader:
    store, name = _file(path)
    file = store.open_input_file(name)

    def read_at(offset: int, size: int) -> bytes:
        file.seek(offset)
        return file.read(size)

    return Reader(read_at, file.size())


MANIFEST = "number int, shard string, first_id long, last_id long, has_null boolean, n_docs long, n_ids long"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards below ``path``; returns the manifest, in no order; ``number`` is a shard's place.

    ``shards`` is a number to aim at; a range without documents writes none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(scratch.partitions(spark), -(-size // SHARD_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, out, ends, null = f"{path}/{uuid.uuid4().hex}.sst", None, None, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, local = _file(name)
                store.create_dir(local.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(local)
                writer = Writer(out)
            ids, counts = with_end(*encoder(vocabulary).ids(batch.column(1)), end_id)
            keys, at = batch.column(0).to_pylist(), 0
            for key, n in zip(keys, counts.tolist(), strict=True):
                writer.add(key, ids[at : at + n])
                at += n
            null |= keys[0] is None
            ends += [k for k in (next((k for k in keys if k is not None), None), keys[-1]) if k is not None]
        if writer is not None:
            writer.close()
            out.close()
            row = {"number": TaskContext.get().partitionId(), "shard": name, "first_id": min(ends, default=None), "last_id": max(ends, default=None), "has_null": null, "n_docs": len(writer.keys), "n_ids": writer.n_ids}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("number", pa.int32()), ("shard", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("has_null", pa.bool_()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    order = [F.col("doc_id").asc_nulls_first(), F.col("mark").asc()]
    ordered = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return scratch.materialize(ordered.select("doc_id", "text").mapInArrow(task, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row for each document in the shards: doc_id, start, n_tokens, ids (array).

    ``start`` is the number of ids of all documents before it, over all shards.  The window that adds up
    shards has one row for each shard, so it is small whatever the corpus is.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("base", before).select("shard", "base")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys, values in _runs(open_shard(shard), 1 << 19):
                    counts = np.array([len(v) for v in values], np.int64)
                    start = base + np.cumsum(counts) - counts
                    base += int(counts.sum())
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start), pa.array(counts), ids], schema=schema)

    return _spread(placed).mapInArrow(task, "doc_id long, start long, n_tokens long, ids array<long>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """As ``read``, with the crc32 of the ids as little-endian 32-bit integers instead of the ids."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("base", before).select("shard", "base")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys, values in _runs(open_shard(shard), 1 << 20):
                    counts = np.array([len(v) for v in values], np.int64)
                    start = base + np.cumsum(counts) - counts
                    base += int(counts.sum())
                    crc = [zlib.crc32(v.astype("<u4").tobytes()) for v in values]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _spread(placed).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _runs(reader: Reader, most: int) -> Iterator[tuple[list, list]]:
    """The documents of a shard in runs of about ``most`` ids."""
    keys, values, n = [], [], 0
    for key, ids in reader:
        keys.append(key)
        values.append(ids)
        n += len(ids)
        if n >= most:
            yield keys, values
            keys, values, n = [], [], 0
    if keys:
        yield keys, values


def _spread(placed: DataFrame) -> DataFrame:
    return placed.repartition(scratch.partitions(placed.sparkSession))


def lookup(spark: SparkSession, manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """The ids of the documents with one identifier: the manifest's ranges choose the shards."""
    near = F.col("has_null") if doc_id is None else (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    return [ids.tolist() for row in manifest.where(near).collect() for ids in open_shard(row.shard).get(doc_id)]
