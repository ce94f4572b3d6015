"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard is one file of binary records, each followed by one 0x0A byte (the record end that Spark's text writer adds;
it belongs to the format and is skipped by offsets). All integers are little-endian.

- data blocks: zlib of entries in key order. An entry is <u16 shared><u16 rest><u32 value bytes> then the rest of the
  key (its first `shared` bytes are those of the previous key of the block) and the value, 32-bit token ids stored as
  16-bit ones where the vocabulary allows.
- index block: zlib of entries <u64 offset><u32 bytes><u16 key bytes> then the last key of a data block, for each block.
- Bloom block: <u32 bits><u8 probes> then the bit array over the keys.
- footer, 48 bytes: <u64 index offset><u32 index bytes><u64 Bloom offset><u32 Bloom bytes><u64 documents>
  <u64 token ids><u8 bytes a token id><3 zero bytes><4 bytes magic>.

A key is 0x00 for a null identifier, else 0x01 and the identifier, sign bit flipped, as 8 big-endian bytes, so byte
order is identifier order with null first."""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveworks.llm import subwords, wordhash
from sieveworks.llm.store import write_table

MAGIC = b"SWT1"
END = b"\n"
BLOCK_BYTES = 64 << 10
BITS_A_KEY, PROBES = 10, 7
FOOTER = struct.Struct("<QIQIQQB3x4s")
ENTRY, INDEX = struct.Struct("<HHI"), struct.Struct("<QIH")
#: Bytes of text of one shard: at most, and least where more shards would give more tasks.
LARGE_SHARD, SMALL_SHARD = 256 << 20, 16 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else None


def _probes(key: bytes, bits: int, probes: int = PROBES) -> list[int]:
    a, b = struct.unpack("<QQ", blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(probes)]


def build_shard(entries: Iterable[tuple[bytes, bytes]], id_bytes: int) -> Iterator[bytes]:
    """The records of one shard, from (key, value) in key order; a block is held at a time, besides index and keys."""
    at, documents, ids, block, last, index, keys = 0, 0, 0, [], b"", [], []
    size = 0

    def record(body: bytes) -> bytes:
        nonlocal at
        at += len(body) + len(END)
        return body

    for key, value in entries:
        shared = len(os.path.commonprefix([last, key])) if block else 0
        block.append(ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value)
        size += len(block[-1])
        documents, ids, last = documents + 1, ids + len(value) // id_bytes, key
        keys.append(key)
        if size >= BLOCK_BYTES:
            body = zlib.compress(b"".join(block), 1)
            index.append(INDEX.pack(at, len(body), len(last)) + last)
            yield record(body)
            block, size = [], 0
    if block:
        body = zlib.compress(b"".join(block), 1)
        index.append(INDEX.pack(at, len(body), len(last)) + last)
        yield record(body)
    body, index_at = zlib.compress(b"".join(index)), at
    index_bytes = len(body)
    yield record(body)
    bits = max(64, len(keys) * BITS_A_KEY)
    array = np.zeros((bits + 7) // 8, np.uint8)
    for key in keys:
        for p in _probes(key, bits):
            array[p >> 3] |= 1 << (p & 7)
    body, bloom_at = struct.pack("<IB", bits, PROBES) + array.tobytes(), at
    bloom_bytes = len(body)
    yield record(body)
    yield record(FOOTER.pack(index_at, index_bytes, bloom_at, bloom_bytes, documents, ids, id_bytes, MAGIC))


class Shard:
    """Reads one shard's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.index_at, self.index_bytes, self.bloom_at, self.bloom_bytes, self.documents, self.n_ids, self.id_bytes, magic = FOOTER.unpack(
            self.data[-FOOTER.size - len(END) : -len(END)]
        )
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, at = zlib.decompress(self.data[self.index_at : self.index_at + self.index_bytes]), 0
        self.blocks: list[tuple[int, int]] = []
        self.last_keys: list[bytes] = []
        while at < len(raw):
            offset, size, n = INDEX.unpack_from(raw, at)
            at += INDEX.size
            self.blocks.append((offset, size))
            self.last_keys.append(raw[at : at + n])
            at += n

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size = self.blocks[block]
        raw, at, key = zlib.decompress(self.data[offset : offset + size]), 0, b""
        while at < len(raw):
            shared, rest, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self.blocks)):
            yield from self.entries(b)

    def may_have(self, key: bytes) -> bool:
        return bloom_has(self.data[self.bloom_at : self.bloom_at + self.bloom_bytes], key)

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: Bloom filter, then binary search of the index, then the one block, or more for repeats."""
        if not self.may_have(key):
            return []
        found, block = [], bisect_left(self.last_keys, key)
        while block < len(self.blocks):
            own = list(self.entries(block))
            found += [v for k, v in own if k == key]
            if own[-1][0] != key:
                break
            block += 1
        return found

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}").astype("<u4")


def shard_number(spark: SparkSession, text_bytes: int) -> int:
    """One for each LARGE_SHARD of text at least, else one for each SMALL_SHARD up to the session's shuffle partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-text_bytes // LARGE_SHARD), min(parts, -(-text_bytes // SMALL_SHARD)))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None, id_bytes: int = 2) -> None:
    """Writes doc_id and text of docs as shards under path, in ascending doc_id order over shards and within them.

    tokenizer: a file of the tokenizers library whose tokens never cross ASCII white space. id_bytes 2 holds vocabularies
    up to 65,536, 4 any. Null and empty texts give the end id alone; a null id sorts first; repeated ids stay as
    repeated entries, in the order of their texts' hashes, and may go on in the next shard, as may equal rows. A very long text
    is one entry and is encoded whole. Other columns are not read. Texts are dealt by ranges of id and hash and encoded where they arrive, so ids
    are never shuffled; one block and one slice of texts are in a task's memory. The number of shards follows the
    bytes of text. An empty table gives shards without documents."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text")
    n = shards or shard_number(docs.sparkSession, rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    kind, end = f"<u{id_bytes}", np.asarray([end_id], f"<u{id_bytes}").tobytes()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = subwords.memory(tokenizer, kind)

        def entries():
            for part in (p for batch in batches for p in wordhash.slices(batch, 1, subwords.SLICE)):
                ids, word_ends, words = encode(part.column(1))
                bounds = word_ends[words.first].tolist()
                for doc_id, a, b in zip(part.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                    yield key_of(doc_id), ids[a:b].tobytes() + end

        for record in build_shard(entries(), id_bytes):
            yield pa.record_batch([pa.array([record], pa.binary())], ["record"])

    # The row's number cuts runs of equal rows, so that no key is too large for a shard.
    order = F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("number")
    ranged = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    records = ranged.mapInArrow(build, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.text(path)


def _each_shard(spark: SparkSession, path: str | list[str], read, schema: str) -> DataFrame:
    """read(file name, Shard) gives tuples of schema; a file is one row, of about LARGE_SHARD of text at most."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(f.split() for f in schema.split(",")), strict=True)
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[t] for t in types]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = read(name.as_py(), Shard(content.as_buffer()))
                while some := list(islice(rows, 4096)):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], list(names))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, schema)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """For each document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each file is parsed once; the offset of a shard is the sum of the shards before it, in the order of the numbers in their
    files' names, which is that of the ranges, over one row for each shard."""

    def digest(name: str, shard: Shard):
        start, total = 0, shard.n_ids
        for place, (key, value) in enumerate(shard):
            ids = shard.ids(value)
            yield name, place, id_of(key), start, len(ids), zlib.crc32(ids.tobytes()), total
            start += len(ids)

    schema = "shard string, place long, doc_id long, at long, n_tokens long, ids_crc32 long, shard_ids long"
    rows = write_table(_each_shard(spark, path, digest, schema), "shard-digests")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.where("place = 0").select("shard", F.regexp_extract("shard", r"part-(\d+)[^/]*$", 1).cast("long").alias("number"), "shard_ids")
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("base"))
    return rows.join(shards, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def index_shards(spark: SparkSession, path: str) -> DataFrame:
    """A written table with a row for each shard that has documents: shard, first_key, last_key and its Bloom block, from one reading."""

    def describe(name: str, shard: Shard):
        if shard.blocks:
            first = next(shard.entries(0))[0]
            yield name, first, shard.last_keys[-1], bytes(shard.data[shard.bloom_at : shard.bloom_at + shard.bloom_bytes])

    return write_table(_each_shard(spark, path, describe, "shard string, first_key binary, last_key binary, bloom binary"), "shard-index")


def bloom_has(bloom: bytes | memoryview, key: bytes) -> bool:
    """Whether a Bloom block may have been given the key."""
    bits, probes = struct.unpack_from("<IB", bloom)
    return all(bloom[5 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits, probes))


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None], index: DataFrame | None = None) -> DataFrame:
    """doc_id and ids (array of int) of the given identifiers, one row for each entry found; absent ones give none.

    With the table of index_shards only the shards whose key range and Bloom filter may hold one of the keys are read;
    without it every shard is."""
    keys, schema = [key_of(i) for i in doc_ids], "doc_id long, ids array<int>"

    def find(_: str, shard: Shard):
        for key in keys:
            for value in shard.get(key):
                yield id_of(key), shard.ids(value).astype("<i4").tolist()

    if index is None:
        return _each_shard(spark, path, find, schema)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.record_batch([pa.array([s for s, a, b, bloom in rows if any(a <= k <= b and bloom_has(bloom, k) for k in keys)], pa.string())], ["shard"])

    # One name for each shard that may hold a key: a few for each key asked.
    names = sorted(r[0] for r in index.mapInArrow(held, "shard string").collect())
    return _each_shard(spark, names, find, schema) if names else spark.createDataFrame([], schema)
