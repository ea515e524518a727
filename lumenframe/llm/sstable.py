"""Token ids in sorted-string tables.

A shard holds the documents of one key range in ascending order. Data blocks come first; an
entry is the length of the key's prefix shared with the entry before, the rest of the key and the
ids, so a block is read from its start. Then follow a sparse index (the first key, place, entries
and ids of each block), a Bloom filter of all keys, and a footer that tells where they are. A
lookup asks the filter, finds the block by binary search and reads that block alone: a reader
seeks, and never holds more than index, filter and one block.

Shards are written by the tasks of one job that is partitioned by ranges of the id and, within
equal ids, of a hash of the text, under a temporary name first; the manifest lists those of the
attempts that succeeded, and readers take only files that it names.

Defined results: a null text is an empty one, with the end id alone; rows with a null id come
first, under a key of their own; rows that repeat an id each keep an entry, in the order of their
text's hash and then of the text, and may run over several shards; an empty table has no shards
and gives an empty result; other columns are ignored, whatever their names. Strings of the
tokenizer's own special tokens become those tokens, as the library does by default.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm.chunks import Memo
from lumenframe.llm.common import cut, new_dir

MAGIC = b"LFSST001"
#: Bytes of a data block and of a shard; one entry may be longer than either.
BLOCK, SHARD = 64 << 10, 16 << 20
#: Bits and probes of the Bloom filter for each key: one false positive in a hundred.
BLOOM_BITS, BLOOM_PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQQB7x8s")
_BLOCK = struct.Struct("<QIIQ")
_MANIFEST = "shard string, part long, place long, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    """Bytes in the order of the ids; a null comes first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def id_width(ids: int) -> int:
    """Bytes that hold each of so many ids."""
    return 2 if ids <= 1 << 16 else 4


class ShardWriter:
    """Writes entries in ascending key order to a stream."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.hashes: list[int] = []
        self.docs = self.tokens = 0
        self._open()

    def _open(self) -> None:
        self.block, self.last, self.first, self.block_docs, self.block_tokens = bytearray(), b"", b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.block_docs and len(self.block) >= BLOCK:
            self._close()
        shared = len(os.path.commonprefix([self.last, key])) if self.block_docs else 0
        self.first = self.first or key
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"an id does not fit {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + value
        self.last = key
        self.block_docs += 1
        self.block_tokens += len(ids)
        self.hashes.append(xxhash.xxh3_64_intdigest(key))

    def _close(self) -> None:
        self.out.write(self.block)
        self.index.append((self.first, self.at, len(self.block), self.block_docs, self.block_tokens))
        self.at += len(self.block)
        self.docs += self.block_docs
        self.tokens += self.block_tokens
        self._open()

    def finish(self) -> int:
        """Writes what is left, index, filter and footer; the size of the shard."""
        if self.block_docs:
            self._close()
        index = b"".join(bytes([len(k)]) + k + _BLOCK.pack(at, size, docs, tokens) for k, at, size, docs, tokens in self.index)
        bits = max(64, len(self.hashes) * BLOOM_BITS)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        h = np.array(self.hashes, np.uint64)
        for k in range(BLOOM_PROBES):
            bit = ((h >> np.uint64(32)) + np.uint64(k) * (h & np.uint64(0xFFFFFFFF) | np.uint64(1))) % np.uint64(len(bloom) * 8)
            np.bitwise_or.at(bloom, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(1, (bit & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        self.out.write(index + bloom.tobytes())
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, self.width, MAGIC))
        return self.at + len(index) + len(bloom) + _FOOTER.size


class ShardReader:
    """Reads a shard through a file that can seek: anything with pyarrow's ``size`` and ``read_at``."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        footer = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        at, size, bloom_at, bloom_size, self.docs, self.tokens, self.width, magic = footer
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index, self.bloom = file.read_at(size, at), file.read_at(bloom_size, bloom_at)
        self.keys, self.blocks, at = [], [], 0
        while at < size:
            n = index[at]
            self.keys.append(index[at + 1 : at + 1 + n])
            self.blocks.append(_BLOCK.unpack_from(index, at + 1 + n))
            at += 1 + n + _BLOCK.size

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        """Keys and ids of one block."""
        at, size, _, _ = self.blocks[block]
        data = memoryview(self.file.read_at(size, at))
        at, key = 0, b""
        while at < size:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            at += rest
            yield key, np.frombuffer(data[at : at + n * self.width], f"<u{self.width}")
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def may_hold(self, key: bytes) -> bool:
        h = xxhash.xxh3_64_intdigest(key)
        for k in range(BLOOM_PROBES):
            bit = ((h >> 32) + k * (h & 0xFFFFFFFF | 1)) % (len(self.bloom) * 8)
            if not self.bloom[bit // 8] >> bit % 8 & 1:
                return False
        return True

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry with this id."""
        key, found = key_of(doc_id), []
        if not self.keys or not self.may_hold(key):
            return found
        # Equal keys may run over several blocks: start before the first that begins with the key.
        block = max(0, bisect_right(self.keys, key) - 1)
        while block and self.keys[block] == key:
            block -= 1
        while block < len(self.keys) and self.keys[block] <= key:
            found += [ids for k, ids in self.entries(block) if k == key]
            block += 1
        return found


Encoder = Callable[[Iterable[bytes]], Iterator[bytes]]
_READY: dict[str, Encoder] = {}


def _encoder(tokenizer_path: str) -> Encoder:
    """UTF-8 texts to the bytes of their 32-bit ids, by the tokenizers library."""
    if tokenizer_path not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)

        def encode(parts: list[str]) -> list[np.ndarray]:
            return [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

        def texts(parts: Iterable[bytes]) -> Iterator[bytes]:
            parts = iter(parts)
            while some := [x.decode() for x in islice(parts, 64)]:
                yield from (x.tobytes() for x in encode(some))

        _READY[tokenizer_path] = Memo(_chunk_encoder(tokenizer, encode)).texts if _cuts_are_safe(tokenizer_path) else texts
    return _READY[tokenizer_path]


def _cuts_are_safe(tokenizer_path: str) -> bool:
    """Whether the tokenizer is a plain byte-level one, for which the cuts of ``chunks`` hold."""
    with open(tokenizer_path, encoding="utf-8") as f:
        made = json.load(f)
    first = made.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    return bool(plain and not made.get("normalizer") and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in made["added_tokens"]))


def _chunk_encoder(tokenizer, encode: Callable[[list[str]], list[np.ndarray]], together: int = 200) -> Callable[[list[str]], list[bytes]]:
    """Encodes chunks, ``together`` in one text: those that begin with a space and end with another
    character meet at cuts again. Each id's number of bytes tells where a chunk ends."""
    size = np.zeros(tokenizer.get_vocab_size(), np.int64)
    special = {x.content for x in tokenizer.get_added_tokens_decoder().values()}
    for token, i in tokenizer.get_vocab().items():
        size[i] = len(token.encode()) if token in special else len(token)  # one character stands for each byte

    def run(parts: list[str]) -> list[bytes]:
        done: list[bytes] = [b""] * len(parts)
        plain = [i for i, x in enumerate(parts) if len(x) > 1 and x[0] == " " and not x[-1].isspace()]
        kept = set(plain)
        odd = [i for i in range(len(parts)) if i not in kept]
        for i, ids in zip(odd, encode([parts[i] for i in odd])):
            done[i] = ids.tobytes()
        if plain:
            joined = ["".join([parts[i] for i in plain[k : k + together]]) for k in range(0, len(plain), together)]
            ids = np.concatenate(encode(joined))
            ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(parts[i].encode()) for i in plain])) + 1
            raw = ids.tobytes()
            for i, a, b in zip(plain, [0, *(ends[:-1] * 4).tolist()], (ends * 4).tolist()):
                done[i] = raw[a:b]
        return done

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int, width: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes shards below ``out_dir``. Returns the
    manifest, which is stored beside them: ``shard, part, place, first_id, last_id, n_docs, n_tokens,
    n_bytes, start``, where ``start`` counts the ids of all shards before. The part is the range
    of keys that one task wrote, and the place the shard's among them. ``width``: bytes of an id; by
    default as many as the vocabulary asks for."""
    width = width or id_width(max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = _encoder(tokenizer_path)
        fs, root = pafs.FileSystem.from_uri(out_dir)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        shard, done = None, []

        def close() -> None:
            writer, stream, name, first, last = shard
            size = writer.finish()
            stream.close()
            fs.move(f"{root}/_{name}", f"{root}/{name}")
            done.append((name, part, len(done), first, last, writer.docs, writer.tokens, size))

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts_of(t.as_py() or b"" for t in texts)):
                if shard and shard[0].at >= SHARD:
                    close()
                    shard = None
                if not shard:
                    name = f"{uuid.uuid4().hex}.sst"
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{root}/_{name}")
                    shard = [ShardWriter(stream, width), stream, name, doc_id, doc_id]
                shard[0].add(key_of(doc_id), np.frombuffer(ids + end, "<u4"))
                shard[4] = doc_id
        if shard:
            close()
        columns = [pa.array(list(c), t) for c, t in zip(zip(*done) if done else [[]] * 8, [pa.string()] + [pa.int64()] * 7)]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "place", "first_id", "last_id", "n_docs", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    order = [F.col("doc_id").asc_nulls_first(), "hash"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    shards = cut(rows.mapInArrow(run, _MANIFEST))
    # Ids before a partition's shards, one row for each partition, and before a shard in its partition.
    ahead = lambda order, by: F.coalesce(F.sum(by).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", ahead(Window.orderBy("part"), "n").alias("_before"))
    own = shards.withColumn("_own", ahead(Window.partitionBy("part").orderBy("place"), "n_tokens"))
    manifest = own.join(F.broadcast(parts), "part").withColumn("start", (F.col("_before") + F.col("_own")).cast("long")).drop("_before", "_own")
    manifest.write.parquet(f"{out_dir}/_manifest")
    return docs.sparkSession.read.parquet(f"{out_dir}/_manifest")


def read_tokens(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per entry of the shards that the manifest names: ``doc_id, start, n_tokens,
    ids_crc32, shard``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for shard, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{shard}") as file:
                    reader = ShardReader(file)
                    for block in range(len(reader.blocks)):
                        rows = []
                        for key, ids in reader.entries(block):
                            rows.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                            at += len(ids)
                        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    manifest = spark.read.parquet(f"{out_dir}/_manifest").select("shard", "start")
    return manifest.repartition(max(1, min(manifest.count(), 10_000)), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards to a new folder of the shared ones and reads them back."""
    out_dir = new_dir(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, tokenizer_path, out_dir, end_id, id_col=id_col, text_col=text_col)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    return read_tokens(docs.sparkSession, out_dir)
