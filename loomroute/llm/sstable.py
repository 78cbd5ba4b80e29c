"""Sorted-string-table shards of token ids.

File layout, all integers little-endian::

    data blocks | block index | Bloom filter | footer

An entry is ``shared (varint), unshared (varint), value bytes (varint), key suffix, value``; the key is the
part shared with the previous key plus the suffix. Every ``RESTART`` entries a key is stored whole. A block
ends with the offsets of its whole keys and their count (u32 each), so a lookup in a block is a binary search
over these and a short scan. The block index has each block's last key, offset, length and CRC-32. The Bloom
filter holds every key (10 bits each, 7 probes from one XXH64). The footer is fixed: offsets of index and
filter, counts, bytes per id, magic.

Keys are identifiers as 8 bytes in big-endian order with the sign bit flipped, so byte order is numeric order;
a null identifier is the empty key and comes first. Values are ids of 2 bytes if the vocabulary allows, else 4.

Defined cases: null text counts as empty; rows that repeat an identifier are kept as neighbouring entries,
ordered by text, and ``get`` returns the first of them; empty tables write no shard and read as no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomroute.plans.workspace import new_folder, save, shuffle_width

MAGIC = b"LRSST001"
BLOCK_BYTES = 1 << 16
RESTART = 16
BLOOM_BITS = 10
BLOOM_PROBES = 7
_FOOTER = struct.Struct("<QQQQQQB7x8s")
#: Entries of a worker's memo of pre-tokens, and the longest kept in it (characters).
MEMO_ENTRIES = 1_000_000
MEMO_CHARS = 48


def encode_key(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", identifier + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


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


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes entries in key order to a stream; memory holds one block, the block index and 8 bytes a key."""

    def __init__(self, stream, id_bytes: int) -> None:
        self.stream, self.id_bytes = stream, id_bytes
        self.offset = self.entries = self.tokens = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[int] = []
        self.last: bytes | None = None
        self.first: bytes | None = None
        self._open_block()

    def _open_block(self) -> None:
        self.block, self.size, self.restarts, self.in_block = [], 0, [], 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must come in order")
        if self.in_block % RESTART == 0:
            self.restarts.append(self.size)
            shared = 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += (entry, value)
        self.size += len(entry) + len(value)
        self.in_block += 1
        self.entries += 1
        self.tokens += len(value) // self.id_bytes
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.first = key if self.first is None else self.first
        self.last = key
        if self.size >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if not self.in_block:
            return
        data = b"".join(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        self.stream.write(data)
        self.index.append((self.last, self.offset, len(data), zlib.crc32(data)))
        self.offset += len(data)
        self._open_block()

    def close(self) -> None:
        self._close_block()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QII", o, n, crc) for k, o, n, crc in self.index)
        bits = max(64, -(-self.entries * BLOOM_BITS // 8) * 8)
        h = np.array(self.hashes, dtype=np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        marks = np.zeros(bits, dtype=np.uint8)
        # The probes of _probes(), where sums don't wrap: reduce both terms first.
        for i in range(BLOOM_PROBES):
            marks[(h % np.uint64(bits) + (np.uint64(i) * (step % np.uint64(bits))) % np.uint64(bits)) % np.uint64(bits)] = 1
        bloom = np.packbits(marks, bitorder="little").tobytes()
        self.stream.write(index + bloom)
        self.stream.write(_FOOTER.pack(self.offset, len(index), len(bloom), self.entries, self.tokens, len(self.index), self.id_bytes, MAGIC))


class Reader:
    """Opens a shard: footer, index and filter are held, blocks are read when asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        if size < _FOOTER.size:
            raise ValueError("not a shard: too short")
        footer = source.read_at(_FOOTER.size, size - _FOOTER.size)
        at, n_index, n_bloom, self.entries, self.tokens, n_blocks, self.id_bytes, magic = _FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        index = source.read_at(n_index, at)
        self.bloom = source.read_at(n_bloom, at + n_index)
        self.blocks, pos = [], 0
        for _ in range(n_blocks):
            n, pos = _read_varint(index, pos)
            self.blocks.append((index[pos : pos + n], *struct.unpack_from("<QII", index, pos + n)))
            pos += n + 16
        self.last_keys = [b[0] for b in self.blocks]

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, offset, length, crc = self.blocks[i]
        data = self.source.read_at(length, offset)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        n = struct.unpack_from("<I", data, length - 4)[0]
        return data[: length - 4 * (n + 1)], list(struct.unpack_from(f"<{n}I", data, length - 4 * (n + 1)))

    @staticmethod
    def _scan(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, data[at : at + n]
            at += n

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.id_bytes}")

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8))

    def get(self, identifier: int | None) -> np.ndarray | None:
        """The ids of a document; None if the shard doesn't hold it."""
        key = encode_key(identifier)
        if not self.blocks or not self.may_have(key):
            return None
        i = bisect.bisect_left(self.last_keys, key)
        if i == len(self.blocks):
            return None
        data, restarts = self._block(i)
        whole = [next(self._scan(data, r))[0] for r in restarts]
        for k, value in self._scan(data, restarts[max(bisect.bisect_left(whole, key) - 1, 0)]):
            if k >= key:
                return self.ids(value) if k == key else None
        return None

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, value in self._scan(self._block(i)[0], 0):
                yield decode_key(key), self.ids(value)


class WordEncoder:
    """Ids of whole texts from a tokenizers vocabulary whose pre-tokens end in an end-of-word mark.

    Such a vocabulary encodes every pre-token alone, so a worker remembers the ids of those it has met and asks
    the library for the others only, many at a time. Texts with characters for which lower-casing, composition
    or the classes of the splitting pattern need the library's own tables go to the library whole, and so do texts
    that hold an added token, which the library finds before it splits.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.memo: dict[str, bytes] = {}
        letters = r"a-z\xdf-\xf6\xf8-\xff"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\t-\r {letters}0-9]+").findall
        self.unusual = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]").search
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE).search

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of distinct pre-tokens: encoded in one text, cut after each end-of-word id."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("this vocabulary doesn't encode pre-tokens alone")
            raw, width = ids.tobytes(), self.dtype.itemsize
            stops = (cuts * width).tolist()
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops))))

    def encode(self, texts: list[str]) -> list[bytes]:
        memo, out, plain = self.memo, [b""] * len(texts), []
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        other = []
        for i, text in enumerate(texts):
            if (text.isascii() or not self.unusual(text)) and not self.added(text):
                plain.append((i, self.split(text.lower())))
            else:
                other.append(i)
        missing = set().union(*(words for _, words in plain)).difference(memo)
        long_words = {w for w in missing if len(w) > MEMO_CHARS}
        self._learn(list(missing))
        for i, words in plain:
            out[i] = b"".join(map(memo.__getitem__, words))
        for w in long_words:
            del memo[w]
        for i, ids in zip(other, self._whole([texts[i] for i in other])):
            out[i] = ids
        return out


@functools.lru_cache(maxsize=4)
def loaded(path: str) -> WordEncoder:
    return WordEncoder(path)


def _filesystem(path: str):
    """File system and path of a URI of any store that Arrow knows, or of a plain path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and write one shard per range of doc_id; a manifest row (shard, path, entries, tokens) each.

    A shard is written under a name of its own attempt and then moved, so a task that runs again after an
    executor is lost replaces whole files only.
    """

    def run(batches):
        encoder = loaded(tokenizer_path)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        fs, base = _filesystem(folder)
        final = f"{base}/shard-{shard:06d}.sst"
        writer = stream = None
        draft = f"{base}/.draft-{shard:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                values = encoder.encode([t or "" for t in texts.slice(at, 256).to_pylist()])
                for identifier, value in zip(ids[at : at + 256], values):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        stream = fs.open_output_stream(draft)
                        writer = Writer(stream, encoder.dtype.itemsize)
                    writer.add(encode_key(identifier), value + end)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.sst"], "entries": [writer.entries], "tokens": [writer.tokens]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards or shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return save(ordered.mapInArrow(run, "shard long, path string, entries long, tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, read from the files. The manifest has a row per file."""
    start, files = 0, []
    for row in manifest.orderBy("shard").collect():
        files.append((row["path"], start))
        start += row["tokens"]

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, at = _filesystem(path)
                rows = []
                with fs.open_input_file(at) as source:
                    for identifier, ids in Reader(source):
                        rows.append((identifier, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    spark = manifest.sparkSession
    listed = spark.createDataFrame(files, "path string, base long")
    return listed.repartition(max(len(files), 1)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, new_folder(spark, "token_ids"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))
