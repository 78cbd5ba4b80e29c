"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of parts. A part's pair with its right neighbour waits in the bucket of its
merge rank, as the part's position. A two-level bitmap marks the ranks whose bucket is filled; find-first-set
on the top word and then on a leaf gives the next rank. A position whose pair has changed since it was put in
a bucket is stale and skipped. A pre-token of n bytes takes O(n) memory and about O(n) steps, so runs of a
million letters or blanks are no problem.

Equal to the reference encoder for such rank files: the lowest rank is merged first, leftmost first.

Defined cases: null text counts as empty and gives no ids; every row gives one row back; ids outside the
vocabulary raise on decoding; empty tables give empty results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import sliced

#: Entries of a worker's memo of pre-tokens, and the longest pre-token kept in it (characters).
MEMO_ENTRIES = 400_000
MEMO_CHARS = 48

# The splitting pattern's white space is Unicode's White_Space property (fixed code points).
_BLANK = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Among ASCII, the letters U+00C0 to U+017F and common punctuation and currency signs, the standard library's
# classes below equal the pattern's letter, digit and blank classes.
_PLAIN_LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x17F)
_PLAIN_BLANK = r"\t-\r "
_PLAIN_SIGNS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)))
_UNUSUAL = re.compile(rf"[^\x00-\x7f{_PLAIN_LETTERS}{_PLAIN_SIGNS}]")


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.vocabulary: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.leaves = [0] * ((self.size >> 8) + 1)  # all zero between pieces
        self.pair = [-1] * 65536
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_BLANK}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{_BLANK}]").replace(r"\s", f"[{_BLANK}]")
        self.split_any = regex.compile(exact).findall
        plain = exact.replace(_BLANK, _PLAIN_BLANK).replace(r"[^" + _PLAIN_BLANK + r"\p{L}\p{N}]", f"[^{_PLAIN_BLANK}{_PLAIN_LETTERS}0-9]")
        plain = plain.replace(r"\p{L}", f"[{_PLAIN_LETTERS}]").replace(r"\p{N}", "[0-9]")
        self.split_plain = re.compile(plain).findall
        self.memo = _Memo(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)

    def split(self, text: str) -> list[str]:
        return self.split_plain(text) if text.isascii() or not _UNUSUAL.search(text) else self.split_any(text)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        ``top`` and ``leaves`` are the bitmap, ``buckets`` holds a position or a heap of them for each rank, so the
        leftmost of a rank comes first even if a merge puts a better rank before the others.
        The queue is written out here because calls would cost more than its steps.
        """
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # start of the next part
        before = list(range(-1, n))
        pair = self.pair
        waits = [pair[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of the pair that begins here; other entries are stale
        waits.append(-1)
        leaves, buckets, top = self.leaves, {}, 0
        for i, rank in enumerate(waits):
            if rank < 0:
                continue
            if rank in buckets:
                held = buckets[rank]
                if type(held) is int:
                    buckets[rank] = [held, i]
                else:
                    held.append(i)  # ascending, so a heap
            else:
                buckets[rank] = i
                leaves[rank >> 8] |= 1 << (rank & 255)
                top |= 1 << (rank >> 8)
        while top:
            leaf = (top & -top).bit_length() - 1  # find first set, twice
            bits = leaves[leaf]
            bit = bits & -bits
            rank = leaf << 8 | bit.bit_length() - 1
            held = buckets[rank]
            if type(held) is int or len(held) == 1:
                i = held if type(held) is int else held[0]
                del buckets[rank]
                leaves[leaf] = bits ^ bit
                if bits == bit:
                    top ^= 1 << leaf
            else:
                i = heappop(held)
            if waits[i] != rank:
                continue
            j = after[i]
            end = after[j]
            waits[j] = -1
            after[i] = end
            if end < n:
                before[end] = i
                waits[i] = new = rank_of(piece[i : after[end]], -1)
                if new >= 0:
                    if new in buckets:
                        held = buckets[new]
                        if type(held) is int:
                            buckets[new] = [held, i] if held < i else [i, held]
                        else:
                            heappush(held, i)
                    else:
                        buckets[new] = i
                        leaves[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
            else:
                waits[i] = -1
            h = before[i]
            if h >= 0:
                waits[h] = new = rank_of(piece[h:end], -1)
                if new >= 0:
                    if new in buckets:
                        held = buckets[new]
                        if type(held) is int:
                            buckets[new] = [held, h] if held < h else [h, held]
                        else:
                            heappush(held, h)
                    else:
                        buckets[new] = h
                        leaves[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
        ranks = self.ranks
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


class _Memo(dict):
    """Pre-token -> its ids as bytes; long ones are not kept, and none once it is full: frequent ones come early."""

    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS and len(self) < MEMO_ENTRIES:
            self[piece] = packed
        return packed


@functools.lru_cache(maxsize=4)
def loaded(path: str, pattern: str) -> ByteBPE:
    """One per worker and vocabulary."""
    return ByteBPE.load(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian 32-bit binary and the bytes that the ids decode to."""

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in sliced(batches):
            ids = [bpe.encode_bytes(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode_bytes, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), without sending ids and bytes back to the JVM."""

    def run(batches):
        bpe = loaded(path, pattern)
        sha = hashlib.sha256
        for batch in sliced(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode_bytes(text or "")
                rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(bpe.decode_bytes(ids)).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
