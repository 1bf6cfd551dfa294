"""Byte-level BPE, encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are vocabulary
entries themselves; the others are merged with a heap over a linked list of their bytes. What a
pre-token encodes to is remembered in a bounded memo of the Python worker.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fresh

#: Remembered pre-tokens of a generation, of which there are two. Longer pre-tokens than MEMO_CHARS aren't remembered.
MEMO_ENTRIES, MEMO_CHARS = 150_000, 64
_M64 = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


def _mixed(h: int, displacement: int) -> int:
    h = ((h ^ (displacement * _ODD)) * 0xBF58476D1CE4E5B9) & _M64
    return h ^ (h >> 32)


class MinimalPerfectHash:
    """Gives n distinct keys the numbers 0 .. n - 1 without storing the keys (hash and displace).

    Keys fall into buckets; largest first, each bucket gets the first displacement that sends its
    keys to free numbers. A bucket of one key holds a free number itself, as -1 - number.
    """

    def __init__(self, keys: list[bytes], displacements: list[int] | None = None, load: int = 3):
        self.n = n = len(keys)
        self.buckets = max(1, n // load)
        self.displacements = displacements or [0] * self.buckets
        if displacements:
            return
        members: dict[int, list[int]] = {}
        for h in map(xxhash.xxh3_64_intdigest, keys):
            members.setdefault(h % self.buckets, []).append(h)
        taken = bytearray(n)
        single = []
        for bucket, hashes in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(hashes) == 1:
                single.append(bucket)
                continue
            if len(set(hashes)) < len(hashes):
                raise ValueError("keys are not distinct")
            d = 0
            while True:
                at = [_mixed(h, d) % n for h in hashes]
                if len(set(at)) == len(at) and not any(taken[x] for x in at):
                    break
                d += 1
            for x in at:
                taken[x] = 1
            self.displacements[bucket] = d
        free = (x for x in range(n) if not taken[x])
        for bucket, x in zip(single, free):
            self.displacements[bucket] = -1 - x

    def __call__(self, key: bytes) -> int:
        """The number of a key; of anything else some number."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacements[h % self.buckets]
        return -1 - d if d < 0 else _mixed(h, d) % self.n


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Memo(dict):
    """What pre-tokens encode to. A full generation becomes the old one; what is still in use comes back from there."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, token: str) -> bytes:
        if (found := self.old.get(token)) is None:
            found = self.codec.encode_token(token.encode("utf-8", "surrogatepass"))
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[token] = found
        return found


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, displacements: list[int] | None = None):
        self.ranks = ranks
        tokens = list(ranks)
        self.hash = MinimalPerfectHash(tokens, displacements)
        self.packed = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.slots: list[tuple[bytes, bytes]] = [(b"", b"")] * len(tokens)
        for t in tokens:
            self.slots[self.hash(t)] = (t, self.packed[t])
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        # the library's white space is Unicode's White_Space
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.memo = Memo(self)

    def encode_token(self, token: bytes) -> bytes:
        known, packed = self.slots[self.hash(token)]
        return packed if known == token else self.merge(token)

    def merge(self, token: bytes) -> bytes:
        """Lowest rank first, leftmost first among equals. after[i]: where the part that starts at i ends, -1 once it has been swallowed. A heap entry is one integer: rank, start and end."""
        n, rank = len(token), self.ranks.get
        width = n.bit_length()
        mask, double = (1 << width) - 1, 2 * width
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << double | i << width | i + 2 for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, end = entry >> width & mask, entry & mask
            middle = after[i]
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(token[i : after[end]])) is not None:
                    heappush(heap, r << double | i << width | after[end])
            if (p := before[i]) >= 0 and (r := rank(token[p:end])) is not None:
                heappush(heap, r << double | p << width | end)
        ids, i, packed = [], 0, self.packed
        while i < n:
            ids.append(packed[token[i : after[i]]])
            i = after[i]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        return b"".join([memo[t] for t in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec_of(raw: bytes, pattern: str, displacements: list[int] | None = None) -> Codec:
    """Made once in a process for each rank file and pattern."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(raw), pattern, displacements)
    return _codecs[key]


def _shipped(df: DataFrame, ranks_path: str, pattern: str):
    """The rank file and the perfect hash, which is found on the driver, for the executors. Both have the vocabulary's size."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    return df.sparkSession.sparkContext.broadcast((raw, codec_of(raw, pattern).hash.displacements))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row of docs: ids as little-endian unsigned 32-bit integers, and the bytes that they decode to.

    A null text is an empty one; an empty text has no ids; texts and pre-tokens of any length are
    encoded whole, and no rows give no rows. No special tokens. A null id stays null,
    rows that repeat come back as often, other columns are not looked at. The rank file is read on
    the driver and broadcast: its size is that of the vocabulary.
    """
    shipped = _shipped(docs, ranks_path, pattern)

    def make():
        raw, displacements = shipped.value
        codec = codec_of(raw, pattern, displacements)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

        return run

    kind = dict(docs.dtypes)[id_col]
    return by_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, ids binary, decoded binary")


def encoded_documents(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """docs with ids and n_tokens in place of the text, the other columns as they are; rows as in encode. decoded adds decoded_sha256, the digest of the bytes that the ids decode to. Where docs has a column of one of these names it stays, and the new one has an underscore more."""
    shipped = _shipped(docs, ranks_path, pattern)
    rest = [c for c in docs.columns if c != "text"]
    new = {fresh(c, rest): t for c, t in (("ids", "binary"), ("n_tokens", "long"), *([("decoded_sha256", "string")] if decoded else []))}

    def make():
        raw, displacements = shipped.value
        codec = codec_of(raw, pattern, displacements)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [codec.encode(t or "") for t in b.column("text").to_pylist()]
            made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded:
                made.append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()))
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made], [*rest, *new])

        return run

    kinds = dict(docs.dtypes)
    return by_batch(docs.select(*rest, "text"), make, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"`{c}` {kind}" for c, kind in new.items())]))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
