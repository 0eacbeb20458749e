"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is a token as a
whole: one hash, one displacement, one comparison of bytes. Tier two: a miss is merged from its
bytes with a heap of adjacent pairs over a linked list of positions, lowest rank first and leftmost
among equals, in O(n log n) for a pre-token of n bytes.

The rank file's path is a parameter; the driver reads it and sends the tables. Pre-tokens recur: texts
are split in parts of up to PART characters, each part's different pre-tokens are looked up once, and Arrow
gathers their ids back into texts. Each worker also remembers the results of recent pre-tokens in two
generations of bounded size. Encoding and decoding are single passes without a shuffle, over whole texts.

Defined results: null and empty texts have no tokens and decode to nothing; a text of any length is
encoded whole; repeated rows encode alike; an empty table gives none; columns named like an output
are replaced, others pass through. Ids that the vocabulary lacks raise an error when decoded.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, types as T

from grainmill.llm._common import with_arrow

_MASK = (1 << 64) - 1
#: Characters, pre-tokens or ids that are in work at a time.
PART = 1 << 20


class PerfectHash:
    """A minimal perfect hash of n byte strings onto 0..n-1, by hash and displace.

    Keys fall into buckets by their hash; buckets, largest first, each take the first displacement
    that sends all of their keys to free slots.
    """

    def __init__(self, keys: list[bytes], load: float = 3.0):
        self.n = len(keys)
        self.buckets = max(1, int(self.n / load))
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.displacement = [0] * self.buckets
        self.slots: list[int] = [-1] * self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                break
            own = [hashes[i] for i in members[b]]
            d = 0
            while len({x for x in (self._slot(h, d) for h in own) if self.slots[x] < 0}) < len(own):
                d += 1
            for h, i in zip(own, members[b], strict=True):
                self.slots[self._slot(h, d)] = i
            self.displacement[b] = d
        free = iter([x for x in range(self.n) if self.slots[x] < 0])
        for b in range(self.buckets):  # a single key needs no search: a negative displacement names its slot
            if len(members[b]) == 1:
                x = next(free)
                self.slots[x], self.displacement[b] = members[b][0], -1 - x

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 7) ^ (d * 0x9E3779B97F4A7C15 & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK
        return (x ^ x >> 32) % self.n

    def index(self, key: bytes) -> int:
        """The only index the key can have; whether it is that key must be compared."""
        h = xxhash.xxh64_intdigest(key)
        d = self.displacement[h % self.buckets]
        return self.slots[self._slot(h, d) if d >= 0 else -1 - d]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token, by repeated merging of the adjacent pair with the lowest rank.

    A heap entry is one integer, the pair's rank and where it starts; it is stale unless that place still has it.
    """
    n = len(piece)
    width = 12 if n < 1 << 12 else n.bit_length()
    low = (1 << width) - 1
    end = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n))  # where the token to the left starts
    rank = ranks.get
    now = [-1 if (r := rank(piece[i : i + 2])) is None else r << width | i for i in range(n - 1)]  # the entry that holds for each place, or -1
    now.append(-1)
    heap = [x for x in now if x >= 0]
    heapify(heap)
    while heap:
        x = heappop(heap)
        i = x & low
        if now[i] != x:
            continue
        j = end[i]
        e = end[i] = end[j]
        now[j] = -1
        before[e] = i
        if e < n and (r := rank(piece[i : end[e]])) is not None:
            now[i] = r = r << width | i
            heappush(heap, r)
        else:
            now[i] = -1
        if i:
            p = before[i]
            if (r := rank(piece[p:e])) is not None:
                now[p] = r = r << width | p
                heappush(heap, r)
            else:
                now[p] = -1
    out, i = [], 0
    while i < n:
        e = end[i]
        out.append(ranks[piece[i:e]])
        i = e
    return out


def _latin(category: str) -> str:
    """The Latin letters or numbers below U+0250, as ranges of a character class."""
    own = [c for c in range(0x250) if unicodedata.category(chr(c))[0] == category]
    runs = [c for c in own if c - 1 not in own], [c for c in own if c + 1 not in own]
    return "".join(f"\\u{i:04x}-\\u{j:04x}" for i, j in zip(*runs, strict=True))


def _splitter(pattern: str):
    """A function from text to the compiled pattern for it; texts in ASCII or Latin letters get the faster standard module, with \\p{L}, \\p{N} and \\s spelt out."""
    full = regex.compile(pattern)
    spaces = r"\t-\r \x85\xa0"  # all white space below U+0250
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{_latin('L')}{_latin('N')}]").replace(r"\p{L}", f"[{_latin('L')}]").replace(r"\p{N}", f"[{_latin('N')}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    if re.search(r"\\[pPdDwWbB]|\(\?[a-zA-Z]", plain):
        return lambda text: full
    latin, other = re.compile(plain), re.compile(r"[^\x00-\u024f\u2010-\u2027]").search
    return lambda text: latin if text.isascii() or not other(text) else full


def _joined(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The large-binary values of each range between bounds, put together: the same bytes under fewer offsets."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset :][bounds] if len(values) else np.zeros(len(bounds), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at), data if data is not None else pa.py_buffer(b"")])


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str, remember: int = 150_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = list(self.ranks)
        self.ids = list(self.ranks.values())
        self.whole = PerfectHash(self.tokens)
        self.table = pa.array(self.tokens, pa.large_binary())
        self.slot_of = np.full(max(self.ids, default=-1) + 1, -1, np.int64)
        self.slot_of[self.ids] = np.arange(len(self.ids))
        self.pattern = pattern
        self.split = _splitter(pattern)
        self.remember = remember
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece_ids(self, piece: bytes) -> list[int]:
        i = self.whole.index(piece)
        return [self.ids[i]] if self.tokens[i] == piece else merge(piece, self.ranks)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "split"} | {"young": {}, "old": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.split = _splitter(self.pattern)

    def _new(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            ids = self.piece_ids(piece.encode("utf-8"))
            got = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.young) >= self.remember:
                self.old, self.young = self.young, {}
            self.young[piece] = got
        return got

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The text's pre-tokens; a long text's in parts."""
        if len(text) <= PART:
            yield self.split(text).findall(text)
            return
        found = (m[0] for m in self.split(text).finditer(text))
        while part := list(islice(found, PART)):
            yield part

    def _encode_part(self, pieces: list[str], bounds: list[int]) -> pa.Array:
        """Packed ids of each range of pieces between bounds."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        which = coded.indices.to_numpy()
        first = np.zeros(len(coded.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        known, new = self.young.get, self._new
        packed = pa.array([known(p) or new(p) for p in map(pieces.__getitem__, first.tolist())], pa.large_binary())
        return _joined(packed.take(coded.indices), np.asarray(bounds))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Per text its ids, as little-endian unsigned 32-bit integers."""
        pieces, bounds, chars = [], [0], 0
        for text in texts:
            if text and len(text) > PART:
                yield from self._encode_part(pieces, bounds).to_pylist()
                pieces, bounds, chars = [], [0], 0
                yield b"".join(self._encode_part(p, [0, len(p)])[0].as_py() for p in self._pieces(text))
                continue
            if text:
                pieces += next(self._pieces(text))
                chars += len(text)
            bounds.append(len(pieces))
            if chars >= PART:
                yield from self._encode_part(pieces, bounds).to_pylist()
                pieces, bounds, chars = [], [0], 0
        yield from self._encode_part(pieces, bounds).to_pylist()

    def encode_packed(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes | None) -> bytes:
        """The bytes that packed ids stand for."""
        ids = np.frombuffer(packed or b"", "<u4")
        return b"".join(self._decode_part(ids[i : i + PART], [0, len(ids[i : i + PART])])[0].as_py() for i in range(0, len(ids), PART))

    def _decode_part(self, ids: np.ndarray, bounds: list[int]) -> pa.Array:
        if len(ids):
            at = self.slot_of[np.minimum(ids, len(self.slot_of) - 1)]
            if ids.max() >= len(self.slot_of) or at.min() < 0:
                raise KeyError("an id that the vocabulary lacks")
            return _joined(self.table.take(pa.array(at)), np.asarray(bounds))
        return _joined(self.table.slice(0, 0), np.zeros(len(bounds), np.int64))

    def decode_all(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """Per text the bytes that its packed ids stand for."""
        held, bounds = [], [0]
        for packed in texts:
            n = len(packed or b"") // 4
            if n > PART:
                yield from self._decode_part(np.frombuffer(b"".join(held), "<u4"), bounds).to_pylist()
                held, bounds = [], [0]
                yield self.decode_packed(packed)
                continue
            held.append(packed or b"")
            bounds.append(bounds[-1] + n)
            if bounds[-1] >= PART:
                yield from self._decode_part(np.frombuffer(b"".join(held), "<u4"), bounds).to_pylist()
                held, bounds = [], [0]
        yield from self._decode_part(np.frombuffer(b"".join(held), "<u4"), bounds).to_pylist()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """Built once on the driver; its size is that of the vocabulary, whatever the data."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """docs with `ids` (binary: little-endian unsigned 32-bit integers) and `n_tokens` (long).

    decoded: the name of a further column with the bytes that the ids decode to, as `decode` gives them, by the same worker
    in the same pass.
    """
    sent = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def add(b: pa.RecordBatch) -> dict[str, pa.Array]:
        packed = list(sent.value.encode_all(t.as_py() for t in b.column(b.schema.get_field_index(text))))
        out = {"ids": pa.array(packed, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64())}
        return out if decoded is None else out | {decoded: pa.array(list(sent.value.decode_all(packed)), pa.binary())}

    outputs = {"ids": T.BinaryType(), "n_tokens": T.LongType()} | ({} if decoded is None else {decoded: T.BinaryType()})
    return with_arrow(docs, add, outputs, keep=keep)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encoded with the bytes that its ids stand for, as binary."""
    sent = encoded.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def add(b: pa.RecordBatch) -> dict[str, pa.Array]:
        return {out: pa.array(list(sent.value.decode_all(x.as_py() for x in b.column(b.schema.get_field_index(ids)))), pa.binary())}

    return with_arrow(encoded, add, {out: T.BinaryType()}, keep=keep)
