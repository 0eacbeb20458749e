"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes decides at each start of a word whether a chunk ends
there, so boundaries depend on nothing but nearby content: an insertion shifts no chunk beyond its
neighbourhood. Chunks (`mean_words` on average, never inside a word or a character) are known by
a 64-bit digest. Of equal chunks the first, in the order of (document id, text hash, position),
stays; a run of neighbouring repeats of at least `min_words` words is removed. Shorter runs stay:
a few common words are no copied passage.

Scale and skew
* Each task first drops repeats among its own chunks (numpy, `window` chunks at a time), so a
  passage that a third of all documents share sends one row per task and window to the shuffle
  that finds the first of each digest. Repeats found early travel under their own salt and are
  never grouped.
* The shuffle carries 24 bytes a chunk; texts move once, to meet the list of their repeats.

Defined results: a null text stays null, an empty one empty; very long texts are chunked whole;
rows with equal id and text count as one document and get equal results; null ids come first in the
order; an empty table gives none; extra columns pass through, ones named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from grainmill.llm._common import Placed, map_arrow, with_arrow

WINDOW_BYTES = 16
#: One 16-bit gear value per byte, from a hash of the byte.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Stands before and after a place where text was cut out, if both sides go on.
JOINT = b"\n"


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-k]] << k over the last 16 bytes, modulo 2^16, for all i at once by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step) if step < len(h) else h[step:]
    return h


def word_starts(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    return np.flatnonzero(first)


def chunk_starts(data: np.ndarray, mean_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where chunks begin, and the number of words of each; none for a text without words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = word_starts(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gear(data)
    cut = np.zeros(len(starts), bool)
    cut[1:] = h[starts[1:] - 1] < 65536 // mean_words
    cut[0] = True
    at = np.flatnonzero(cut)
    return starts[at], np.diff(np.append(at, len(starts)))


def chunks(text: bytes, mean_words: int) -> list[bytes]:
    """The chunks without the white space behind them."""
    at = chunk_starts(np.frombuffer(text, np.uint8), mean_words)[0].tolist()
    return [text[i:j].rstrip(b" \t\n\r\x0b\x0c") for i, j in zip(at, [*at[1:], len(text)], strict=False)]


def repeated_runs(dup: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Runs (first chunk, last chunk + 1) of neighbouring repeats with enough words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], dup.astype(np.int8), [0]))))
    total = np.concatenate(([0], np.cumsum(words)))
    return [(int(i), int(j)) for i, j in zip(edge[::2], edge[1::2], strict=True) if total[j] - total[i] >= min_words]


def chunk_rows(docs: DataFrame, id_col: str, text: str, mean_words: int, window: int = 1 << 18) -> DataFrame:
    """(digest, salt, id, pos): the chunks of all texts; salt is 0 for chunks that are the first of a task's window, else the row's own."""

    def flush(parts):
        ids, nulls, pos, dig = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((pos, ids, ~nulls, dig))
        ids, nulls, pos, dig = (x[order] for x in (ids, nulls, pos, dig))
        new = np.ones(len(dig), bool)
        new[1:] = dig[1:] != dig[:-1]
        # An equal row is the same document once more, and no repeat of it.
        equal = np.zeros(len(dig), bool)
        equal[1:] = ~new[1:] & (ids[1:] == ids[:-1]) & (nulls[1:] == nulls[:-1]) & (pos[1:] == pos[:-1])
        ids, nulls, pos, dig, new = (x[~equal] for x in (ids, nulls, pos, dig, new))
        salt = np.where(new, 0, np.arange(1, len(dig) + 1))
        return pa.RecordBatch.from_arrays([pa.array(dig.view(np.int64)), pa.array(salt, pa.int32()), pa.array(ids, pa.int64(), mask=nulls), pa.array(pos)], names=["digest", "salt", "id", "pos"])

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for doc, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False), strict=True):
                if not t:
                    continue
                own = chunks(t, mean_words)
                n = len(own)
                if not n:
                    continue
                dig = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, n)
                pos = (np.int64(h) << np.int64(32)) | np.arange(n, dtype=np.int64)
                parts.append((np.full(n, doc or 0, np.int64), np.full(n, doc is None), pos, dig))
                size += n
                if size >= window:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    placed = Placed(docs)
    narrow = placed.df.select(placed(id_col).cast("bigint"), placed(text).cast("string").cast("binary"), _text_hash(placed(text)))
    return map_arrow(narrow, run, "digest bigint, salt int, id bigint, pos bigint")


def _text_hash(text: Column) -> Column:
    """31 bits of the text's hash: tells texts apart that share an id, and orders them."""
    return F.shiftrightunsigned(F.xxhash64(text.cast("string")), 33).cast("bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mean_words: int = 5) -> DataFrame:
    """(id, h, dup): per document (id and text hash) the numbers of its chunks that are not the first of their kind."""
    rows = chunk_rows(docs, id_col, text, mean_words)
    same = rows.withColumn("first", F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", "pos")).over(Window.partitionBy("digest", "salt")))
    again = same.where("salt > 0 or not (id <=> first.id and pos = first.pos)")
    h = F.shiftrightunsigned("pos", 32).cast("bigint")
    return again.groupBy("id", h.alias("h")).agg(F.collect_set(F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("dup"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mean_words: int = 5, min_words: int = 20) -> DataFrame:
    """docs with the repeated passages cut out of the text, and `removed` (array of byte spans of the old text), `n_removed_words`, `n_chunks`."""
    placed = Placed(docs)
    own = placed.place(text)
    found = repeats(docs, id_col, text, mean_words).select(F.col("id").alias("fid"), F.col("h").alias("fh"), "dup")
    d = placed.df.withColumn("key", F.coalesce(_text_hash(placed(text)), F.lit(-1)))
    met = d.join(found.hint("shuffle_hash"), placed(id_col).cast("bigint").eqNullSafe(F.col("fid")) & (F.col("key") == F.col("fh")), "left").drop("fid", "fh", "key")

    def add(b: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, dups = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (own, "dup"))
        out, spans, cut_words, counts = [], [], [], []
        for t, dup in zip(texts, dups, strict=True):
            raw = t.encode("utf-8") if t else b""
            at, n = chunk_starts(np.frombuffer(raw, np.uint8), mean_words)
            ends = np.append(at[1:], len(raw))
            hit = np.zeros(len(at), bool)
            if dup:
                hit[dup] = True
            runs = repeated_runs(hit, n, min_words)
            gone = [(int(at[i]), int(ends[j - 1])) for i, j in runs]
            keep, last = [], 0
            for i, j in gone:
                keep.append(raw[last:i])
                last = j
            keep.append(raw[last:])
            out.append(t if not gone else JOINT.join(x for x in (k.strip(b" \t\n\r\x0b\x0c") for k in keep) if x).decode("utf-8"))
            spans.append([{"start": i, "end": j} for i, j in gone])
            cut_words.append(int(sum(n[i:j].sum() for i, j in runs)))
            counts.append(len(at))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return {own: pa.array(out, pa.string()), "removed": pa.array(spans, kind), "n_removed_words": pa.array(cut_words, pa.int64()), "n_chunks": pa.array(counts, pa.int64())}

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    outputs = {own: T.StringType(), "removed": span, "n_removed_words": T.LongType(), "n_chunks": T.LongType()}
    done = with_arrow(met, add, outputs, keep=placed.df.columns)
    named = [x for x in outputs if x != own]
    return done.select(*placed.others(named), *named)
