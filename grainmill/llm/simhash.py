"""SimHash near-duplicate groups, linked through a byte-position inverted index with count filtering.

A fingerprint lane has 64 bits in 8 bytes. Two lanes that differ in at most `max_bits` bits differ
in at most as many bytes, so they share at least `8 - max_bits` bytes *at the same positions*: the
guaranteed minimum. Candidates come from an inverted index on positional bytes, the shared
positional bytes of each candidate pair are tallied, pairs below the minimum are dropped, and what
remains is verified by the Hamming distance.

Posting lists of one byte hold 1/256 of all fingerprints, so a join on them grows with the square
of the corpus. The index is therefore keyed by *sets* of positional bytes: with a minimum of five
matches, one of the eight triples inside {0..3} or inside {4..7} is shared for certain (five of
eight positions put three into one half), and a list then holds 1/16.7M. Lower minimums use
all triples or pairs (`_positions`).

Skew and scale
* Equal fingerprints are one node, whatever their number: a group of copies is aggregated before
  anything is indexed (map-side combine), and comes back through one equi-join, in which nodes of over
  a thousandth of all rows (fewer than a thousand such nodes) meet theirs by broadcast.
* No pair list of a bucket is ever emitted: a bucket's pairs are compared in place, in blocks, and
  leave as a spanning forest of at most n-1 links.
* A list of more than `max_list` fingerprints is not compared as it is but *refined*, exactly: the
  bits outside its key are cut into max_bits+1 parts, one of which is equal in any pair that links,
  and each part gives a new, longer key. As the fingerprints of a lane are distinct, a list whose
  key covers b bits has at most 2^(64-b) members, so refinement ends. No list is cut off.
* Components: tasks contract the links they hold, then alternating large-star and small-star steps,
  each an aggregation and an equi-join, each written to the shared folder. Nothing but row counts
  reaches the driver.

With `lanes` > 1 a document has several independent fingerprints, and links where any lane is
within max_bits. At a Jaccard similarity of 0.9 one lane finds few near copies and eight lanes less
than half (43 % measured, 6 % at 0.8). `keep_one(similarity=...)` is for where a similarity has to be reached: it
takes what fingerprints link as candidates, adds those of MinHash keys, and verifies all (`minhash`).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.llm._common import Placed, forget, map_arrow, with_arrow, written

_BLOCK = 1 << 15
_LANE_SEED = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, A-Z lower-cased, words split at ASCII white space; fewer words: of all of them."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= width:
        return np.array([h(b" ".join(w), 42)], np.uint64)
    return np.fromiter((h(b" ".join(x), 42) for x in zip(*(w[i:] for i in range(width)), strict=False)), np.uint64, len(w) - width + 1)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; the others are independent remixes of it."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        h = h + _LANE_SEED * np.uint64(lane)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray, lane: int = 0) -> int:
    """Bit k is 1 if it is set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _BLOCK):
        part = np.ascontiguousarray(_mixed(h[i : i + _BLOCK], lane)).astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, lanes: int = 1, out: str = "lanes") -> DataFrame:
    """docs without its text, and the fingerprint lanes as an array of signed 64-bit integers."""

    def add(b: pa.RecordBatch) -> dict[str, pa.Array]:
        got = []
        for t in b.column(b.schema.get_field_index(text)):
            h = shingle_hashes(t.as_py(), width)
            got.append(np.array([fingerprint(h, k) for k in range(lanes)], np.uint64).view(np.int64).tolist())
        return {out: pa.array(got, pa.list_(pa.int64()))}

    return with_arrow(docs, add, {out: T.ArrayType(T.LongType())}, keep=[c for c in docs.columns if c != text])


def _positions(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, of which any 8 - max_bits positions contain at least one."""
    if max_bits <= 3:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    if max_bits <= 5:
        return [*combinations(range(8), 3)]
    if max_bits == 6:
        return [*combinations(range(8), 2)]
    if max_bits == 7:
        return [(k,) for k in range(8)]
    raise ValueError("max_bits must be 7 at most: beyond it no byte is shared for certain")


def _links_within(node: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among the fingerprints of one list: tallied, filtered, verified, united."""
    n = len(node)
    root = list(range(n))
    fp = np.ascontiguousarray(fp, np.int64).view(np.uint64)  # of signed numbers numpy counts the bits of the size
    bytes8 = fp.view(np.uint8).reshape(n, 8)
    a_out, b_out = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        shared = (bytes8[i + 1 :] == bytes8[i]).sum(axis=1)
        near = np.flatnonzero(shared >= 8 - max_bits) + i + 1
        for j in near[np.bitwise_count(fp[near] ^ fp[i]) <= max_bits].tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a_out.append(int(node[i]))
                b_out.append(int(node[j]))
    return a_out, b_out


def _compare(postings: DataFrame, max_bits: int, max_list: int) -> DataFrame:
    """(lane, mask, key, a, b): the links of each list of up to max_list entries; of a longer list its key alone, with null a and b.

    A partition is read in key order: one list, of max_list entries at most, is in memory at a time.
    """
    names = ["lane", "mask", "key", "a", "b"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def close(key, parts: list, size: int) -> list[tuple]:
        if size < 2:
            return []
        if size > max_list:
            return [(*key, None, None)]
        node, fp = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        return [(*key, a, b) for a, b in zip(*_links_within(node, fp, max_bits), strict=True)]

    def run(batches):
        last, parts, size = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            lane, mask, key, node, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (mask[1:] != mask[:-1]) | (lane[1:] != lane[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(key))
            # Lists of one entry inside a batch have no pair; the first and the last may go on in the next batch.
            look = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(key)))
            rows = []
            for i, j in zip(starts[look].tolist(), ends[look].tolist(), strict=True):
                here = (int(lane[i]), int(mask[i]), int(key[i]))
                if here != last:
                    rows += close(last, parts, size)
                    last, parts, size = here, [], 0
                size += j - i
                if size <= max_list:
                    parts.append((node[i:j], fp[i:j]))
                else:
                    parts = []
            if rows:
                yield made(rows)
        yield made(close(last, parts, size))

    order = ["lane", "mask", "key"]
    dealt = postings.select(*order, "node", "fp").repartition(*order).sortWithinPartitions(*order)
    return map_arrow(dealt, run, "lane int, mask bigint, key bigint, a bigint, b bigint")


def _split(mask: int, max_bits: int) -> list[int]:
    """Longer masks for a list with this one: the bits it leaves free are cut into max_bits + 1 parts, each added in turn."""
    free = [k for k in range(64) if not mask >> k & 1]
    return [mask | sum(1 << k for k in free[i :: max_bits + 1]) for i in range(min(max_bits + 1, len(free)))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, lanes: int = 1, max_bits: int = 3, max_list: int = 4096) -> DataFrame:
    """(a, b): links among the nodes (node bigint, lanes array of bigint) that keep every component whole."""
    own = nodes.select("node", F.posexplode("lanes").alias("lane", "fp"))
    equal = None
    if lanes > 1:  # equal fingerprints of a lane are linked to one of them, which alone is indexed
        least = own.groupBy("lane", "fp").agg(F.min("node").alias("least"))
        equal = own.join(least, ["lane", "fp"]).where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        own = least.select(F.col("least").alias("node"), "lane", "fp")
    masks = [_signed(sum(255 << 8 * p for p in ps)) for ps in _positions(max_bits)]
    postings = own.select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    out = equal
    while True:
        compared = written(_compare(postings, max_bits, max_list), "simhash-links")
        found = compared.where("a is not null").select("a", "b")
        out = found if out is None else out.unionByName(found)
        long_lists = compared.where("a is null").select("lane", "mask", "key")
        masks = [r["mask"] for r in long_lists.select("mask").distinct().collect()]
        if not masks:
            return out
        longer = F.create_map(*(x for m in masks for x in (F.lit(m), F.array(*(F.lit(_signed(y)) for y in _split(m & (1 << 64) - 1, max_bits))))))
        again = postings.join(long_lists, ["lane", "mask", "key"], "left_semi").select("node", "lane", "fp", F.explode(longer[F.col("mask")]).alias("mask"))
        postings = written(again.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct(), "simhash-refined")


def _contracted(edges: DataFrame, per_task: int) -> DataFrame:
    """The edges of each task as stars: every node with the smallest node that the task's edges lead to. A task holds per_task of its edges at a time."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root.setdefault(up, up)
                x = root[x]
            return x

        def stars():
            ends = [(x, r) for x in root if (r := find(x)) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                if len(root) >= 2 * per_task:
                    yield stars()
        yield stars()

    return map_arrow(edges.select("a", "b"), run, "a bigint, b bigint")


def components(edges: DataFrame, max_rounds: int = 64, per_task: int = 200_000) -> DataFrame:
    """(node, root): for each node of a link its component's smallest node.

    Tasks first contract up to per_task links each (more than that makes more tasks). If that was one
    task it has seen every link; else large-star and small-star rounds join what the tasks found.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        if large:
            got = both.join(hub, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = both.where("b < a")
            hub = down.groupBy("a").agg(F.min("b").alias("m"))
            got = down.join(hub, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(hub.select("a", F.col("m").alias("b")))
        return got.distinct()

    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n_edges = now.count()
    local = written(_contracted(now.repartition(max(1, -(-n_edges // per_task))), per_task), "links")
    forget(now)
    now, mark = local, None
    if n_edges <= per_task:  # one task saw them all
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        new = written(star(star(now, True), False), "links")
        state = tuple(new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        forget(now)
        now = new
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def _met(left: DataFrame, right: DataFrame, key: str, spread: int = 16) -> DataFrame:
    """left joined with right (one narrow row per key): right's rows are repeated for each of `spread` salts, so that a key's rows of left are spread over as many tasks."""
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int")
    return left.withColumn("salt", salt).join(salted, [key, "salt"]).drop("salt")


def hot(nodes: DataFrame, share: int = 1000) -> Column:
    """Whether a node holds more than 1/share of all rows (`n` of nodes (node, n, ...)). Fewer than `share` nodes do, so these may be broadcast."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return F.col("n") * share > total


def joined_by_node(rows: DataFrame, named: DataFrame, is_hot: Column) -> DataFrame:
    """rows joined with named (one row per node, with its number of rows `n`): hot nodes by broadcast, where the rows lie, the others by a shuffle."""
    many = F.broadcast(named.where(is_hot).drop("n"))
    others = rows.join(many.select("node"), "node", "left_anti").join(named.where(~is_hot).drop("n"), "node")
    return rows.join(many, "node").unionByName(others)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, lanes: int = 1, max_bits: int = 3, max_list: int = 4096) -> DataFrame:
    """docs without the text, and `fingerprint` (hex digits of lane 0) and `component_id`.

    component_id is the smallest id that can be reached over links, a document's own included. A
    null or empty text has the fingerprint zero and links like any other; null ids take part but are
    never a component's id (it is null if all its ids are); very long texts are hashed whole; repeated rows share
    node and component; an empty table gives none; columns named like the outputs are replaced, others pass through.
    """
    placed = Placed(docs)
    found, _ = _grouped(placed, id_col, text, width, lanes, max_bits, max_list)
    outputs = ["fingerprint", "component_id"]
    others = [c for i, c in enumerate(placed.others([])) if f"c{i}" != placed.place(text) and placed.names[i].lower() not in outputs]
    return found.select(*others, *outputs)


def _grouped(placed: Placed, id_col: str, text: str, width: int, lanes: int, max_bits: int, max_list: int) -> tuple[DataFrame, DataFrame]:
    """The placed columns but the text, `fingerprint`, `component_id` and `root`, the component's smallest node; and the links (a, b) between nodes."""
    own = placed.df.withColumn("marked_text", placed(text).cast("string")).drop(placed.place(text))
    marked = written(fingerprints(own, "marked_text", width, lanes, "lanes"), "simhash-lanes")
    marked = marked.withColumn("node", F.col("lanes")[0] if lanes == 1 else F.xxhash64("lanes"))
    nodes = marked.groupBy("node").agg(F.first("lanes").alias("lanes"), F.min(placed.place(id_col)).alias("least"), F.count("*").alias("n"))
    nodes = written(nodes, "simhash-nodes")
    edges = links(nodes.select("node", "lanes"), lanes, max_bits, max_list)
    roots = components(edges)
    # Most nodes are alone; those that are not meet their component's smallest id.
    grown = nodes.select("node", "least").join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "node")
    smallest = grown.groupBy("root").agg(F.min("least").alias("component_id"))
    grown = _met(grown.select("node", "root"), smallest, "root").select("node", "root", "component_id")
    named = nodes.select("node", "least", "n").join(grown, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    hex_digits = F.lpad(F.lower(F.hex(F.col("lanes")[0])), 16, "0")
    met = joined_by_node(marked, written(named, "simhash-named"), hot(nodes))
    return met.withColumn("fingerprint", hex_digits), edges


def pick_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of docs, one row of each group of found (id, h, root): the smallest (id, text hash), null ids last; of equal rows, one.

    The choice is made on narrow rows. Texts are shuffled once, for the join with it.
    """
    placed = Placed(docs)
    found = found.groupBy("root", "id", "h").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h", "n")).alias("p")
    pick = written(found.groupBy("root").agg(first).select("p.id", "p.h", "p.n"), "simhash-kept")
    d = placed.df.withColumn("key", F.xxhash64(placed(text).cast("string")))
    same = placed(id_col).eqNullSafe(F.col("id")) & (F.col("key") == F.col("h"))
    single = d.join(pick.where("n = 1").hint("shuffle_hash"), same, "left_semi")
    repeated = d.join(pick.where("n > 1").hint("shuffle_hash"), same, "left_semi").dropDuplicates([placed.place(id_col), "key"])
    return (single if pick.where("n > 1").limit(1).count() == 0 else single.unionByName(repeated)).select(*placed.others([]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, lanes: int = 1, max_bits: int = 3, max_list: int = 4096, similarity: float | None = None) -> DataFrame:
    """One document of each near-duplicate group, as `pick_one` chooses it.

    similarity: texts link at this Jaccard similarity of their sets of shingles, verified, and not by bits (see `minhash`).
    """
    if similarity is not None:
        from grainmill.llm.minhash import groups  # built on this module

        return pick_one(docs, groups(docs, id_col, text, width, similarity, max_bits=max_bits, max_list=max_list), id_col, text)
    placed = Placed(docs)
    narrow = Placed(placed.df.select(placed(id_col).alias("id"), F.xxhash64(placed(text).cast("string")).alias("h"), placed(text).alias("t")))
    found, _ = _grouped(narrow, "id", "t", width, lanes, max_bits, max_list)
    return pick_one(docs, found.select(F.col("c0").alias("id"), F.col("c1").alias("h"), "root"), id_col, text)
