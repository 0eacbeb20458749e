"""Near duplicates at a stated Jaccard similarity of word shingles: what `simhash` does where a similarity has to be reached.

Candidates come from the byte-position index of SimHash fingerprints first. It finds pairs within a few bits,
6 % of those at a similarity of 0.8 and 43 % at 0.9; so MinHash keys find the rest. Every candidate is
verified on whole sets of shingles, so nothing below the limit links.

Texts with the same set of shingles are one node. A node has BANDS keys, each made of ROWS minimum
hashes; two nodes of similarity s share one of them with probability 1 - (1 - s^ROWS)^BANDS. With
24 keys of four that misses three pairs in a million at a similarity of 0.8, and fewer above.

Skew and scale
* A group of equal texts is aggregated to one node before anything is indexed.
* What fingerprints link is one component before the keys are looked at: there a list of one component is done, and
  in others only pairs across components are left, which are those with a member outside the list's largest component.
* Lists of more than `block` nodes, or `block_words` shingles in all, are never gathered: their nodes are dealt by hash to blocks
  of about that size and compared with the list's hub first, which takes one comparison a node and joins most of a group
  of near copies; then what lies outside the largest component is compared with all, as pairs of blocks. Lists are
  never cut off. Short lists with the same members are compared once.
* Texts with over a thousandth of all rows, fewer than a thousand, are picked where they lie and not by a shuffle of all copies.
* The sets of shingles are made of texts that share a fingerprint link or a key with another, and of no others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.llm._common import Placed, forget, map_arrow, with_arrow, written
from grainmill.llm.simhash import components, fingerprint, hot, joined_by_node, links, shingle_hashes

BANDS, ROWS = 24, 4
_PART = 1 << 10
_SEEDS = np.array([[xxhash.xxh64_intdigest(bytes([k]), s) for k in range(BANDS * ROWS)] for s in (11, 12)], np.uint64)
_FACTOR, _PLUS = (_SEEDS[0] | np.uint64(1))[:, None], _SEEDS[1][:, None]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, width))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 5)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys; two sets share each of them with the probability s^ROWS at a Jaccard similarity of s."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), _PART):
            np.minimum(least, (shingles[i : i + _PART] * _FACTOR + _PLUS).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def similar_pairs(sets: list[np.ndarray], one: np.ndarray, other: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(i, j), i of one and j of other (positions in sets, each pair once): sets of at least this Jaccard similarity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(one) or not len(other):
        return []
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if common >= similarity * (sizes.sum() - common) else []
    # Each shingle's members of `other`, in one array.
    owner = np.repeat(other, sizes[other])
    tokens = np.concatenate([sets[j] for j in other])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    out, both = [], np.isin(np.arange(len(sets)), one) & np.isin(np.arange(len(sets)), other)
    for i in one.tolist():
        low, high = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((common > 0) & (common >= similarity * (sizes + sizes[i] - common)))
        out += [(i, j) for j in near.tolist() if j != i and not (both[i] and both[j] and j < i)]
    return out


def forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Of links among n things, at most n - 1 that connect the same ones."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _units(lists: DataFrame) -> DataFrame:
    """(unit, node, side): the work that lists (key, node, comp) leave, sides 1, 2 or both (3), to be compared 1 against 2.

    A partition is read in key order; one list is in memory at a time, so long ones go to `_hubs` and `_blocks`.
    """

    def close(node: np.ndarray, comp: np.ndarray):
        if len(node) < 2:
            return
        values, which, n = np.unique(comp, return_inverse=True, return_counts=True)
        if len(values) == 1:
            return
        order = np.argsort(node)
        node, which = node[order], which[order]
        side = 2 + (which != np.argmax(n)).astype(np.int32)
        name = xxhash.xxh64_intdigest(node.tobytes() + side.astype(np.int8).tobytes(), 9)
        yield np.full(len(node), name, np.uint64).view(np.int64), node, side

    def batch(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)], names=["unit", "node", "side"])

    def run(batches):
        last, kept, out, size = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key, node, comp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                if key[i] != last:
                    for w in close(*(np.concatenate(x) for x in zip(*kept, strict=True))) if kept else ():
                        out.append(w)
                        size += len(w[0])
                        if size >= 1 << 16:
                            yield batch(out)
                            out, size = [], 0
                    last, kept = key[i], []
                kept.append((node[i:j], comp[i:j]))
        for w in close(*(np.concatenate(x) for x in zip(*kept, strict=True))) if kept else ():
            out.append(w)
            if len(out) >= 64:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    dealt = lists.select("key", "node", "comp").repartition("key").sortWithinPartitions("key")
    return map_arrow(dealt, run, "unit bigint, node bigint, side int").distinct()


def _parts(n: str, words: str, block: int, block_words: int) -> Column:
    """Into how many blocks, a power of two, so many nodes with so many shingles are dealt by their hash."""
    need = F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(words) / block_words), F.lit(1))
    return F.pow(F.lit(2.0), F.ceil(F.log2(need.cast("double")))).cast("int")


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node"), parts).cast("int")


def _long_lists(nodes: DataFrame, block: int, block_words: int) -> DataFrame:
    """(key, hub, parts) of the lists of more than `block` nodes or `block_words` shingles; hub is their smallest node."""
    sizes = nodes.select("node", "size", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("node").alias("hub"))
    return sizes.where((F.col("n") > block) | (F.col("n") > 1) & (F.col("words") > block_words)).select("key", "hub", _parts("n", "words", block, block_words).alias("parts"))


def _hubs(lists: DataFrame, long: DataFrame) -> DataFrame:
    """(unit, node, side): each node of a long list against the list's hub, a block of nodes a unit.

    Units are named by hub and block, so that a hub's lists, BANDS at most, share them.
    """
    name = lambda part: F.xxhash64("hub", "parts", part).alias("unit")
    met = lists.join(long, "key").where("node != hub")
    members = met.select(name(_dealt(F.col("parts"))), "node", F.lit(2).alias("side"))
    hubs = long.select("hub", "parts").distinct().select("hub", "parts", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    return members.unionByName(hubs.select(name(F.col("part")), F.col("hub").alias("node"), F.lit(1).alias("side"))).distinct()


def _blocks(lists: DataFrame, long: DataFrame, block: int, block_words: int) -> DataFrame:
    """(unit, node, side): what is left of long lists: their nodes outside the largest component against all, as pairs of blocks."""
    sizes = lists.join(long.select("key"), "key").groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    whole = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("words").alias("words"), F.max(F.struct("n", "comp", "words")).alias("main")).where("comps > 1")
    outside = whole.select("key", F.col("main.comp").alias("main"), F.col("main.n").alias("mn"), F.col("main.words").alias("mw"), (F.col("n") - F.col("main.n")).alias("rn"), (F.col("words") - F.col("main.words")).alias("rw"))
    plan = outside.select("key", "main", _parts("rn", "rw", block, block_words).alias("rest_parts"), _parts("mn", "mw", block, block_words).alias("main_parts"))
    met = lists.join(plan, "key")
    rest = met.where("comp != main").withColumn("own", _dealt(F.col("rest_parts"))).withColumn("other", F.explode(F.expr("sequence(0, rest_parts + main_parts - 1)")))
    rest = rest.withColumn("side", F.expr("case when own = other then 3 when own < other then 1 else 2 end"))
    main = met.where("comp = main").withColumn("own", _dealt(F.col("main_parts")) + F.col("rest_parts")).withColumn("other", F.explode(F.expr("sequence(0, rest_parts - 1)"))).withColumn("side", F.lit(2))
    unit = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    return rest.select(unit, "node", "side").unionByName(main.select(unit, "node", "side"))


def _compare(work: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of each unit of work (unit, node, side, shingles), a spanning forest of the pairs that are similar enough."""

    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        side = np.array([r[1] for r in rows])
        pairs = similar_pairs(sets, np.flatnonzero(side & 1), np.flatnonzero(side & 2), similarity)
        return [(rows[i][0], rows[j][0]) for i, j in forest(pairs, len(rows))]

    def run(batches):
        last, rows = None, []

        def made(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            found = []
            for u, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if u != last:
                    found += close(rows) if rows else []
                    last, rows = u, []
                rows.append(row)
            if found:
                yield made(found)
        yield made(close(rows) if rows else [])

    dealt = work.select("unit", "node", "side", "shingles").repartition("unit").sortWithinPartitions("unit")
    return map_arrow(dealt, run, "a bigint, b bigint")


def _pairs(nodes: DataFrame, max_bits: int, max_list: int) -> DataFrame:
    """(unit, node, side): the pairs of nodes that fingerprints within max_bits link, as units of work."""
    same = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    found = links(same.select(F.col("least").alias("node"), F.array("fp").alias("lanes")), 1, max_bits, max_list).select("a", "b")
    equal = nodes.join(same, "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    both = found.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return both.select(F.xxhash64("a", "b").alias("unit"), F.expr("stack(2, a, 1, b, 2) as (node, side)"))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, block: int = 1024, block_words: int = 1 << 22, max_bits: int = 3, max_list: int = 4096) -> DataFrame:
    """(id, h, root): for each row its id, the hash of its text and the root node of its group.

    Groups are the connected components of all pairs with at least this Jaccard similarity of their
    sets of `width`-word shingles. Texts without words have the empty set, and are one group.
    """
    placed = Placed(docs)
    plain = placed.df.select(placed(id_col).alias("id"), placed(text).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))

    def mark(b: pa.RecordBatch) -> dict[str, pa.Array]:
        node, fp, size, keys = [], [], [], []
        for t in b.column(b.schema.get_field_index("t")):
            every = shingle_hashes(t.as_py(), width)
            s = np.unique(every)
            node.append(node_of(s))
            fp.append(fingerprint(every))
            size.append(len(s))
            keys.append(band_keys(s).view(np.int64))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        return {"node": signed(node), "fp": signed(fp), "size": pa.array(size, pa.int64()), "keys": lists}

    outputs = {"node": T.LongType(), "fp": T.LongType(), "size": T.LongType(), "keys": T.ArrayType(T.LongType())}
    marked = written(with_arrow(plain, mark, outputs, keep=["id", "h"]), "minhash-keys")
    # A set's fingerprint is that of one of its texts: any of them gives a candidate.
    nodes = written(marked.groupBy("node").agg(F.first("keys").alias("keys"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.min("h").alias("h"), F.count("*").alias("n")), "minhash-nodes")
    is_hot = hot(nodes)

    def unpack(b: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = [shingle_set(t.as_py(), width).tobytes() for t in b.column(b.schema.get_field_index("t"))]
        return {"shingles": pa.array(sets, pa.binary())}

    def verified(units: DataFrame) -> DataFrame:
        units = written(units, "minhash-units")
        need = nodes.join(units.select("node").distinct(), "node", "left_semi").select("node", "n", F.col("h").alias("nh"))
        same = F.col("h").eqNullSafe(F.col("nh"))
        many = F.broadcast(need.where(is_hot).drop("n"))
        others = plain.select("t", "h").join(many, same, "left_anti").join(need.where(~is_hot).drop("n").hint("shuffle_hash"), same)
        texts = plain.select("t", "h").join(many, same).unionByName(others).groupBy("node").agg(F.first("t").alias("t"))
        sets = with_arrow(texts, unpack, {"shingles": T.BinaryType()}, keep=["node"])
        found = written(_compare(units.join(sets, "node"), similarity), "minhash-links")
        forget(units)
        return found

    def placed_lists(found: DataFrame) -> DataFrame:
        comp = nodes.join(components(found), "node", "left").select("node", "size", "keys", F.coalesce("root", "node").alias("comp"))
        return comp.select("node", "size", "comp", F.explode("keys").alias("key"))

    found = verified(_pairs(nodes, max_bits, max_list))
    lists, long = placed_lists(found), written(_long_lists(nodes, block, block_words), "minhash-long")
    if long.limit(1).count():
        short = _units(lists.join(long.select("key"), "key", "left_anti"))
        found = found.unionByName(verified(short.unionByName(_hubs(lists, long))))
        found = found.unionByName(verified(_blocks(placed_lists(found), long, block, block_words)))
    else:
        found = found.unionByName(verified(_units(lists)))
    named = nodes.select("node", "n").join(components(found), "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    return joined_by_node(marked.select("id", "h", "node"), written(named, "minhash-named"), is_hot).select("id", "h", "root")
