"""SimHash groups against all pairs, dense groups that need refinement, and edge cases."""

import random

import pytest
import xxhash

from grainmill.llm import simhash

SCHEMA = "doc_id bigint, text string, extra string"


def brute(texts: dict, width: int = 3, bits: int = 3):
    """{id: (fingerprint, smallest reachable id)} by definition."""
    fps = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return {i: (f"{fps[i]:016x}", r) for i, r in linked({i: fp for i, fp in fps.items()}, bits).items()}


def linked(fps: dict, bits: int) -> dict:
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(n: int = 120, seed: int = 5) -> dict:
    rng = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(300)]
    out: dict = {}
    for i in range(n):
        if out and rng.random() < 0.6:
            words = out[rng.choice(list(out))].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = rng.choices(vocab, k=rng.choice([1, 2, 3, 30, 200]))
        out[i * 3] = " ".join(words)
    return out


def test_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(texts)
    assert len({c for _, c in got.values()}) < len(texts)


@pytest.mark.parametrize("max_list", [24, 4096])
def test_long_lists_are_refined_without_loss(spark, max_list):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {k: base for k in range(1)}
    while len(fps) < 150:
        near = rng.choice(list(fps.values()))
        for _ in range(rng.choice([1, 2, 3, 9])):
            near ^= 1 << rng.randrange(64)
        if near not in fps.values():
            fps[len(fps)] = near
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in fps.items()}
    nodes = spark.createDataFrame([(k, [v]) for k, v in signed.items()], "node bigint, lanes array<bigint>")
    got = dict(simhash.components(simhash.links(nodes, max_list=max_list)).collect())
    assert {k: got.get(k, k) for k in fps} == linked(fps, 3)


def test_components_over_many_tasks(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(9)
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if x != r}
    for per_task in (10, 1000):
        got = {n: r for n, r in simhash.components(df, per_task=per_task).collect() if n != r}
        assert got == want


def test_wider_limits_find_their_pairs():
    for bits in range(8):
        rng = random.Random(bits)
        for _ in range(200):
            kept = set(range(8)) - set(rng.sample(range(8), bits))
            assert any(set(p) <= kept for p in simhash._positions(bits))
    with pytest.raises(ValueError):
        simhash._positions(8)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "one two three four five", "c"), (7, "one two three four five", None), (8, "x " * 50_000 + "end", "d")]
    got = {(r.doc_id, r.extra): r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 5 and got[(1, "a")].fingerprint == got[(2, "b")].fingerprint == "0" * 16
    assert got[(2, "b")].component_id == 1 and got[(None, "c")].component_id == got[(7, None)].component_id == 7
    empty = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "extra", "fingerprint", "component_id"] and empty.count() == 0
    clash = spark.createDataFrame([(1, "a b c", "old")], "doc_id bigint, text string, fingerprint string")
    assert simhash.near_duplicates(clash).first().fingerprint != "old"


def test_keep_one(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(5, long, "a"), (3, long, "b"), (4, long + " more", "c"), (9, "quite another text than the rest of them", "d"), (9, "quite another text than the rest of them", "d"), (None, long, "e"), (None, None, "f")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), width=5, lanes=8).collect()
    assert sorted((r.doc_id or -1, r.extra) for r in kept) == [(-1, "f"), (3, "b"), (9, "d")]
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_tells_components_apart_whatever_their_ids(spark):
    """Unrelated texts with null ids, and with one id, all stay; a copy among them goes."""
    own = [" ".join(f"{x}{k}" for k in range(60)) for x in "abcd"]
    rows = [(None, own[0], "a"), (None, own[1], "b"), (None, own[1], "b"), (6, own[2], "c"), (6, own[3], "d")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for kept in (simhash.keep_one(docs, width=5, lanes=8), simhash.keep_one(docs, width=5, similarity=0.8)):
        assert sorted(r.extra for r in kept.collect()) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_hot_nodes_meet_their_names_once(spark, share):
    rows = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(40)], "id int, node bigint")
    named = rows.groupBy("node").count().withColumnRenamed("count", "n").selectExpr("node", "n", "node * 10 as root")
    is_hot = simhash.hot(named, share)
    assert named.where(is_hot).count() == {1: 0, 3: 1, 1000: named.count()}[share]
    got = simhash.joined_by_node(rows, named, is_hot).collect()
    assert sorted((r.id, r.root) for r in got) == [(i, 70 if i % 2 else i * 10) for i in range(40)]
