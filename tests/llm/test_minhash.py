"""Groups of similar texts against all pairs by brute force."""

import random

import pytest

import corpus_pipeline
from grainmill.llm import minhash


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)} or ({b" ".join(w)} if w else set())


def brute(texts: dict, similarity: float = 0.8) -> dict:
    """{id: smallest id of its group} by definition."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            either = len(sets[i] | sets[j])
            if not either or len(sets[i] & sets[j]) / either >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(n: int = 260, seed: int = 3) -> dict:
    """Texts and copies of which up to 14 words are changed: similarities on both sides of the limit."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(900)]
    first, out = [rng.choices(vocab, k=rng.choice([3, 60, 200, 300])) for _ in range(30)], {}
    for i in range(n):
        words = list(rng.choice(first))
        for _ in range(rng.randrange(15)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out[i * 3] = " ".join(words)
    return out | {1: "", 2: None, 4: " "}


@pytest.mark.parametrize(("block", "block_words"), [(7, 1 << 22), (1024, 900), (1024, 1 << 22)])
def test_groups_equal_brute_force(spark, block, block_words):
    texts = corpus()
    want = brute(texts)
    assert len(texts) / 4 < len(set(want.values())) < len(texts) * 0.9
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    rows = minhash.groups(docs, block=block, block_words=block_words).collect()
    roots: dict = {}
    for r in rows:
        roots[r.root] = min(r.id, roots.get(r.root, r.id))
    assert {r.id: roots[r.root] for r in rows} == want


def test_stage_keeps_one_of_each_similar_group(spark):
    texts = corpus(seed=4)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in kept} == {i: texts[i] for i in set(brute(texts).values())}


def test_a_forest_connects_what_the_pairs_connect():
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] * 3
    few = minhash.forest(pairs, 60)
    assert set(few) <= set(pairs) and len(few) < 60

    def parts(links):
        group = {i: {i} for i in range(60)}
        for a, b in links:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
        return {frozenset(g) for g in group.values()}

    assert parts(few) == parts(pairs) and len(few) == 60 - len(parts(pairs))
