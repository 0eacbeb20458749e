"""Held-out accuracy, the models' probabilities, and edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grainmill.llm import toxicity as t
from grainmill.llm.queries import learnable

SF = "/root/testdata/sf0.1"


def made(n=300, seed=0):
    rng = random.Random(seed)
    vocab = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(vocab, k=rng.randrange(30, 200))
        if toxic:
            for _ in range(1 + len(words) // 60):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "vermin"]))
        docs.append((i, " ".join(words), "src"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = made()
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def brute(toxic, ordinary, share, config):
    """log p_toxic - log p_ordinary of a word behind another (None: the start), in plain dictionaries."""
    vocab = {w for d in toxic + ordinary for w in d}
    base = {w: (1 - config.uniform) * share[w] + config.uniform / (len(vocab) + 1) for w in vocab}
    base[None] = (1 - config.uniform) * (1 - sum(share.values())) + config.uniform / (len(vocab) + 1)
    pairs = [Counter(p for d in docs for p in zip([None, *d], d)) for docs in (toxic, ordinary)]

    def discount(counts):
        ones, twos = (sum(n == k for n in counts) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones else 0.5

    left = [Counter(w for _, w in p) for p in pairs]
    kept1 = [{w: n - discount(c.values()) for w, n in c.items()} for c in left]
    free1 = max(1 - sum(k.values()) / sum(c.values()) for k, c in zip(kept1, left))
    p1 = [{w: (1 - free1) * k.get(w, 0) / sum(k.values()) + free1 * base[w] for w in base} for k in kept1]
    cuts = [discount(p.values()) for p in pairs]
    often = {p for p in pairs[0] | pairs[1] if pairs[0][p] + pairs[1][p] >= config.min_bigram}

    def p2(w, v):
        kept = [{x: p[v, x] - cut for y, x in often if y == v and p[v, x]} for p, cut in zip(pairs, cuts)]
        total = [sum(n for (y, _), n in p.items() if y == v) for p in pairs]
        free = max(1 - sum(k.values()) / max(t, 1) for k, t in zip(kept, total))
        return [((1 - free) * k.get(w, 0) / sum(k.values()) if free < 1 else 0) + free * p[w] for k, p in zip(kept, p1)]

    return p2, base


def test_models_against_plain_dictionaries():
    rng = random.Random(3)
    config = t.KneserNeyConfig(uniform=0.3, min_bigram=3)
    names = list("abcdefghij")
    docs = [[rng.choices(names, weights=range(1 + k, 11 + k))[0] for _ in range(rng.randrange(0, 40))] for k in (0, 9) for _ in range(12)]
    toxic, ordinary = docs[:12], docs[12:] + [["a", "z", "z"]]
    share = {w: 0.05 for d in toxic + ordinary for w in d}
    model = t.ToxicityModel.fit(toxic, ordinary, share, config)
    p2, base = brute(toxic, ordinary, share, config)
    assert len(model.pairs) > 20
    for v in (None, *names, "z"):
        both = [p2(w, v) for w in base]
        assert all(abs(sum(p[k] for p in both) - 1) < 1e-9 for k in (0, 1))
        ids = np.array([model.vocab.get(v, 0), 0])
        for w, (a, b) in zip(base, both, strict=True):
            ids[1] = model.vocab.get(w, 0)
            got = model.ratios(ids, np.array([0]))[1] if v else model.ratios(ids[1:], np.array([0]))[0]
            assert abs(got - math.log(a / b)) < 1e-9
    d = ["a", "q", "j", "j", "b", "i"]
    each = [math.log(a / b) for a, b in (p2(w if w in base else None, v if v in base else None) for v, w in zip([None, *d], d))]
    assert abs(model.evidence([d])[0] - max((x + y) / 2 for x, y in zip(each, each[1:]))) < 1e-9
    assert abs(model.evidence([d[:1], []])[0] - each[0]) < 1e-9


def test_unseen_words_cost_both_classes_the_same():
    model = t.ToxicityModel.fit([["a", "b", "a"]], [["b", "c"], ["b", "d"]], dict.fromkeys("abcd", 0.1))
    assert np.allclose(model.evidence([["unheard", "of"], []]), 0)


def test_held_out_documents(spark, tables):
    docs, labels = tables
    got = t.classify(docs, labels, learn_from=learnable()).join(labels, "doc_id").where(~learnable()).select("toxic", "predicted", "score").collect()
    right = sum(r.toxic == r.predicted for r in got)
    assert len(got) > 40 and right >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_held_out_corpus(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    got = t.classify(docs, labels, learn_from=learnable()).join(labels, "doc_id").where(~learnable())
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] >= 0.9 * (n[(1, 1)] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[(0, 0)], n


def test_scores_do_not_depend_on_batches_or_on_labels_held_out(spark, tables):
    docs, labels = tables
    model = t.fit(docs, labels, learn_from=learnable())
    a = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    b = {r.doc_id: r.score for r in t.score(docs.repartition(7), model).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)
    flipped = labels.withColumn("toxic", F.when(learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    c = {r.doc_id: r.score for r in t.score(docs, t.fit(docs, flipped, learn_from=learnable())).collect()}
    assert all(abs(a[k] - c[k]) < 1e-6 for k in a)


def test_edge_cases(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None, "x"), (-1, "", None), (-2, "scum " * 30_000, "x"), (-2, "scum " * 30_000, "x")], docs.schema)
    got = t.classify(docs.unionByName(odd), labels).where("doc_id is null or doc_id < 0").collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id == -2} == {1} and {r.predicted for r in got if r.doc_id != -2} == {0}
    assert t.classify(docs.limit(0), labels).count() == 0
    none = t.classify(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert none == 0.0
    assert t.classify(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0


def test_shares_of_the_corpus_are_counts(spark, tables):
    docs, _ = tables
    every = [w for r in docs.collect() for w in t.words(r.text)]
    names = sorted(set(every))[:50] + ["absent"]
    got = t.corpus_share(docs, names)
    assert all(abs(got[w] - every.count(w) / len(every)) < 1e-12 for w in names)


def test_a_long_text_does_not_end_the_sample(spark):
    """The first text in the sample's order is longer than all that a class may have; the others are still learnt from."""
    signed = lambda x: int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).view(np.int64))
    short = [f"text {k} " + "word " * 40 for k in range(100)]
    long = next(x for k in range(100_000) if signed(x := f"long {k} " + "much " * 10_000) < min(map(signed, short)))
    docs = spark.createDataFrame([(x,) for x in [*short, long]], "text string")
    known = docs.select(F.xxhash64("text").alias("h"), F.length("text").alias("n"), F.lit(1).alias("y"))
    got = t._sample(known, docs, "text", t.KneserNeyConfig(max_chars_per_class=40_000, max_chars_per_text=1000))[0]
    assert set(short) <= set(got) and sum(map(len, got)) <= 40_000 and len(got) == 101
