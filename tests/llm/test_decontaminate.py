"""Benchmark hits against a plain search, both join paths, span removal and edge cases."""

import random
import re
import time

import pytest

from grainmill.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "short item"), (3, None), (4, "..."), (5, "quick brown fox jumps over the lazy dog"), (6, "ÉTÉ chaud à Paris, très long été encore une fois demain")]


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text):
    w, hit, items = words(text), set(), set()
    for i, t in ITEMS:
        iw = words(t)
        n = min(8, len(iw))
        wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                items.add(i)
    return len(w), len(hit), items


def texts():
    rng = random.Random(3)
    pool = [t for _, t in ITEMS if t] + ["filler words here", "été", "quick brown", "-- ! --"]
    made = [" ".join(rng.choices(pool, k=rng.randrange(6))) for _ in range(40)]
    return [None, "", "THE QUICK brown-fox jumps_over the lazy DOG", "été chaud à paris très long été encore", *made, "filler " * 3000 + ITEMS[0][1]]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id bigint, text string, spans string")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_equals_a_plain_search(tables, bound):
    got = {r.id: (r.n_words, r.hit, set(r["items"])) for r in d.scan(*tables, max_broadcast=bound).withColumn("hit", d.n_hit()).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts())}
    assert any(len(v[2]) > 1 for v in got.values())


def test_documents_without_hits_are_untouched(tables):
    kept = {r.doc_id: r.text for r in d.decontaminate(*tables, max_hit_share=1.0).collect()}
    for i, t in enumerate(texts()):
        assert brute(kept[i])[1] == 0 or len(words(t)) > len(words(kept[i]))
        if not brute(t)[1]:
            assert kept[i] == t
    assert set(words(kept[len(texts()) - 1])) == {"filler"}


def test_documents_go(tables):
    docs, bench = tables
    gone = {i for i, t in enumerate(texts()) if brute(t)[2]}
    assert {r.doc_id for r in d.decontaminate(docs, bench, mode="documents").collect()} == set(range(len(texts()))) - gone
    mostly = {i for i, t in enumerate(texts()) if brute(t)[1] > 0.5 * brute(t)[0]}
    assert {r.doc_id for r in d.decontaminate(docs, bench).collect()} == set(range(len(texts()))) - mostly
    with pytest.raises(ValueError):
        d.decontaminate(docs, bench, mode="other")


def test_edge_cases(spark, tables):
    docs, bench = tables
    same = spark.createDataFrame([(1, ITEMS[0][1]), (1, ITEMS[0][1]), (1, "clean"), (None, ITEMS[0][1])], "doc_id bigint, text string")
    got = sorted(((r.id or -1), r.n_rows, len(r["items"])) for r in d.scan(same, bench).collect())
    assert got == [(-1, 1, 2), (1, 1, 0), (1, 2, 2)]
    assert d.decontaminate(same, bench.limit(0)).count() == 4
    assert d.decontaminate(docs.limit(0), bench).count() == 0
    assert d.scan(docs, bench.limit(0)).where("size(items) > 0").count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_many_spans_in_one_text(spark, bound):
    """40,000 hit spans: work grows with their number, not with its square."""
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "item_id bigint, text string")
    text = " | ".join(f"Alpha, beta gamma x{k}" if k % 2 else f"Delta y{k}" for k in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "- delta -")], "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in d.decontaminate(docs, bench, max_hit_share=1.0, max_broadcast=bound).collect()}
    assert time.time() - began < 60
    assert words(got[1]) == [f"{'x' if k % 2 else 'y'}{k}" for k in range(40_000)] and got[2] == "-  -"
    r = {r.id: r for r in d.scan(docs, bench, max_broadcast=bound).select("id", d.n_hit().alias("n"), d.spans().alias("spans")).collect()}
    assert r[1].n == 80_000 and len(r[1].spans) == 40_000 and r[1].spans[1].asDict() == {"p": 2, "e": 5}


def test_a_crowded_bitmap_loses_nothing(tables, monkeypatch):
    monkeypatch.setattr(d, "MAX_BITS", 64)
    got = {r.id: (r.n_words, r.hit, set(r["items"])) for r in d.scan(*tables).withColumn("hit", d.n_hit()).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts())}
