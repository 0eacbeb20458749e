"""Chunk borders, first occurrences against brute force, and edge cases."""

import random

import numpy as np

from grainmill.llm import substring as s


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "été", "gamma", "of", "the"]) + str(rng.randrange(10_000)) for _ in range(n))


def test_gear_is_the_rolling_sum():
    data = np.frombuffer("Hello, wörld! again and again".encode(), np.uint8)
    want = [sum(int(s.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) & 0xFFFF for i in range(len(data))]
    assert s.gear(data).tolist() == want
    assert s.gear(data[:1]).tolist() == want[:1]


def test_chunks_resist_insertions():
    text = prose(random.Random(1), 3000)
    a, b = set(s.chunks(text.encode(), 5)), set(s.chunks(("inserted words " + text).encode(), 5))
    assert len(a - b) <= 2
    middle = len(text) // 2
    c = set(s.chunks((text[:middle] + " more " + text[middle:]).encode(), 5))
    assert len(a - c) <= 8


def brute(rows, mean_words=5, min_words=20):
    """{(id, text): text without later repeats}, over distinct (id, text) in their order."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=key):
        data = (t or "").encode()
        at, n = s.chunk_starts(np.frombuffer(data, np.uint8), mean_words)
        ends = [*at[1:].tolist(), len(data)]
        dup = []
        for c in s.chunks(data, mean_words):
            dup.append(c in seen)
            seen.add(c)
        total, runs, k = 0, [], 0
        while k < len(dup):
            j = k
            while j < len(dup) and dup[j]:
                j += 1
            if j > k and sum(n[k:j]) >= min_words:
                runs.append((int(at[k]), int(ends[j - 1])))
                total += int(sum(n[k:j]))
            k = max(j, k + 1)
        out[(i, t)] = (runs, total)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    passages = [prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(5, 80))]
        for p in rng.sample(passages, rng.randrange(3)):
            parts += [p, prose(rng, rng.randrange(5, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (101, None), (102, ""), (103, passages[0] + " " + passages[0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, dup string").repartition(7)
    got = s.dedup(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    old = {i: t for i, t in rows}
    for r in got:
        runs, total = want[(r.doc_id, old[r.doc_id])]
        assert ([(x.start, x.end) for x in r.removed], r.n_removed_words) == (runs, total)
        assert r.text == old[r.doc_id] if not runs else len(r.text or "") < len(old[r.doc_id])
    whole = [r for r in got if r.doc_id == 4]
    assert whole[0].n_removed_words > 0


def test_small_windows_change_nothing(spark):
    rng = random.Random(9)
    p = prose(rng, 80)
    rows = [(i, prose(rng, 10) + " " + p + " " + prose(rng, 10)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    few, many = (s.chunk_rows(docs, "doc_id", "text", 5, window=w).where("salt = 0").count() for w in (50, 1 << 20))
    assert few > many
    got = {r.doc_id: r.n_removed_words for r in s.dedup(docs).collect()}
    assert got[0] == 0 and all(got[i] >= 60 for i in range(1, 40))


def test_short_repeats_stay(spark):
    rng = random.Random(11)
    p = prose(rng, 8)
    docs = spark.createDataFrame([(i, prose(rng, 30) + " " + p + " " + prose(rng, 30)) for i in range(20)], "doc_id bigint, text string")
    assert s.dedup(docs).where("n_removed_words > 0").count() == 0
    assert s.dedup(docs.limit(0)).count() == 0
