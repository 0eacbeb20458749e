"""Each stage of the pipeline against plain Python on the smallest tables, and the whole run."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as p
from grainmill.llm import bpe, substring, toxicity
from grainmill.llm.queries import learnable
from tests.llm import test_decontaminate as plain_bench
from tests.llm.test_minhash import brute as plain_groups
from tests.llm.test_substring import brute as plain_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for name, (_, after) in stages.items():
        if name != "byte_bpe":
            assert after.columns == p.COLUMNS


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"), learn_from=learnable())
    t = texts(before)
    scores = model.score([toxicity.words(x) for x in t.values()])
    assert set(texts(after)) == {i for i, s in zip(t, scores, strict=True) if s < 0.5}


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    t = texts(before)
    kept = set(plain_groups(t).values())
    assert texts(after) == {i: t[i] for i in kept} and len(kept) < len(t)


def test_substrings(stages):
    before, after = stages["substring_dedup"]
    t, got = texts(before), texts(after)
    want = plain_repeats(list(t.items()))
    for (i, old), (runs, _) in want.items():
        raw, last, parts = old.encode(), 0, []
        for a, b in runs:
            parts.append(raw[last:a])
            last = b
        kept = substring.JOINT.join(x for x in (y.strip(b" \t\n\r\x0b\x0c") for y in [*parts, raw[last:]]) if x).decode()
        assert got.get(i, "") == (kept if runs else old)


def test_decontamination(spark, stages, monkeypatch):
    before, after = stages["decontamination"]
    monkeypatch.setattr(plain_bench, "ITEMS", [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    t, got = texts(before), texts(after)
    found = {i: plain_bench.brute(x) for i, x in t.items()}
    assert set(got) == {i for i, (n, hit, _) in found.items() if hit <= 0.5 * n}
    for i, x in got.items():
        if not found[i][1]:
            assert x == t[i]
        else:
            assert len(plain_bench.words(x)) == found[i][0] - found[i][1]
    assert any(f[1] for f in found.values())


def test_tokens(stages):
    before, after = stages["byte_bpe"]
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    t = texts(before)
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(t)
    for r in rows:
        ids = library.encode_ordinary(t[r.doc_id])
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert r.round_trip and r.n_tokens == len(ids) and bytes(r.ids) == packed and r.ids_sha256 == hashlib.sha256(packed).hexdigest()


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", None, "s", 5), (2, "a b c", None, "s", 5), (3, "word " * 60_000, "en", None, None)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for table in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            got = stage(spark, table, SF)
            n = got.count()
            assert n == 0 if table is not docs else 0 < n <= 5, name
