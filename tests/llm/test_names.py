"""Extra columns come back unchanged whatever their names: an operator's own names, its outputs' neighbours, dots and ticks."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from grainmill.llm import bpe, decontaminate, quality, simhash, substring, toxicity, url_filter

NAMES = [
    "absent", "t", "ws", "lines", "new", "hs", "sorted", "left", "bars", "boiler", "id", "key", "hit", "tokens", "ahead", "told", "cut", "own", "whole", "entries", "items", "spans", "p", "l", "h", "e",
    "node", "lanes", "fp", "keys", "root", "least", "salt", "marked_text", "z", "n", "r", "dup", "fid", "fh", "pos", "digest", "shape", "lid", "bad", "fs", "tl", "wh", "wp", "mh", "mb", "m",
    "c0", "c1", "c9", "out0", "out1", "_key", "_text", "_tokens", "_first", "_lines", "_order", "_shape", "_null", "_hash", "_id", "a.b", "a`b", "", "KEPT_1", "text ",
]
LONG = " ".join(f"word{k}" for k in range(60)) + "."
BENCH = "one two three four five six seven eight nine"


def clashing(spark, outputs):
    names = [n for n in NAMES if n.lower() not in outputs]
    rows = [(1, LONG, "http://h.net/a/1"), (2, LONG, "http://h.net/a/2"), (3, f"before {BENCH} after " + LONG, None), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string")
    return df.select("*", *(F.concat(F.col("doc_id").cast("string"), F.lit(f" {k}")).alias(n) for k, n in enumerate(names))), names


def outputs_of(name):
    return {
        "quality": ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "kept_words", "kept"],
        "near_duplicates": ["fingerprint", "component_id"],
        "substring": ["removed", "n_removed_words", "n_chunks"],
        "url": ["host", "path", "rule", "template", "purity", "verdict"],
        "bpe": ["ids", "n_tokens"],
        "toxicity": ["score", "predicted"],
    }.get(name, [])


@pytest.mark.parametrize("name", ["quality", "spans", "documents", "substring", "near_duplicates", "keep_one", "keep_similar", "url", "bpe", "toxicity"])
def test_extra_columns(spark, name):
    outputs = outputs_of(name)
    df, names = clashing(spark, outputs)
    bench = spark.createDataFrame([(1, BENCH)], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id bigint, toxic int")
    got = {
        "quality": lambda: quality.judge(df),
        "spans": lambda: decontaminate.decontaminate(df, bench),
        "documents": lambda: decontaminate.decontaminate(df, bench, mode="documents"),
        "substring": lambda: substring.dedup(df),
        "near_duplicates": lambda: simhash.near_duplicates(df),
        "keep_one": lambda: simhash.keep_one(df),
        "keep_similar": lambda: simhash.keep_one(df, width=5, similarity=0.8),
        "url": lambda: url_filter.judge(df, labels.withColumnRenamed("toxic", "bad"), id_col="doc_id"),
        "bpe": lambda: bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "toxicity": lambda: toxicity.classify(df, labels),
    }[name]()
    # Document 3 has 56 of its 67 shingles in common with the first two.
    kept = {"documents": {1, 2, 4}, "keep_one": {1, 3, 4}, "keep_similar": {1, 4}}.get(name, {1, 2, 3, 4})
    rows = [r.asDict() for r in got.collect()]
    assert {r["doc_id"] for r in rows} == kept
    for r in rows:
        for k, n in enumerate(names):
            assert r[n] == f"{r['doc_id']} {k}", n
    assert set(outputs) <= set(got.columns)
    if name == "spans":
        assert next(r["text"] for r in rows if r["doc_id"] == 3).startswith("before  after word0")
