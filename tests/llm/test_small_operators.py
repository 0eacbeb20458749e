"""URL templates, licence digests and chat formatting."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from grainmill.llm import chat, license_scan, url_filter
from grainmill.llm.queries import RULES


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://WWW.Example.ORG/es/1?q#f", ("www.example.org", "/es/1", "example.org/es/", "block")),
        ("http://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
        ("http://example.org/en/2", ("example.org", "/en/2", "org/", "allow")),
        ("http://a.example.com/fr/", ("a.example.com", "/fr/", "com/fr/", "allow")),
        ("http://a.example.com/de/x", ("a.example.com", "/de/x", "com/de/", "block")),
        ("http://notexample.org", ("notexample.org", "", None, "allow")),
        ("x://y://z/p", ("y:", "//z/p", None, "allow")),
        ("no scheme", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
        ("http://É.com?x/de/", ("É.com", "", None, "allow")),
        ("\nhttp://a.net/b\nc#d", ("a.net", "/b\nc", None, "allow")),
    ],
)
def test_hosts_paths_and_rules(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string").select(url_filter.host_of(F.col("u")).alias("h"), url_filter.path_of(F.col("u")).alias("p"))
    r = df.select("h", "p", url_filter.rule_of(F.col("h"), F.col("p"), RULES, 0), url_filter.rule_of(F.col("h"), F.col("p"), RULES, 1)).first()
    assert (r[0], r[1], r[2], r[3] or "allow") == want


def test_templates(spark):
    rows = [(i, f"http://h.net/spam/{i}/buy.html") for i in range(60)] + [(100 + i, f"http://h.net/news/{i}.html") for i in range(60)] + [(200 + i, f"http://h.net/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(60)] + [(300, None), (300, None)]
    labels = [(i, 1) for i in range(40)] + [(100 + i, int(i % 20 == 0)) for i in range(40)]
    urls = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("old")).repartition(3)
    known = spark.createDataFrame(labels, "page_id bigint, bad int")
    got = {r.page_id: r for r in url_filter.judge(urls, known).collect()}
    assert {got[i].template for i in range(60)} == {"/spam/{n}/buy.html"} and {got[i].verdict for i in range(60)} == {"block"}
    assert {got[100 + i].verdict for i in range(60)} == {"allow"}
    assert {got[200 + i].template for i in range(60)} == {"/user/*/x"}
    assert got[300].host == "" and got[300].template == "/"
    assert url_filter.judge(urls).where("verdict = 'block'").count() == 0
    assert url_filter.judge(urls.limit(0), known).count() == 0


def test_deep_paths(spark):
    """Branches that differ in their tenth segment only are told apart."""
    deep = "/".join("abcdefghi")
    rows = [(k, f"http://h.net/{deep}/{'bad' if k % 2 else 'good'}/x/y{k % 3}") for k in range(120)]
    known = spark.createDataFrame([(k, k % 2) for k in range(120)], "page_id bigint, bad int")
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), known).collect()}
    assert {got[k].verdict for k in range(0, 120, 2)} == {"allow"} and {got[k].verdict for k in range(1, 120, 2)} == {"block"}
    assert got[1].template == f"/{deep}/bad/x/*" and got[0].template == f"/{deep}/good/x/*"


def plain_tree(urls, labels, max_children=20, z=1.96, strength=5.0):
    """{page: (template, purity)} by a tree in plain Python."""
    wild = re.compile(r"^(\{[nhd]\}|\*+)(\.|$)")
    host, shape = {}, {}
    for i, u in urls:
        m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", u or "")
        host[i] = m[1].lower() if m else ""
        seg = [s for s in (m[2] if m else "").split("/") if s]
        shape[i] = tuple(re.sub(url_filter.HEX, "{h}", re.sub(url_filter.NUMBER, "{n}", re.sub(url_filter.DATE, "{d}", s))) for s in seg)
    template = {(host[i], shape[i]): shape[i] for i, _ in urls}
    n_lab, n_bad = Counter(), Counter()
    for i, _ in urls:
        if i in labels:
            n_lab[host[i], shape[i]] += 1
            n_bad[host[i], shape[i]] += labels[i]
    for level in range(max((len(s) for s in shape.values()), default=0)):
        children = defaultdict(set)
        for (h, _), t in template.items():
            if len(t) > level and not wild.match(t[level]):
                children[h, t[:level]].add(t[level])
        for k, t in template.items():
            if len(t) > level and not wild.match(t[level]) and len(children[k[0], t[:level]]) > max_children:
                template[k] = (*t[:level], "*", *t[level + 1 :])
        sums = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for k, t in template.items():
            if len(t) > level:
                s = sums[k[0], t[:level]][t[level]]
                s[0] += n_lab[k]
                s[1] += n_bad[k]
        merge = {}
        for node, own in sums.items():
            pl, pb = (sum(s[x] for s in own.values()) for x in (0, 1))
            p = (pb + 0.5) / (pl + 1)
            alike = {c for c, (l, b) in own.items() if not l or abs(b / l - p) <= z * math.sqrt(p * (1 - p) / l)}
            merge[node] = alike if len(alike) > 1 else set()
        for k, t in template.items():
            if len(t) > level and t[level] in merge[k[0], t[:level]]:
                template[k] = (*t[:level], "*", *t[level + 1 :])
    total = (sum(n_bad.values()) + 1) / (sum(n_lab.values()) + 2)
    by_host, by_template = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, t in template.items():
        for s in (by_host[k[0]], by_template[k[0], t]):
            s[0] += n_lab[k]
            s[1] += n_bad[k]
    smooth = lambda s, prior: (s[1] + strength * prior) / (s[0] + strength)
    return {i: ("/" + "/".join(t := template[host[i], shape[i]]), smooth(by_template[host[i], t], smooth(by_host[host[i]], total))) for i, _ in urls}


@pytest.mark.parametrize("made", [True, False])
def test_templates_against_a_plain_tree(spark, made):
    if made:
        rng = random.Random(5)
        urls = [(i, f"http://h{rng.randrange(3)}.net/" + "/".join(rng.choice(["a", "b", "c", "news", f"v{rng.randrange(40)}", "2024-01", "77"]) for _ in range(rng.randrange(5)))) for i in range(900)] + [(900, None), (901, "none")]
        labels = {i: int(("/a" in u) if rng.random() < 0.8 else rng.random() < 0.5) for i, u in urls[:500]}
    else:
        urls = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
        labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
        labels = {i: labels[i] for i, _ in urls if i in labels}
    known = spark.createDataFrame(list(labels.items()), "page_id bigint, bad int")
    got = {r.page_id: (r.template, r.purity) for r in url_filter.judge(spark.createDataFrame(urls, "page_id bigint, url string"), known).collect()}
    want = plain_tree(urls, labels)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in got) and any("*" in t for t, _ in got.values())


def test_licences(spark):
    mit = license_scan.KNOWN_TEXTS["MIT"]
    texts = ["MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit, mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-licence"), mit + " And more.", "Some text.\nLicensed under CC BY-NC 4.0.\nMore of it.", "This work is licenced under the GNU General Public License, version 3.\nReleased under the MIT licence.", "", None, "©"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.id: (r.license_id, r.notices) for r in license_scan.scan(docs).collect()}
    want = {i: (None, []) for i in range(9)} | {0: ("MIT", []), 1: ("MIT", []), 2: ("MIT", []), 4: (None, ["CC-BY-NC-4.0"]), 5: (None, ["GPL-3.0", "MIT"])}
    assert got == want
    assert {r.id: r.license_id for r in license_scan.scan(docs, max_broadcast=0).collect()} == {i: v[0] for i, v in want.items()}
    twice = license_scan.scan(docs.unionByName(docs)).collect()
    assert len(twice) == 9 and {r.n_rows for r in twice} == {2}
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_a_foreign_notice_is_found(spark):
    known = license_scan.known_table(spark, texts={}, notices={"PD": ["Public domain dedication by Foo"]})
    docs = spark.createDataFrame([(1, "Intro.\npublic domain: dedication by FOO!\nMore."), (2, "Public domain dedication by Bar")], "doc_id bigint, text string")
    for how in ({}, {"max_lengths": 0}):
        assert {r.id: r.notices for r in license_scan.scan(docs, known, **how).collect()} == {1: ["PD"], 2: []}


def test_texts_from_files(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Own Licence\n\nCopyright (c) 1999 Me\n\nDo as you like; say so.\n" + "Clause. " * 5000)
    known = license_scan.texts_in(spark, str(tmp_path))
    long = "OWN LICENSE\n# Copyright 2020 You\nDo as you like - say so." + " clause" * 5000
    docs = spark.createDataFrame([(1, long), (1, long), (2, long + " x"), (None, None)], "doc_id bigint, text string")
    assert {(r.id, r.license_id, r.n_rows) for r in license_scan.scan(docs, known).collect()} == {(1, "Own-1.0", 2), (2, None, 1), (None, None, 1)}


def test_only_notices_are_dropped(spark):
    isc = license_scan.KNOWN_TEXTS["ISC"].replace("above copyright notice", "above\ncopyright notice")
    docs = spark.createDataFrame([(1, "Copyright 2004-2006 by Somebody\n(c) Somebody else\n" + isc)], "doc_id bigint, text string")
    assert license_scan.scan(docs).first().license_id == "ISC"


SCHEMAS = {"f": {"properties": {"x": {"type": "integer"}, "y": {"type": ["string", "null"]}, "z": {"enum": ["p", "q"]}}, "required": ["x"], "additionalProperties": False}}


def call(i, args, name="f"):
    return {"id": i, "name": name, "arguments": args}


def assistant(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_linking_and_order(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", assistant(call("b", '{"y": "s", "x": 3}'), call("a", {"x": "no"}))), (1, 2, "tool", result("a", "42")), (1, 3, "tool", result("b", {"k": 1})),
        (1, 4, "tool", result("lost", "?")), (1, 5, "assistant", "done"), (2, 0, "tool", result("late", "first")), (2, 1, "assistant", assistant(call("late", {"x": 1}), call("open", {"x": 2}))),
        (None, None, None, None), (3, 0, "user", "{not json"),
    ]
    got = chat.messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), SCHEMAS).orderBy("conv_id", "rank").collect()
    order = [(r.conv_id, r.turn) for r in got]
    assert order == [(None, None), (1, 0), (1, 1), (1, 3), (1, 2), (1, 4), (1, 5), (2, 1), (2, 0), (3, 0)]
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[k].link for k in ((1, 2), (1, 4), (1, 5), (2, 0))] == ["linked", "unmatched", None, "linked"]
    assert (by[1, 1].n_calls, by[1, 1].n_valid_calls, by[1, 1].n_open_calls) == (2, 1, 0) and by[2, 1].n_open_calls == 1
    assert by[1, 1].json == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"x":3,"y":"s"},"id":"b","name":"f"},{"arguments":{"x":"no"},"id":"a","name":"f"}]}'
    assert by[1, 3].json == '{"content":"{\\"k\\":1}","role":"tool","tool_call_id":"b"}'
    for r in got:
        assert json.dumps(json.loads(r.json), separators=(",", ":"), sort_keys=True, ensure_ascii=False) == r.json
    assert json.loads(by[1, 0].json)["content"] == 'say "hi"\n' and json.loads(by[3, 0].json)["content"] == "{not json"


@pytest.mark.parametrize(("args", "ok"), [({"x": 1}, 1), ({}, 0), ({"x": 1.5}, 0), ({"x": 1, "y": None}, 1), ({"x": 1, "y": 2}, 0), ({"x": 1, "z": "p"}, 1), ({"x": 1, "z": "r"}, 0), ({"x": 1, "w": 1}, 0), ([1], 0), ("nonsense", 0)])
def test_validation(spark, args, ok):
    df = spark.createDataFrame([(1, 0, "assistant", assistant(call("i", args)))], "conv_id bigint, turn bigint, role string, text string")
    assert chat.messages(df, SCHEMAS).first().n_valid_calls == ok


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "assistant", assistant(call("a", {"x": 1}))), (1, 1, "tool", result("a", "r"))] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert chat.messages(df).count() == 4
    assert chat.messages(df.limit(0)).count() == 0


@pytest.mark.parametrize(("value", "ok"), [(1, 1), ("1", 0), (True, 0), ("p", 1), ("P", 0)])
def test_enums_have_types(spark, value, ok):
    df = spark.createDataFrame([(1, 0, "assistant", assistant(call("i", {"x": value})))], "conv_id bigint, turn bigint, role string, text string")
    assert chat.messages(df, {"f": {"properties": {"x": {"enum": [1, "p"]}}}}).first().n_valid_calls == ok


@pytest.mark.parametrize("schema", [{"anyOf": []}, {"properties": {"x": {"minimum": 1}}}, {"properties": {"x": {"type": "array", "items": {}}}}, {"type": "array"}, {"additionalProperties": {}}])
def test_keywords_that_are_not_checked_are_refused(spark, schema):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    with pytest.raises(ValueError):
        chat.messages(df, {"f": schema})
