"""Counts against their definitions, line rules, and edge cases."""

import random
import re
from collections import Counter

import pytest

from grainmill.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    t = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", t) if w]
    lines = [x for x in t.split("\n") if any(c not in SPACE for c in x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rng = random.Random(4)
    pool = ["a", "b", "c", "été", "#x", "<|>", "\n", "\n\n", "a b c", "\t", "\x0b", " ", "𝒳y"]
    texts = [None, "", " \n ", "a a a a", "one\ntwo\none\n\none", *(" ".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(150)), "x y z\n" * 4000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, kept int")
    got = quality.judge(docs).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t in enumerate(texts)}
    for r in got:
        n, _, _, _, rep = brute(texts[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.kept and r.base_failed)


PROSE = "\n".join(" ".join(f"word{k * 12 + i}" for i in range(12)) + "." for k in range(6))


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        (PROSE, True),
        (PROSE + "\nHome | About | Contact | Help", True),
        ("\n".join(f"First {k} | second {k} | third {k} | fourth {k} | fifth {k} | sixth {k}." for k in range(9)), False),
        ("\n".join(f"no end of line number {k} comes with a full stop or anything like it" for k in range(9)), False),
        ("\n".join(f"word{k}### and*** more%%% words$$$ than&&& one### can*** count%%% here$$$ so&&& far." for k in range(9)), False),
        ("\n".join(f"We use cookies to make page {k} better, see our privacy policy for more about it." for k in range(9)), False),
        ("Too short.", False),
        (PROSE.splitlines()[0] * 9, False),
        (None, False),
    ],
)
def test_verdicts(spark, text, kept):
    got = quality.judge(spark.createDataFrame([(text,)], "text string")).first()
    assert got.kept is kept
    assert (got.cleaned is None) == (text is None)


def test_failing_lines_are_removed(spark):
    text = "Home | About | Contact\n" + PROSE + "\nLorem ipsum dolor sit amet, as it goes.\nmenu"
    assert quality.judge(spark.createDataFrame([(text,)], "text string")).first().cleaned == PROSE


def test_filters_on_results(spark):
    df = quality.judge(spark.createDataFrame([(PROSE,), ("x",), (None,)], "text string"))
    assert df.where("kept").count() == 1 and df.where("not kept").count() == 2
    assert quality.judge(df.select("text").limit(0)).count() == 0


@pytest.mark.parametrize("tail", ["", "\t" * 14, "'" * 13, '"' * 40 + " " * 30, ")\u201d]" * 9 + " \t"])
def test_sentence_ends_have_tails_of_any_length(spark, tail):
    text = "\n".join(x + tail for x in PROSE.splitlines())
    got = quality.judge(spark.createDataFrame([(text,)], "text string")).first()
    assert got.kept and got.kept_words >= 72


def test_other_languages(spark):
    text = "Startseite | Kontakt | Über uns\n" + PROSE + "\nÀ propos. Accueil. Contact.\nEste sitio: utilizamos cookies para todo lo que se hace.\nÜber uns und andere reden wir hier."
    got = quality.judge(spark.createDataFrame([(text,)], "text string")).first()
    assert got.cleaned == PROSE + "\nÜber uns und andere reden wir hier."
    plain = quality.judge(spark.createDataFrame([(text,)], "text string"), menu_words={"x": ["zzz"]}, boilerplate={})
    assert "utilizamos" in plain.first().cleaned


def test_repeated_rows_and_clashing_outputs(spark):
    df = spark.createDataFrame([(1, PROSE, "a", "b")] * 2, "doc_id bigint, text string, Kept string, n_words string")
    got = quality.judge(df).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].kept is True and got[0].n_words == 72
