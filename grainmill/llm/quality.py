"""Line-first quality rules; DataFrame functions only, one pass over whole texts without a shuffle.

Every line is judged by itself: it must end like a sentence, must not look like navigation, must not
be boilerplate, must not be littered with symbols, and must not repeat an earlier line. What fails is removed. Then
the document is judged: it is rejected if it is too short, repeats itself too much, or lost too much
of its text with those lines.

Counting repeated 3-word windows is exact up to 64-bit hash collisions within one text: windows are
hashed, sorted with their positions within the row, and neighbours compared; only texts that do
repeat a window pay for the sort.

Defined results: a null or empty text has no words and is rejected; `cleaned` is null for a null text; very
long texts are judged whole; repeated rows get equal results; an empty table gives none; extra
columns pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm._common import Placed
from grainmill.llm._text import settled, space_words, upto

SYMBOL = r"[#*$%&|<>]"
HAS_WORD = r"[^ \t\n\x0B\f\r]"
#: A line ends like a sentence if one of these is last, closing quotes, brackets and white space aside.
SENTENCE_ENDS = list(".!?…:;。！？")
CLOSERS = "\"'”’»)] \t\n\x0b\f\r"
#: Bars, arrows or bullets between words.
BARS = "|»›•·"
BARRED = r"\s[|»›•·]\s.*\s[|»›•·](\s|$)"
#: Words of menus, in lower case, by language; a line of such words alone is navigation.
MENU_WORDS = {
    "en": ["home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back", "contact", "about", "about us", "sitemap", "faq", "help"],
    "de": ["startseite", "menü", "suche", "anmelden", "registrieren", "weiter", "zurück", "kontakt", "über uns", "impressum", "hilfe"],
    "es": ["inicio", "menú", "buscar", "iniciar sesión", "registrarse", "siguiente", "anterior", "contacto", "sobre nosotros", "ayuda"],
    "fr": ["accueil", "recherche", "connexion", "s'inscrire", "suivant", "précédent", "contact", "à propos", "plan du site", "aide"],
}
#: Phrases, in lower case, by language, that mark a line as boilerplate.
BOILERPLATE = {
    "en": ["lorem ipsum", "enable javascript", "javascript is disabled", "javascript is required", "we use cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here to", "subscribe to our", "share this", "powered by "],
    "de": ["bitte aktivieren sie javascript", "wir verwenden cookies", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "klicken sie hier"],
    "es": ["utilizamos cookies", "política de privacidad", "condiciones de uso", "todos los derechos reservados", "haga clic aquí"],
    "fr": ["nous utilisons des cookies", "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "cliquez ici"],
}
REPEAT_SIZE = 3


def _any(c: Column, parts) -> Column:
    return reduce(or_, (F.contains(c, F.lit(x)) for x in parts), F.lit(False))


def menu_pattern(menu_words: Mapping[str, Sequence[str]]) -> str:
    """Matches a line, in lower case, of menu words alone."""
    words = "|".join(re.escape(w) for w in sorted({w for ws in menu_words.values() for w in ws}, key=lambda w: (-len(w), w)))
    return f"^[^\\p{{L}}\\p{{N}}]*({words})([^\\p{{L}}\\p{{N}}]+({words}))*[^\\p{{L}}\\p{{N}}]*$"


def line_passes(line: Column, max_symbol_share: float, menu_words: Mapping[str, Sequence[str]], boilerplate: Mapping[str, Sequence[str]]) -> Column:
    """Whether a line with words stays. `boiler`, `bars` and `n_symbols` tell which rules its text can break at all."""
    ends = F.right(F.rtrim(line, F.lit(CLOSERS)), F.lit(1)).isin(SENTENCE_ENDS)
    boiler = F.col("boiler") & _any(F.lower(line), _phrases(boilerplate))
    barred = F.col("bars") & line.rlike(BARRED)
    littered = (F.col("n_symbols") > 0) & (F.regexp_count(line, F.lit(SYMBOL)) > max_symbol_share * F.size(space_words(line)))
    return ends & ~boiler & ~barred & ~littered & ~F.lower(line).rlike(menu_pattern(menu_words))


def _phrases(boilerplate: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({x for xs in boilerplate.values() for x in xs})


def _repeat_words(order: str) -> Column:
    """Words inside windows that occur more than once; order: (hash, position) sorted, or null if no hash recurs."""
    x = F.col(order)
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    at = F.transform(x, lambda e, i: F.when(same(e, F.get(x, i - 1)) | same(e, F.get(x, i + 1)), e["p"]))
    at = F.sort_array(F.filter(at, lambda p: p.isNotNull()))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-REPEAT_SIZE).alias("last"))
    add = lambda acc, p: F.struct((acc["n"] + F.least(p - acc["last"], F.lit(REPEAT_SIZE))).alias("n"), p.alias("last"))
    return F.coalesce(F.aggregate(at, start, add)["n"], F.lit(0).cast("bigint"))


def judge(
    docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_symbol_share: float = 0.1, min_kept_share: float = 0.5,
    menu_words: Mapping[str, Sequence[str]] = MENU_WORDS, boilerplate: Mapping[str, Sequence[str]] = BOILERPLATE,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned, kept_words and kept.

    menu_words and boilerplate: lists by language, in lower case; every line is held against all of them.
    """
    outputs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "kept_words", "kept"]
    placed = Placed(docs)
    cols = [f"c{i}" for i in range(len(placed.names))]
    d = placed.df.select(*cols, placed(text).isNull().alias("absent"), F.coalesce(placed(text).cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(HAS_WORD))
    d = d.withColumn("ws", settled(space_words(F.col("t")))).withColumn("lines", lines)
    d = d.select(
        "*",
        F.size("ws").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        _any(F.col("t"), BARS).alias("bars"),
        _any(F.lower("t"), _phrases(boilerplate)).alias("boiler"),
        settled(F.array_distinct("lines")).alias("new"),
        F.transform(upto(F.size("ws") - (REPEAT_SIZE - 1)), lambda i: F.xxhash64(*(F.get(F.col("ws"), i + k) for k in range(REPEAT_SIZE)))).alias("hs"),
    ).drop("ws", "t")
    entries = F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    d = d.withColumn("sorted", settled(F.when(F.size(F.array_distinct("hs")) < F.size("hs"), F.sort_array(entries))))
    cleaned = F.array_join(F.filter("new", lambda x: line_passes(x, max_symbol_share, menu_words, boilerplate)), "\n")
    d = d.select(
        *cols, "absent", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size("new")).cast("bigint").alias("n_dup_lines"),
        _repeat_words("sorted").alias("n_repeat_words"),
        settled(cleaned).alias("left"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    d = d.withColumn("kept_words", settled(F.size(space_words(F.col("left"))).cast("bigint")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= min_kept_share * F.col("n_words"))).withColumn("cleaned", F.when(~F.col("absent"), F.col("left")))
    return d.select(*placed.others(outputs), *outputs)
