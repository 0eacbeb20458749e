"""Benchmark decontamination with a broadcast hash set of normalised test n-grams; DataFrame functions only.

Words are runs of characters other than ASCII punctuation, space and upper case, A-Z lowered first.
Each benchmark item gives its windows of `size` words (an item of fewer gives itself). Every
position of a training text is hashed for every window length that occurs, looked up in the set, and
a hit is verified word by word. A bitmap of the hashes of the windows' first three words, a constant of the plan,
first drops the positions that cannot hit, so that a row leaves its text only with the few that can.

The set is broadcast while it has at most `max_broadcast` different windows (of `size` words each; it is counted
first), and the texts are one pass without a shuffle; only hits and one row per document are aggregated. Beyond
that the positions left by the bitmap are joined with the set by shuffle, each with its own few words, for the
same verification. The bitmap has sixteen bits for each window, and MAX_BITS at most; where more windows
crowd it, more positions pass, and none is lost.

Documents are told apart by (id, text hash): rows that repeat an id and text get equal results, rows that share
an id and differ in text their own. Defined results: null and empty texts have no words and no hits;
null ids are kept; texts of any length are scanned whole; an item without words matches nothing; an
empty benchmark hits nothing; empty tables give no rows; extra columns pass through, columns named
like an output are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm._common import Placed
from grainmill.llm._text import lower_ascii, settled, upto

#: Words at the start of a window that the bitmap knows, and the bitmap's greatest size.
PREFIX = 3
MAX_BITS = 1 << 23
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(c: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(c.cast("string"), F.lit(""))), GAP), "")


def text_key(c: Column) -> Column:
    return F.xxhash64(c.cast("string"))


def _bitmap(firsts: DataFrame, bits: int) -> Column:
    """A constant array of longs in which the bit of each hash `f` is set; at most bits / 64 numbers reach the driver."""
    k = F.col("f").bitwiseAND(F.lit(bits - 1))
    set_bits = firsts.select(F.shiftright(k, 6).alias("i"), F.expr("shiftleft(1L, cast(f & 63 as int))").alias("b"))
    table = [0] * (bits // 64)
    for r in set_bits.groupBy("i").agg(F.bit_or("b").alias("b")).collect():
        table[r["i"]] = r["b"]
    return F.from_json(F.lit(json.dumps(table)), "array<bigint>")


def _window_hash(at: str, i: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(F.col(at), i + k) for k in range(length)))


def _windows(length: int, bitmap: Column, bits: int) -> Column:
    """Structs p (first word), l (length) and h (hash) of those windows of the words `ws` whose first words' bit is set."""
    starts = F.filter(upto(F.size("ws") - (length - 1)), lambda i: _bit(bitmap, _window_hash("ws", i, min(length, PREFIX)).bitwiseAND(F.lit(bits - 1))))
    return F.transform(starts, lambda i: F.struct(i.alias("p"), F.lit(length).alias("l"), _window_hash("ws", i, length).alias("h")))


def _bit(bitmap: Column, k: Column) -> Column:
    return F.bit_get(F.get(bitmap, F.shiftright(k, 6).cast("int")), k.bitwiseAND(F.lit(63)).cast("int")) == 1


def item_windows(bench: DataFrame, size: int = 8, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(l, h, f, words, items): the different windows of the benchmark, their hash and that of their first words, and the items that have them."""
    placed = Placed(bench)
    b = placed.df.select(placed(id_col).alias("item"), words(placed(text)).alias("ws"))
    b = b.withColumn("l", F.least(F.size("ws"), F.lit(size))).where("l > 0")
    b = b.select("item", "l", "ws", F.explode(upto(F.size("ws") - F.col("l") + 1)).alias("p"))
    b = b.select("item", "l", F.slice("ws", F.col("p") + 1, F.col("l")).alias("words"))
    hashes = [F.when(F.col("l") == n, F.struct(_window_hash("words", F.lit(0), n).alias("h"), _window_hash("words", F.lit(0), min(n, PREFIX)).alias("f"))) for n in range(1, size + 1)]
    b = b.withColumn("hf", F.coalesce(*hashes))
    return b.groupBy("l", "hf.h", "hf.f", "words").agg(F.collect_set("item").alias("items"))


def scan(docs: DataFrame, bench: DataFrame, size: int = 8, id_col: str = "doc_id", text: str = "text", max_broadcast: int = 500_000) -> DataFrame:
    """(id, key, n_rows, n_words, hit, items): per document the sorted positions of its hit words, and the items with hits."""
    wins = item_windows(bench, size)
    known = wins.groupBy("l").agg(F.count("*").alias("n")).collect()
    lengths, total = sorted(r["l"] for r in known), sum(r["n"] for r in known)
    bits = min(MAX_BITS, max(64, 1 << (16 * total).bit_length()))
    bitmap = _bitmap(wins, bits)
    placed = Placed(docs)
    d = placed.df.select(placed(id_col).alias("id"), text_key(placed(text)).alias("key"), settled(words(placed(text))).alias("ws"))
    d = d.withColumn("n_words", F.size("ws").cast("bigint"))
    none = F.struct(F.lit(-1).alias("p"), F.lit(0).alias("l"), F.lit(0).cast("bigint").alias("h"))
    # One entry with position -1 stands for the document itself, hits or not.
    d = d.withColumn("entries", settled(F.concat(F.array(none), *(_windows(n, bitmap, bits) for n in lengths))))
    x = d.select("id", "key", "n_words", "ws", F.explode_outer("entries").alias("e")).select("id", "key", "n_words", "ws", "e.*")
    w = wins.select(F.col("l").alias("wl"), F.col("h").alias("wh"), "words", "items")
    same = (F.col("h") == F.col("wh")) & (F.col("l") == F.col("wl"))
    if total <= max_broadcast:
        hits = x.join(F.broadcast(w), same, "left").where("p < 0 or (wh is not null and slice(ws, p + 1, l) = words)")
    else:
        x = x.withColumn("own", F.expr("if(p < 0, null, slice(ws, p + 1, l))")).drop("ws")
        alone = x.where("p < 0").withColumn("items", F.lit(None).cast(wins.schema["items"].dataType))
        hits = x.where("p >= 0").join(w, same & (F.col("own") == F.col("words"))).select(alone.columns).unionByName(alone)
    per = hits.groupBy("id", "key").agg(
        F.count_if(F.col("p") < 0).alias("n_rows"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("p") >= 0, F.struct("p", "l"))).alias("at"),
        F.collect_set("items").alias("items"),
    )
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a["p"], a["p"] + a["l"] - 1)))
    return per.select("id", "key", "n_rows", "n_words", F.sort_array(F.array_distinct(covered)).alias("hit"), F.array_distinct(F.flatten("items")).alias("items"))


def spans(hit: str = "hit") -> Column:
    """Maximal runs of hit words, as structs p (first word) and e (the word after the last)."""
    x = F.col(hit)
    first = F.filter(x, lambda p, i: ~F.coalesce(F.get(x, i - 1) == p - 1, F.lit(False)))
    last = F.filter(x, lambda p, i: ~F.coalesce(F.get(x, i + 1) == p + 1, F.lit(False)))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("p"), (b + 1).alias("e")))


def n_hit(hit: str = "hit") -> Column:
    return F.size(hit).cast("bigint")


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = 8, mode: str = "spans", min_items: int = 1, max_hit_share: float = 0.5, id_col: str = "doc_id", text: str = "text", max_broadcast: int = 500_000) -> DataFrame:
    """docs without what the benchmark holds.

    mode 'documents': rows with hits of at least min_items items go. mode 'spans': the hit words
    (with the characters between them) are cut out of such rows, and a row goes altogether if more
    than max_hit_share of its words are hit. Rows without hits are returned as they are.
    """
    if mode not in ("spans", "documents"):
        raise ValueError(f"mode is 'spans' or 'documents', not {mode!r}")
    placed = Placed(docs)
    found = scan(docs, bench, size, id_col, text, max_broadcast).where(F.size("items") >= min_items)
    found = found.select("id", "key", "n_words", "hit")
    d = placed.df.withColumn("own", text_key(placed(text)))
    same = placed(id_col).eqNullSafe(F.col("id")) & (F.col("own") == F.col("key"))
    if mode == "documents":
        return d.join(found.hint("shuffle_hash"), same, "left_anti").select(*placed.others([]))
    found = found.select("id", "key", "hit", (n_hit() > max_hit_share * F.col("n_words")).alias("whole"))
    met = d.join(found.hint("shuffle_hash"), same, "left").where(~F.coalesce("whole", F.lit(False)))
    # Words and gaps alternate: word w is token 2 w, and the gap behind it follows; if a gap comes first, all are one further.
    met = met.withColumn("tokens", settled(F.when(F.size("hit") > 0, F.regexp_extract_all(placed(text), F.lit(f"{_MIXED}|{GAP_MIXED}"), F.lit(0)))))
    met = met.withColumn("ahead", F.get(F.col("tokens"), F.lit(0)).rlike(f"^{GAP_MIXED}$").cast("int"))
    x = F.col("hit")
    gaps = F.filter(x, lambda p, i: F.coalesce(F.get(x, i + 1) == p + 1, F.lit(False)))
    # A mark sorts right before the token that it cuts.
    mark = lambda k: F.struct(k.cast("int").alias("k"), F.lit(0).alias("z"), F.lit("").alias("t"))
    marks = F.concat(F.transform(x, lambda p: mark(2 * p + F.col("ahead"))), F.transform(gaps, lambda p: mark(2 * p + 1 + F.col("ahead"))))
    told = F.sort_array(F.concat(marks, F.transform("tokens", lambda t, i: F.struct(i.cast("int").alias("k"), F.lit(1).alias("z"), t.alias("t")))))
    met = met.withColumn("told", settled(F.when(F.col("tokens").isNotNull(), told)))
    y = F.col("told")
    stays = F.filter(y, lambda e, i: (e["z"] == 1) & ~F.coalesce((F.get(y, i - 1)["z"] == 0) & (F.get(y, i - 1)["k"] == e["k"]), F.lit(False)))
    cut = F.array_join(F.transform(stays, lambda e: e["t"]), "")
    met = met.withColumn("cut", settled(F.when(y.isNull(), placed(text)).otherwise(cut)))
    at = placed.place(text)
    return met.select(*[F.col("cut" if f"c{i}" == at else f"c{i}").alias(c) for i, c in enumerate(placed.names)])


#: The same runs in a text whose A-Z are not lowered.
_MIXED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP_MIXED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
