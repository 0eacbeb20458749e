"""Toxicity scoring with two class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney bigram models are estimated, one on toxic and one on ordinary labelled
texts. Bigrams count occurrences; below them words count their different left neighbours (so copies do not
weigh), each order with the discount n1 / (n1 + 2 n2) of its own counts. Words back off to one
distribution that both classes share: their shares in all texts of the corpus, mixed with a uniform one
(`uniform`). Three things keep rare expressions from tipping the comparison: a backoff gets the same mass
in both classes, the larger of what their discounts free, so that what neither class has seen costs both the same; a
context that one class has not seen backs off altogether; bigrams that both classes together have seen fewer than
`min_bigram` times are left to the backoff.

A document's evidence is (log p_toxic - log p_ordinary) / n of the most toxic run of `window` words, n being
the run's words (a shorter text is one run). A logistic curve of this number alone, fitted on labelled
documents that the models have not seen, gives the score. The same comparison over whole texts cannot
tell a long text with a few toxic words from an ordinary one; README has the figures.

Bounds and scale
* The models are a classifier: they are fitted on a bounded sample of labelled rows (`max_docs_per_class`,
  `max_chars_per_class`, chosen by a hash of the text). Of a text longer than `max_chars_per_text` the
  sample has that many characters, so that none ends the sample. What is sent to the executors is
  bounded by these parameters.
* The corpus share of a word comes from all texts of the corpus: the words of the sample, which
  alone need one, are counted exactly with one partial table per task; no document list reaches the driver.
* Scoring is one pass without a shuffle over whole texts, vectorised over Arrow batches.

Defined results: a null or empty text has no words and gets the score of "no evidence"; texts
of any length are scored whole; repeated rows get equal scores; rows with a null or unknown
label are not learnt from; an empty corpus returns no rows; without labels of both classes
every document gets the share of toxic labels (0 if there is none); extra columns pass through
and a column named like an output is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.llm._common import map_arrow, with_arrow

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class KneserNeyConfig:
    """Documented bounds of the fit, and the models' parameters."""

    max_docs_per_class: int = 4000
    max_chars_per_class: int = 6_000_000
    max_chars_per_text: int = 150_000
    calibration_share: float = 0.25
    uniform: float = 0.9
    min_bigram: int = 20
    window: int = 2
    toxic_weight: float = 1 / 3


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def discount_of(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), from the numbers of counts that are 1 and 2; one half where nothing is seen once."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 else 0.5


class _ClassModel:
    """Counts of one class over the shared vocabulary; id 0 is any unknown word, and the start."""

    def __init__(self, docs: list[np.ndarray], size: int):
        some = [x for x in docs if len(x)]
        right = np.concatenate(some) if some else np.zeros(0, np.int64)
        left = np.concatenate([np.concatenate(([0], x[:-1])) for x in some]) if some else right
        self.pairs, n = np.unique(left * size + right, return_counts=True)
        self.n = n.astype(np.float64)
        self.context = np.bincount(left, minlength=size).astype(np.float64)
        self.neighbours = np.bincount(self.pairs % size, minlength=size).astype(np.float64)
        self.pair_kept = np.maximum(self.n - discount_of(self.n), 0)
        self.word_kept = np.maximum(self.neighbours - discount_of(self.neighbours), 0)

    def counts_of(self, pairs: np.ndarray, values: np.ndarray) -> np.ndarray:
        """values (one for each of self.pairs) of the given pairs, 0 for others."""
        if not len(self.pairs):
            return np.zeros(len(pairs))
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, values[at], 0)


def _mixed(kept: list[np.ndarray], totals: list, group: np.ndarray | None, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each class's kept counts as shares, scaled so that both leave the same mass to the backoff; that mass, per group."""
    group = np.zeros(len(kept[0]), np.int64) if group is None else group
    sums = [np.bincount(group, weights=k, minlength=size) for k in kept]
    freed = np.maximum.reduce([1 - s / np.maximum(t, 1) for s, t in zip(sums, totals, strict=True)])
    return [(1 - freed)[group] * k / np.maximum(s, 1e-300)[group] for k, s in zip(kept, sums, strict=True)], freed


class ToxicityModel:
    """Log-likelihood ratios for scoring: per word, and per bigram that both classes know; and the curve."""

    def __init__(self, vocab: dict[str, int], word_llr: np.ndarray, pairs: np.ndarray, pair_llr: np.ndarray, config: KneserNeyConfig):
        self.vocab, self.word_llr, self.pairs, self.pair_llr, self.config = vocab, word_llr, pairs, pair_llr, config
        self.bias, self.slope = 0.0, 1.0

    @classmethod
    def fit(cls, toxic: list[list[str]], ordinary: list[list[str]], share: dict[str, float], config: KneserNeyConfig = KneserNeyConfig()) -> ToxicityModel:
        """share: of the words of toxic and ordinary, in the whole corpus."""
        vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for d in (*toxic, *ordinary) for w in d))}
        size = len(vocab) + 1
        models = [_ClassModel([np.fromiter(map(vocab.__getitem__, d), np.int64, len(d)) for d in docs], size) for docs in (toxic, ordinary)]
        known = np.fromiter((share.get(w, 0.0) for w in vocab), np.float64, size - 1)
        base = (1 - config.uniform) * np.concatenate(([max(1 - known.sum(), 0)], known)) + config.uniform / size
        own, freed = _mixed([m.word_kept for m in models], [np.array([m.neighbours.sum()]) for m in models], None, 1)
        p_word = [k + freed[0] * base for k in own]
        word_llr = np.log(p_word[0]) - np.log(p_word[1])

        pairs = np.union1d(models[0].pairs, models[1].pairs)
        pairs = pairs[sum(m.counts_of(pairs, m.n) for m in models) >= config.min_bigram]
        ctx, right = pairs // size, pairs % size
        own, freed = _mixed([m.counts_of(pairs, m.pair_kept) for m in models], [m.context for m in models], ctx, size)
        p_pair = [k + freed[ctx] * p[right] for k, p in zip(own, p_word, strict=True)]
        pair_llr = np.log(p_pair[0]) - np.log(p_pair[1])
        told = freed[ctx] < 1  # elsewhere a pair says what its word says
        return cls(vocab, word_llr, pairs[told], pair_llr[told], config)

    def ratios(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log p_toxic - log p_ordinary of each word; starts: where documents begin."""
        left = np.concatenate(([0], ids[:-1]))
        left[starts] = 0
        x = self.word_llr[ids]
        if len(self.pairs):
            key = left * len(self.word_llr) + ids
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            x = np.where(self.pairs[at] == key, self.pair_llr[at], x)
        return x

    def evidence(self, docs: list[list[str]]) -> np.ndarray:
        """Per document the greatest mean of the ratios of `window` words in a row; 0 without words."""
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        out, some = np.zeros(len(docs)), np.flatnonzero(lengths)
        if not len(some):
            return out
        ids = np.concatenate([np.fromiter(map(self.vocab.get, docs[k], repeat(0)), np.int64, int(lengths[k])) for k in some])
        n = lengths[some]
        starts = np.cumsum(n) - n
        total = np.concatenate(([0.0], np.cumsum(self.ratios(ids, starts))))
        # A run begins at each word; those near a document's end begin earlier, to be whole.
        first = np.repeat(starts, n)
        last = np.minimum(np.arange(len(ids)) + self.config.window, np.repeat(starts + n, n))
        begin = np.maximum(last - self.config.window, first)
        out[some] = np.maximum.reduceat((total[last] - total[begin]) / (last - begin), starts)
        return out

    def calibrate(self, toxic: list[list[str]], ordinary: list[list[str]]) -> None:
        """The curve of the evidence, by Newton steps with a light ridge; toxic documents weigh `toxic_weight` of all, whatever their number. It never falls."""
        x = np.concatenate([self.evidence(toxic), self.evidence(ordinary)])
        y = np.concatenate([np.ones(len(toxic)), np.zeros(len(ordinary))])
        mean, std = x.mean(), x.std() + 1e-9
        z = np.stack([np.ones(len(x)), (x - mean) / std], axis=1)
        share = self.config.toxic_weight
        case = np.where(y == 1, share / max(len(toxic), 1), (1 - share) / max(len(ordinary), 1)) * len(y)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (case * (p - y)) + 0.05 * w
            h = (z * (case * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 0.05 * np.eye(2)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.slope = max(w[1] / std, 0.0)
        self.bias = w[0] - self.slope * mean

    def score(self, docs: list[list[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * self.evidence(docs), -30, 30)))


class _Constant:
    """Stands in where there are no labels of both classes."""

    def __init__(self, p: float):
        self.p = p

    def score(self, docs: list[list[str]]) -> np.ndarray:
        return np.full(len(docs), self.p)


def corpus_share(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """How often each of these words occurs in all texts, as a share of all words; one partial table per task, summed by Spark."""
    sent = docs.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(vocabulary)})

    def count(batches):
        at = sent.value
        table = np.zeros(len(at) + 1, np.int64)
        seen: Counter = Counter()

        def add() -> None:
            for w, n in seen.items():
                table[-1] += n
                if (i := at.get(w)) is not None:
                    table[i] += n
            seen.clear()

        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()))
                if len(seen) > 100_000:
                    add()
        add()
        hit = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(table[hit], pa.int64())], names=["word", "n"])

    summed = map_arrow(docs.select(F.col(f"`{text}`").cast("string").alias("text")), count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1)
    out[summed.column("word").to_numpy()] = summed.column("n").to_numpy()
    sent.unpersist()
    return dict(zip(vocabulary, (out[:-1] / max(out[-1], 1)).tolist(), strict=True))


def _chosen(known: DataFrame, config: KneserNeyConfig) -> list[tuple[int, int]]:
    """(hash, class) of the sample: each class's distinct texts in the order of their hash, up to the documented bounds; one that does not fit is passed over."""
    out = []
    for y in (1, 0):
        part = F.least(F.min("n"), F.lit(config.max_chars_per_text)).alias("n")
        chars = 0
        for r in known.where(F.col("y") == y).groupBy("h").agg(part).orderBy("h").limit(config.max_docs_per_class).collect():
            if chars + r["n"] <= config.max_chars_per_class:
                chars += r["n"]
                out.append((r["h"], y))
    return out


def _sample(known: DataFrame, docs: DataFrame, text: str, config: KneserNeyConfig) -> tuple[list[str], list[str]]:
    """The texts that toxic and ordinary models learn from; known has the hash h, the length n and the class y of labelled texts. Texts outside the sample are never shuffled."""
    chosen = _chosen(known, config)
    if not chosen:
        return [], []
    few = docs.sparkSession.createDataFrame(chosen, "h bigint, y int")
    found = docs.select(F.substring(F.col(f"`{text}`").cast("string"), 1, config.max_chars_per_text).alias("t"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("h")).join(F.broadcast(few), "h")
    rows = found.groupBy("y", "h").agg(F.min("t").alias("t")).orderBy("y", "h").collect()
    return [r["t"] for r in rows if r["y"]], [r["t"] for r in rows if not r["y"]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", learn_from: Column | None = None, config: KneserNeyConfig = KneserNeyConfig()) -> ToxicityModel | _Constant:
    """Learns from the labelled rows that satisfy learn_from (a condition on the id column); see the module's notes for the bounds."""
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.where(learn_from) if learn_from is not None else docs
    t = F.col(f"`{text}`").cast("string")
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("h"), F.length(t).alias("n")).where("n > 0")
    known = rows.join(marked, "id").select("h", "n", "y")
    texts = _sample(known, docs, text, config)
    if not texts[0] or not texts[1]:
        share = known.agg(F.avg("y")).first()[0]
        return _Constant(float(share or 0.0))
    toxic, ordinary = ([words(t) for t in x] for x in texts)
    held = [int(len(x) * config.calibration_share) for x in (toxic, ordinary)]
    vocabulary = list(dict.fromkeys(w for d in (*toxic[held[0] :], *ordinary[held[1] :]) for w in d))
    model = ToxicityModel.fit(toxic[held[0] :], ordinary[held[1] :], corpus_share(docs, vocabulary, text), config)
    model.calibrate(toxic[: held[0]] or toxic, ordinary[: held[1]] or ordinary)
    return model


def score(docs: DataFrame, model: ToxicityModel | _Constant, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column `out` in 0..1; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def add(b: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = b.column(b.schema.get_field_index(text)).to_pylist()
        parts = [sent.value.score([words(t) for t in texts[i : i + 256]]) for i in range(0, len(texts), 256)]
        return {out: pa.array(np.concatenate(parts), pa.float64())}

    return with_arrow(docs, add, {out: T.DoubleType()})


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit_args) -> DataFrame:
    """docs with `score` and `predicted` (1 if score >= threshold); the model is fitted on the spot."""
    text = fit_args.get("text", "text")
    scored = score(docs, fit(docs, labels, **fit_args), text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
