"""Toxicity by maximum-scoring segments: token log-odds with Dirichlet priors, every significant passage, extreme-value calibration."""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, query, read, stage, stream_udf

SAMPLE = 50_000      # labelled rows that the model is fitted on at most, taken by a hash of their id
VOCABULARY = 65_536  # units that the model holds at most, those with the surest log-odds
PRIOR = 0.05         # weight of the corpus counts as a prior, as a share of the labelled counts
SURE = 6.0           # standard errors by which a unit's toxic count must differ from its share
PREFIXES = (3, 4, 5, 6, 7, 8)  # lengths of word beginnings that are units besides whole words
ROOM = 300_000       # words whose scores or counts a task remembers
DRIFT = 0.2          # what every word costs, so that passages end
EXPECTED = 0.05      # chance passages a document of this score or more: the limit of significance
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


_LONGER = "\u0130"  # the only letter that is longer in lower case, by a mark that is no letter


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case; they are found in the text itself, so that they stand where they are found."""
    if not text:
        return []
    return [w.lower() for w in _WORD.findall(text)] if _LONGER in text else _WORD.findall(text.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in time linear in its length (Ruzzo and Tompa).

    Candidates keep the totals before and behind them, and a link to the last one before them with a smaller total
    in front, so the search for it never looks at a candidate twice.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    starts, ends, left, right, link = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        a, b, l, r = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = link[j]
            if j < 0 or right[j] >= r:
                break
            a, l = starts[j], left[j]
            del starts[j:], ends[j:], left[j:], right[j:], link[j:]
        for values, v in zip((starts, ends, left, right, link), (a, b, l, r, j)):
            values.append(v)
    return [(a, b, float(r - l)) for a, b, l, r in zip(starts, ends, left, right)]


class WordScores(dict):
    """Score of any word: that of the word if it is a unit of the model, else of its longest beginning that is one, else -DRIFT."""

    def __init__(self, units: dict[str, float]):
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> float:
        value = self.units.get(word)
        for n in reversed(PREFIXES) if value is None else ():
            if n < len(word) and (value := self.units.get(word[:n] + "*")) is not None:
                break
        value = -DRIFT if value is None else value
        if len(self) < ROOM:
            self[word] = value
        return value


@dataclass
class Model:
    """Scores of units (words, and beginnings marked by *), the extreme-value law of chance passages, the logistic law of labels."""

    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0    # lambda: a chance passage of score s or more is met size·exp(-rate·s) times a word
    size: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float = 0.0    # share of toxic labels; the score where there is no model

    def passages(self, words: list[str], memo: WordScores) -> list[tuple[int, int, float, float]]:
        """(start, end, score, expected number by chance) of the passages of a text."""
        line = np.fromiter(map(memo.__getitem__, words), float, len(words))
        if not len(line) or line.max() <= 0:
            return []
        return [(a, b, s, self.size * len(words) * math.exp(-min(700.0, self.rate * s))) for a, b, s in segments(line)]

    @staticmethod
    def features(passages: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """Surprise of the best passage, -log(1 - exp(-E)), and log of the summed surprise of the significant ones."""
        if not passages:
            return 0.0, 0.0
        best = min(e for *_, e in passages)
        surprise = -math.log(max(1e-300, -math.expm1(-best)))
        return surprise, math.log1p(sum(-math.log(max(1e-300, e)) for *_, e in passages if e <= EXPECTED))

    def score(self, passages) -> float:
        if not self.scores:
            return self.base
        x, y = self.features(passages)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.weights[0] + self.weights[1] * x + self.weights[2] * y))))


def _fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(col(doc_id).cast("string"), "utf-8")), F.lit(4))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from; a NULL id is not one."""
    return F.coalesce(_fold(doc_id) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(toxic, fold, text) of at most ``limit`` labelled rows; a document with several labels is toxic if one says so. Staged."""
    own = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = stage(own.withColumn("fold", _fold()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "labelled")
    text = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    return stage(text.join(F.broadcast(own), "doc_id").select("toxic", "fold", "text"), "training")  # `limit` rows


def unit_counts(training: DataFrame) -> DataFrame:
    """(unit, toxic, clean): in how many texts of either label a word, or words with a beginning, occur; a word counts once a text."""
    def count(batches):
        totals = {0: Counter(), 1: Counter()}

        def rows():
            words = list(totals[0].keys() | totals[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([totals[1][x] for x in words], pa.int64()), pa.array([totals[0][x] for x in words], pa.int64())], names=["word", "toxic", "clean"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                totals[int(label > 0)].update(set(words_of(text.as_py())))
                if len(totals[0]) + len(totals[1]) > ROOM:
                    yield rows()
                    totals = {0: Counter(), 1: Counter()}
        yield rows()

    words = training.select("toxic", "text").mapInArrow(count, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    beginnings = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n < F.length("word")), lambda n: F.concat(F.col("word").substr(F.lit(1), n), F.lit("*")))
    return (words.select(F.explode(F.concat(F.array("word"), beginnings)).alias("unit"), "toxic", "clean")
            .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def corpus_counts(docs: DataFrame, units: list[str]) -> dict[str, int]:
    """How often each of a bounded list of units occurs in all documents; '' counts all words."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(units))  # VOCABULARY units at most

    def count(batches):
        own, totals, words = wanted.value, Counter(), Counter()

        def fold():
            for w, n in words.items():
                totals[""] += n
                for u in (w, *(w[:k] + "*" for k in PREFIXES if k < len(w))):
                    if u in own:
                        totals[u] += n
            words.clear()

        for batch in batches:
            for text in batch.column(0):
                words.update(words_of(text.as_py()))
                if len(words) > ROOM:
                    fold()
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["unit", "n"])

    rows = docs.select(col("text")).mapInArrow(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).collect()
    return {r["unit"]: r["n"] for r in rows}


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float, prior: float, all_prior: float) -> float:
    """Log-odds ratio of a unit between the labels, with ``prior`` of ``all_prior`` pseudo-counts added on either side."""
    a, b = toxic + prior, clean + prior
    return math.log(a / max(1e-9, n_toxic + all_prior - a)) - math.log(b / max(1e-9, n_clean + all_prior - b))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) by Newton's method, features on a unit scale, with a ridge that keeps separable data finite."""
    scale = np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w * (np.arange(len(w)) > 0))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out: words on two thirds of them, calibration on the rest.

    Priors are counts of all documents. What reaches the driver is bounded: VOCABULARY units and ``limit`` pairs of features.
    """
    training = sample(docs, labels, limit)
    learn, check = training.where("fold <> 3"), training.where("fold = 3")
    units = stage(unit_counts(learn), "units")
    n_toxic, n_clean = units.where(~F.col("unit").endswith("*")).agg(F.sum("toxic"), F.sum("clean")).first()
    share = training.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0]
    if not n_toxic or not n_clean:
        return Model(base=float(share or 0.0))
    part = n_toxic / (n_toxic + n_clean)
    expected = (F.col("toxic") + F.col("clean")) * part
    z = F.abs(F.col("toxic") - expected) / F.sqrt(expected * (1 - part))
    best = units.withColumn("z", z).where(F.col("z") >= SURE).orderBy(F.desc("z"), "unit").limit(VOCABULARY + 1).collect()
    if len(best) > VOCABULARY:
        warnings.warn(f"more than {VOCABULARY} units pass the test; the least sure ones are left out")
        best = best[:VOCABULARY]
    corpus = corpus_counts(docs, [r["unit"] for r in best])
    scores, clean, pseudo = {}, {}, PRIOR * (n_toxic + n_clean)
    for r in best:
        prior = pseudo * max(1, corpus.get(r["unit"], 0)) / max(1, corpus.get("", 0))
        scores[r["unit"]] = log_odds(r["toxic"], r["clean"], n_toxic, n_clean, prior, pseudo) - DRIFT
        clean[r["unit"]] = (r["clean"] + prior) / (n_clean + pseudo)
    model = Model(scores, base=float(share))
    model.rate = chance_rate(scores, clean)
    rows = features(check, model, "toxic")
    y, x0 = np.array([r["toxic"] > 0 for r in rows], float), np.array([[r["best"], r["n"]] for r in rows], float).reshape(-1, 2)
    quiet = (y == 0) & (x0[:, 1] > 0)
    model.size = float(quiet.sum() / max(1e-300, (x0[quiet, 1] * np.exp(-np.minimum(700, model.rate * x0[quiet, 0]))).sum())) if quiet.any() else 1.0
    rows = features(check, model, "toxic")
    if len(rows) and 0 < sum(r["toxic"] > 0 for r in rows) < len(rows):
        y, x = np.array([r["toxic"] > 0 for r in rows], float), np.array([[r["x"], r["y"]] for r in rows], float)
        model.weights = tuple(float(v) for v in logistic(x, y))
    else:
        model.weights = (math.log(max(1e-6, share) / max(1e-6, 1 - share)), 1.0, 0.0)
    return model


def chance_rate(scores: dict[str, float], shares: dict[str, float]) -> float:
    """The positive root of E[exp(rate·score)] = 1 over words as they occur in clean texts; other words score -DRIFT.

    Only whole words are summed, as beginnings stand for the same words again.
    """
    own = [u for u in scores if not u.endswith("*")]
    s, p = np.array([scores[u] for u in own]), np.array([shares[u] for u in own])
    p = np.maximum(p, 1e-9)
    rest = max(1e-9, 1 - p.sum())

    def over(rate: float) -> float:
        return float((p * np.exp(np.minimum(700, rate * s))).sum() + rest * math.exp(-rate * DRIFT) - 1)

    low, high = 1e-6, 1e-6
    while over(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def features(rows: DataFrame, model: Model, label: str) -> list:
    """The calibration sample's features, at most SAMPLE rows."""
    def compute(batches):
        own, memo = model, WordScores(model.scores)
        for batch in batches:
            out = []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(t.as_py())
                found = own.passages(words, memo)
                x, z = own.features(found)
                out.append((y, max((s for _, _, s, _ in found), default=0.0), len(words), x, z))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64()))] if out else
                                             [pa.array([], t) for t in (pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64())], names=["toxic", "best", "n", "x", "y"])

    return rows.select(label, "text").mapInArrow(compute, "toxic int, best double, n bigint, x double, y double").collect()


_PASSAGES = "struct<score:double,passages:array<struct<start:int,end:int,score:double,expected:double>>>"


def scored(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """``docs`` without the text, with ``score`` (0 to 1), ``predicted`` and ``passages``, as the last columns.

    ``passages`` holds every significant passage: characters from and to, its score and how many as good chance would give. Only the text enters a
    score. NULL and empty texts, or texts without letters, have no passages and the score of a text without toxic words;
    equal texts score alike; an empty table gives no rows; clashing columns keep their names.
    """
    def score(batches):
        import pandas as pd

        own, memo = model, WordScores(model.scores)  # travels with the function, VOCABULARY units at most
        for texts in batches:
            out, spans = [], []
            for t in texts:
                found = own.passages(words_of(t), memo)
                keep = [f for f in found if f[3] <= EXPECTED]
                out.append(own.score(found))
                if keep:
                    at = [m.span() for m in _WORD.finditer(t)]
                    spans.append([{"start": at[a][0], "end": at[b - 1][1], "score": s, "expected": e} for a, b, s, e in keep])
                else:
                    spans.append([])
            yield pd.DataFrame({"score": out, "passages": spans})

    rest, r = docs.drop(text), free(docs, "_scored")
    return (docs.withColumn(r, stream_udf(score, _PASSAGES, frame=True)(col(text)))
            .select(*[col(c) for c in rest.columns], F.col(r)["score"].alias(free(rest, "score")), (F.col(r)["score"] >= THRESHOLD).cast("int").alias(free(rest, "predicted")),
                    F.col(r)["passages"].alias(free(rest, "passages"))))


@query("op9_toxic_segments")
def op9(spark, root):
    docs = read(spark, root, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, root, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "passages")
