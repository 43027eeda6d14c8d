"""Toxicity by weak supervision.

Many voters look at a text: one for each word of an induced lexicon, a general lexicon, and patterns; each says toxic (1), clean
(-1) or nothing (0). A generative label model estimates how accurate every voter is, how often it speaks and how strongly voters
are correlated, by expectation maximisation; correlated voters share their weight. Its posterior labels train a linear classifier on
features of the text, which scores every document. Labels of some rows serve to induce the lexicon and to start the label model.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows with labels that are read for fitting, at most about so many; chosen by a hash of their id.
FIT_ROWS = 12_000
#: Words of the induced lexicon, and how many rows must hold one.
LEXICON, LEAST_ROWS = 256, 5
#: Beginnings of words that may be in the lexicon too, for languages that build words.
BEGINNINGS = (5, 6, 7, 8)
#: A general lexicon of insults, one voter for all.
GENERAL = frozenset("idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting dumb imbecile filth vermin connard salaud ordure abruti idiota imbécil basura escoria estúpido dummkopf abschaum arschloch trottel".split())
_STRIP = string.punctuation + "¡¿«»…“”„’‘–—"
_ADDRESS = re.compile(r"\b(?:you(?:'re| are)?|tu es|vous êtes|du bist|eres|shut up|hate (?:you|them)|go away)\b")
_RUN = re.compile(r"([!?])\1{2,}")


def words_of(text: str) -> set[str]:
    """Distinct lower-case words without the punctuation around them, and beginnings of longer ones, marked by a star."""
    found = {w.strip(_STRIP) for w in set(text.lower().split())} - {""}
    return found.union(*({w[:k] + "*" for w in found if len(w) > k} for k in BEGINNINGS))


def patterns(text: str) -> tuple[float, ...]:
    """Address of a person, runs of marks, and share of upper-case letters, each from 0 to 1."""
    low = text.lower()
    letters = len(text) or 1
    upper = sum(map(text.count, string.ascii_uppercase))
    return (float(bool(_ADDRESS.search(low))), min(1.0, len(_RUN.findall(text)) / 3), min(1.0, upper / letters * 2))


@dataclass(frozen=True)
class Model:
    """Lexicon words with their places, and weights: intercept, words, distinct words hit (log), general, patterns."""

    words: dict[str, int]
    weights: np.ndarray

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(len(self.weights))
        x[0] = 1
        found = words_of(text)
        k = 0
        for w in found.intersection(self.words):
            x[1 + self.words[w]] = 1
            k += 1
        n = 1 + len(self.words)
        x[n] = math.log1p(k)
        x[n + 1] = float(not found.isdisjoint(GENERAL))
        x[n + 2 :] = patterns(text)
        return x

    def score(self, text: str | None) -> float:
        z = float(self.features(text or "") @ self.weights)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def votes(x: np.ndarray, n_words: int) -> np.ndarray:
    """Voters' votes from features: words and lexicon say toxic or nothing; patterns toxic; their absence clean."""
    lex = x[:, 1 : 1 + n_words].astype(np.int8)
    general = x[:, n_words + 2].astype(np.int8)
    pat = x[:, n_words + 3 :]
    address, marks = (pat[:, 0] > 0).astype(np.int8), (pat[:, 1] >= 1).astype(np.int8)
    shout = (pat[:, 2] > 0.6).astype(np.int8)
    no_word = -(lex.sum(axis=1) == 0).astype(np.int8)
    calm = -((pat.max(axis=1) < 0.2) & (general == 0)).astype(np.int8)
    several = (lex.sum(axis=1) >= 4).astype(np.int8)
    return np.column_stack([lex, general, address, marks, shout, several, no_word, calm])


def label_model(v: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of the toxic class per row, from signed votes (1, 0, -1); ``start`` is the first guess and no evidence afterwards.

    Each voter has, per class, its own chances of each vote. A naive product would count correlated voters many times; their
    correlations within the classes are estimated each round, and a voter's evidence is weighed by the generalised least squares weight that
    they give it: the row sums of the inverse of the (ridged) correlation matrix, which are 1 for independent voters and 1/k for k equal ones.
    """
    n, m = v.shape
    kinds = [(v == x).astype(float) for x in (-1, 0, 1)]
    post = start.astype(float)
    for _ in range(rounds):
        t1 = post.sum()
        t0 = n - t1
        p1, p0 = (np.stack([(w @ k + 0.5 * (x + 1)) / (t + 2) for x, k in enumerate(kinds)]) for w, t in ((post, t1), (1 - post, t0)))
        p1, p0 = (np.clip(p / p.sum(axis=0), 1e-4, 1) for p in (p1, p0))
        means = [p[2] - p[0] for p in (p1, p0)]
        rest = v - np.outer(post, means[0]) - np.outer(1 - post, means[1])
        sd = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        corr = (rest.T @ rest) / n / np.outer(sd, sd)
        np.fill_diagonal(corr, 1)
        weight = np.clip(np.linalg.solve(corr + 0.1 * np.eye(m), np.ones(m)) * 1.1, 0, 1)
        told = (np.log(p1) - np.log(p0)) * weight
        z = math.log((t1 + 1) / (t0 + 1)) + sum(k @ told[x] for x, k in enumerate(kinds))
        new = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        if np.abs(new - post).max() < 1e-4:
            return new
        post = new
    return post


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps; the intercept is not shrunk."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str):
    """True where crc32 of the id as text leaves 0 when divided by 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fit on about ``rows`` labelled rows at most that are not held out, chosen by a hash of the id.

    Only word counts of the lexicon's size and features of the sampled rows come to the driver. Without labels of both classes every
    score is the share of toxic labels (0 without any).
    """
    lab = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    lab = lab.where(~held_out("l_id")).groupBy("l_id").agg(F.max("y").alias("y"))
    lab = materialise(lab, "labels")
    n = lab.count()
    part = lab.where(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(n, 1))))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(part, F.col("id") == F.col("l_id")).select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, bad = Counter(), Counter()
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                found = words_of(t or "")
                every.update(found)
                if y:
                    bad.update(found)
            ws = list(every)
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([every[w] for w in ws], pa.int64()), pa.array([bad[w] for w in ws], pa.int64())], ["word", "n", "bad"])

    sample = materialise(sample, "sample")
    size = sample.agg(F.count("*").alias("n"), F.sum("y").alias("bad")).first()
    total, toxic = size["n"], size["bad"] or 0
    if not toxic or toxic == total:
        share = toxic / total if total else 0.0
        return Model({}, np.array([math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0, 0, 0, 0, 0]))
    prior = toxic / total
    counts = sample.mapInArrow(count, "word string, n bigint, bad bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # words whose toxic rows stand out: lower bound of their share, times the log of how often they occur
    share = F.expr(f"(bad + {prior}) / (n + 1)")
    worth = (F.log(share / prior) * F.sqrt("bad")).alias("worth")
    top = counts.where((F.col("bad") >= LEAST_ROWS) & (share > max(0.5, min(0.9, 3 * prior)))).select("word", worth).orderBy(F.desc("worth"), "word").limit(LEXICON)
    words = {r["word"]: i for i, r in enumerate(top.collect())}
    blank = Model(words, np.zeros(len(words) + 6))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [blank.features(t or "").tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], ["x", "y"])

    got = sample.mapInArrow(features, "x array<double>, y int").toArrow()
    x = np.array(got.column("x").combine_chunks().values.to_numpy()).reshape(total, -1)
    y = got.column("y").to_numpy()
    post = label_model(votes(x, len(words)), np.where(y == 1, 0.97, 0.01), prior)
    return Model(words, fit_linear(x, post))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Adds a score (0 to 1) and the prediction (1 if score >= 0.5) to every row, in place of columns of these names.

    Null and empty texts are scored by their lack of evidence.
    """

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        return pd.Series([model.score(t) for t in texts])

    return docs.withColumn(score_col, run(F.col(text_col))).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def label_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    model = fit(docs, labels, id_col, text_col)
    return score(docs.select(F.col(id_col), F.col(text_col).alias("text")), model).select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
