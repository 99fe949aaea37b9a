"""A tagger fitted to a corpus without tagged text: expectation and maximisation over its distinct pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import tagging as G
from corpuscle.functions import text as X
from corpuscle.session import drop, ship, written

#: Added to every expected count, so that what a small corpus lacks stays possible.
SMOOTHING = 0.5


def piece_counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``(piece, n)``: the corpus' distinct pieces between sure words, counted before and after one shuffle."""
    told = corpus.select(F.explode_outer(G.pieces(X.tokens(F.col(text)))).alias("piece"))  # outer: see lexical.exploded
    return told.where("piece is not null").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def expected(follows: np.ndarray, emits: np.ndarray, codes: np.ndarray, before: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected transitions and emissions of pieces of one length, and their log likelihood (forward, backward).

    ``codes``: classes (piece, place); ``before``: the row of ``follows`` that each piece starts from.
    """
    length, tags = codes.shape[1], follows.shape[1]
    ahead, scale = np.empty((length, len(codes), tags)), np.empty((length, len(codes)))
    for i in range(length):
        reach = follows[before] if i == 0 else ahead[i - 1] @ follows[1:]
        ahead[i] = reach * emits[:, codes[:, i]].T
        scale[i] = ahead[i].sum(axis=1)
        ahead[i] /= scale[i][:, None]
    moves, said, back = np.zeros_like(follows), np.zeros_like(emits), np.ones((len(codes), tags))
    for i in range(length - 1, -1, -1):
        share = ahead[i] * back * n[:, None]
        np.add.at(said.T, codes[:, i], share)
        here = emits[:, codes[:, i]].T * back / scale[i][:, None]
        if i:
            moves[1:] += follows[1:] * ((ahead[i - 1] * n[:, None]).T @ here)
            back = here @ follows[1:].T
        else:
            np.add.at(moves, before, share)
    return moves, said, float((np.log(scale).sum(axis=0) * n).sum())


def _arrays(weights: tuple[dict, dict]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    follows, emits = weights
    names = sorted(emits)
    a = np.array([[follows[b][t] for t in G.LETTERS] for b in "^" + G.LETTERS])
    b = np.array([[emits[c].get(t, 0.0) for c in names] for t in G.LETTERS])
    return a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True), names


def _expectations(follows: np.ndarray, emits: np.ndarray, names: list[str]):
    place = {c: i for i, c in enumerate(names)}
    first = {"^": 0} | {c: 1 + int(np.argmax(emits[:, i])) for c, i in place.items() if c in G.SURE}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves, said, total = np.zeros_like(follows), np.zeros_like(emits), 0.0
        for batch in batches:
            for _, own in batch.groupby(batch["piece"].str.len()):
                codes = np.array([[place[c] for c in p[1:]] for p in own["piece"]])
                before = np.array([first[p[0]] for p in own["piece"]])
                m, s, ll = expected(follows, emits, codes, before, own["n"].to_numpy(dtype=float))
                moves, said, total = moves + m, said + s, total + ll
        rows = [("m", i, j, x) for (i, j), x in np.ndenumerate(moves)] + [("s", i, j, x) for (i, j), x in np.ndenumerate(said)]
        yield pd.DataFrame([*rows, ("l", 0, 0, total)], columns=["kind", "i", "j", "x"])

    return run


def fit_tagger(corpus: DataFrame, text: str = "text", rounds: int = 8) -> tuple[G.Tagger, list[float]]:
    """The tagger after some rounds of expectation and maximisation from the seed, and each round's mean log likelihood.

    The corpus is read once: its distinct pieces are counted, and each round goes over these, in parts side by side; the
    driver sees the sums, a number for each two tags and each tag and class. An empty corpus leaves the seed.
    """
    ship(corpus.sparkSession)
    table = written(piece_counts(corpus, text), "pieces")
    n = table.agg(F.sum(F.col("n") * (F.length("piece") - 1))).first()[0]
    weights, seen = G.seed_weights(), []
    for _ in range(rounds if n else 0):
        follows, emits, names = _arrays(weights)
        made = table.mapInPandas(_expectations(follows, emits, names), "kind string, i int, j int, x double")
        sums = {(r["kind"], r["i"], r["j"]): r["x"] for r in made.groupBy("kind", "i", "j").agg(F.sum("x").alias("x")).collect()}
        seen.append(sums["l", 0, 0] / n)
        weights = (
            {b: {t: sums["m", i, j] + SMOOTHING for j, t in enumerate(G.LETTERS)} for i, b in enumerate("^" + G.LETTERS)},
            {c: {t: sums["s", G.LETTERS.index(t), j] + SMOOTHING for t in G.CLASSES[c]} for j, c in enumerate(names)},
        )
    drop(table)
    return G.Tagger.of(*weights), seen
