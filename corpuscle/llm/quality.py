"""Quality classifier by co-training of two views.

One classifier sees the text's content (hashed byte trigrams, layout, repetition), the other the page's metadata
(source, language, size), never the text. Over rounds each passes the unlabelled documents it is surest of, of all
there are, to the other. Both are calibrated on labelled documents kept from training, and combined as independent
evidence to score all documents.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.session import ship

from .common import col, fresh, written

TEXT_DIMS, LAYOUT = 1024, 11
CONTENT_DIMS = TEXT_DIMS + LAYOUT
SOURCE_DIMS, LANG_DIMS, SIZE_DIMS = 64, 16, 34
META_DIMS = SOURCE_DIMS + LANG_DIMS + SIZE_DIMS + 1


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Root frequencies of the byte trigrams in TEXT_DIMS buckets, of length 1 (zeros for under 3 bytes)."""
    counts = np.zeros(TEXT_DIMS)
    step = 1 << 20
    for i in range(0, max(0, len(raw) - 2), step):
        part = raw[i : i + step + 2].astype(np.uint32)
        mixed = (part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA77)) ^ (part[2:] * np.uint32(0xC2B2AE3D))
        counts += np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=TEXT_DIMS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def content_view(text: str | None) -> np.ndarray:
    """Trigrams, layout and repetition of a whole text; null counts as empty."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, len(raw))
    kinds = np.bincount(raw, minlength=256)
    blanks, lines = int(kinds[[9, 10, 11, 12, 13, 32]].sum()), int(kinds[10]) + 1
    upper, lower, digits = int(kinds[65:91].sum()), int(kinds[97:123].sum()), int(kinds[48:58].sum())
    ends = int(kinds[[33, 44, 46, 58, 59, 63]].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) - ends
    words = (text or "").split()
    twice = sum(map(operator.eq, words, words[1:])) / max(1, len(words) - 1)
    repeated = np.log(max(1, len(words)) / max(1, len(set(words))))
    layout = (
        np.log1p(len(raw)) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 10, blanks / n * 4, upper / max(1, upper + lower) * 2,
        digits / n * 4, marks / n * 8, ends / n * 8, int(kinds[33]) / n * 8, twice * 2, repeated / 4,
    )
    return np.concatenate([trigrams(raw), layout]).astype(np.float32)


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language (null: a value of its own), and the stated size in powers of two and as a number."""
    out = np.zeros(META_DIMS, dtype=np.float32)
    out[_bucket(source, SOURCE_DIMS)] = 0.5
    out[SOURCE_DIMS + _bucket(lang, LANG_DIMS)] = 0.5
    size = SIZE_DIMS - 1 if n_chars is None else min(max(int(n_chars), 0).bit_length(), SIZE_DIMS - 2)
    out[SOURCE_DIMS + LANG_DIMS + size] = 0.5
    out[-1] = 0.0 if n_chars is None else np.log1p(max(int(n_chars), 0)) / 10
    return out


def _bucket(value: str | None, dims: int) -> int:
    return zlib.crc32(b"\0none" if value is None else value.encode("utf-8", "surrogatepass")) % dims


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, look = np.zeros(x.shape[1], dtype=np.float32), np.zeros(x.shape[1], dtype=np.float32)
    weight = (weight / weight.sum()).astype(np.float32)
    rate = np.float32(1 / (0.25 * float((weight * np.einsum("ij,ij->i", x, x)).sum()) + l2))
    for t in range(1, steps + 1):
        slope = x.T @ (weight * (sigmoid(x @ look) - y).astype(np.float32)) + np.float32(l2) * look
        new = look - rate * slope
        look = new + np.float32((t - 1) / (t + 2)) * (new - w)
        w = new
    return w.astype(np.float64)


def logits(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Weights of both views, and (slope, intercept) of each view's calibration; ``prior`` where nothing was learned."""

    content: np.ndarray | None
    metadata: np.ndarray | None
    calibration: np.ndarray | None
    prior: float

    def scores(self, texts: list, sources: list, langs: list, sizes: list) -> np.ndarray:
        """``[document, (content, metadata, both)]`` probabilities of good quality.

        The views are taken as independent evidence: their logits are added and the prior's, which both hold, is
        taken off once.
        """
        if self.content is None:
            return np.full((len(texts), 3), self.prior)
        out = np.zeros((len(texts), 2))
        for i, (t, *meta) in enumerate(zip(texts, sources, langs, sizes, strict=True)):
            out[i] = logits(self.content, content_view(t)[None])[0], logits(self.metadata, metadata_view(*meta)[None])[0]
        calibrated = out * self.calibration[:, 0] + self.calibration[:, 1]
        return sigmoid(np.column_stack([calibrated, calibrated.sum(axis=1) - np.log(self.prior / (1 - self.prior))]))


#: Of the views' weights and the prior: for the content's and the metadata's classifier, what the other one is surest
#: of, as (numbers of the documents, their features in the taught view, labels).
Exchange = Callable[[tuple[np.ndarray, np.ndarray], float], tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]]


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, exchange: Exchange | None, rounds: int = 2) -> Model:
    """Two views of labelled documents (y: 0 or 1), which teach each other through ``exchange`` in each round.

    A third of the labelled documents calibrates. Pseudo-labels count half; a document keeps the first it is given.
    """
    prior = float(y.mean()) if len(y) else 1.0
    if len(y) < 12 or min(y.sum(), len(y) - y.sum()) < 4:
        return Model(None, None, None, prior)
    order = np.argsort(y, kind="stable")
    check = np.zeros(len(y), dtype=bool)
    check[order[::3]] = True
    said: list[dict[int, tuple[np.ndarray, float]]] = [{}, {}]

    def train(v: int) -> np.ndarray:
        rows, given = [r for r, _ in said[v].values()], [g for _, g in said[v].values()]
        weight = np.concatenate([np.ones((~check).sum()), np.full(len(given), 0.5)])
        return fit_logistic(np.vstack([x[v][~check], *rows]), np.concatenate([y[~check], given]), weight)

    weights = train(0), train(1)
    for _ in range(rounds if exchange else 0):
        for v, passed in enumerate(exchange(weights, prior)):
            for number, row, given in zip(*passed, strict=True):
                said[v].setdefault(int(number), (row, float(given)))
        weights = train(0), train(1)
    calibration = []
    for v in (0, 1):
        raw = logits(weights[v], x[v][check])
        a, b = fit_logistic((raw[:, None] / 8).astype(np.float32), y[check], np.ones(check.sum()), l2=1e-3, steps=2000)
        calibration.append((a / 8, b))
    return Model(*weights, np.array(calibration), prior)


_VIEWS = T.BinaryType()


def _views(texts: pd.Series, sources: pd.Series, langs: pd.Series, sizes: pd.Series) -> pd.Series:
    rows = zip(texts, sources, langs, _whole(sizes), strict=True)
    return pd.Series([np.concatenate([content_view(t), metadata_view(*meta)]).astype(np.float16).tobytes() for t, *meta in rows])


def _whole(sizes: pd.Series) -> list[int | None]:
    return [None if pd.isna(n) else int(n) for n in sizes]


def _matrix(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.empty((len(raw), CONTENT_DIMS + META_DIMS), dtype=np.float32)
    for i, r in enumerate(raw):
        x[i] = np.frombuffer(r, dtype=np.float16)
    return x[:, :CONTENT_DIMS], x[:, CONTENT_DIMS:]


def _inputs(text: str, source: str, lang: str, size: str) -> list[Column]:
    return [col(text), col(source).cast("string"), col(lang).cast("string"), col(size).cast("long")]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    size: str = "n_chars",
    key: str = "doc_id",
    label: str = "quality",
    most_labelled: int = 4000,
    most_passed: int = 1000,
    rounds: int = 2,
    sure: float = 0.9,
) -> Model:
    """Learns from ``most_labelled`` labelled keys at most, those of the least hashes, and from all other documents.

    In each round both classifiers score every document without a label; each passes the ``most_passed`` it is surest
    of, at ``sure`` or more, in the classes' proportions (ties by hash). Of several labels of a key the lowest counts,
    of several rows the one of the least hash; null labels and keys do not count. Too few labels, or labels of one
    class only, give their mean as everyone's score (no label: 1).
    """
    ship(docs.sparkSession)
    known = labels.where(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key).alias("id")).agg(F.min(col(label)).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most_labelled).select("id", F.col("y").cast("double").alias("y"))
    inputs = _inputs(text, source, lang, size)
    row = F.xxhash64(col(key), *inputs)
    views = F.pandas_udf(_views, _VIEWS)("t", "s", "g", "c")
    rows = docs.select(col(key).alias("id"), row.alias("h"), *[c.alias(a) for c, a in zip(inputs, "tsgc", strict=True)]).where("id is not null")
    of_id = rows.select("id", "h").join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("h").alias("h"))  # most_labelled rows at most
    taught = rows.join(F.broadcast(of_id), ["id", "h"]).select("id", "y", views.alias("x")).dropDuplicates(["id"]).orderBy("id").toPandas()
    y = (taught["y"].to_numpy(dtype=float) > 0).astype(float)

    def exchange(weights: tuple[np.ndarray, np.ndarray], prior: float):
        shared = docs.sparkSession.sparkContext.broadcast(weights)  # two weight vectors

        def surety(texts: pd.Series, sources: pd.Series, langs: pd.Series, sizes: pd.Series) -> pd.DataFrame:
            pairs = zip(texts, sources, langs, _whole(sizes), strict=True)
            made = [(logits(shared.value[0], content_view(t)[None])[0], logits(shared.value[1], metadata_view(*meta)[None])[0]) for t, *meta in pairs]
            return pd.DataFrame(np.array(made, dtype=float).reshape(-1, 2), columns=["v0", "v1"])

        least = float(np.log(sure / (1 - sure)))
        scored = rows.select("id", "h", F.pandas_udf(surety, "v0 double, v1 double")("t", "s", "g", "c").alias("v")).select("id", "h", "v.*")
        scored = written(scored.where((F.abs("v0") >= least) | (F.abs("v1") >= least)), "surety").join(known, "id", "left_anti")
        best = None
        for v in (0, 1):
            for y_of, sign, part in ((1.0, 1, prior), (0.0, -1, 1 - prior)):
                v_of = F.round(sign * F.col(f"v{v}"), 9)  # sums in another order must not change the choice
                top = scored.where(v_of >= least).orderBy(v_of.desc(), "h").limit(round(most_passed * part))
                top = top.select("h", F.lit(1 - v).alias("to"), F.lit(y_of).alias("y"))
                best = top if best is None else best.unionByName(top)
        best = written(best.distinct(), "passed")  # 2 * most_passed rows at most
        found = rows.join(F.broadcast(best), "h").select("h", "to", "y", views.alias("x")).dropDuplicates(["h", "to"]).orderBy("h", "to").toPandas()
        both = _matrix(found["x"].tolist())
        to, labels_of = found["to"].to_numpy(), found["y"].to_numpy(dtype=float)
        shared.unpersist()
        return tuple((found["h"].to_numpy()[to == v], both[v][to == v], labels_of[to == v]) for v in (0, 1))

    return co_train(_matrix(taught["x"].tolist()), y, exchange, rounds)


def score_columns(docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang", size: str = "n_chars") -> Column:
    """A struct of content, metadata and score, each in [0, 1]."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors

    def score(texts: pd.Series, sources: pd.Series, langs: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.scores(texts.tolist(), sources.tolist(), langs.tolist(), _whole(sizes)), columns=["content", "metadata", "score"])

    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("content", "metadata", "score")])
    return F.pandas_udf(score, kind)(*_inputs(text, source, lang, size))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is ``least`` at least, with their columns as they are.

    Every row is scored by itself: null texts as empty ones, null source, language and size as values of their own,
    texts whole, however long; equal rows stay or go together. Other columns may have any name. Without labels that
    teach anything all stay. An empty table gives an empty result.
    """
    (scored,) = fresh(docs, "quality")
    out = docs.withColumn(scored, score_columns(docs, fit(docs, labels)))
    return out.where(col(scored)["score"] >= least).select(*[col(c) for c in docs.columns])


def quality_report(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, p_content, p_metadata, score and keep of all documents, a row each; cases as in ``keep_good``."""
    q = score_columns(documents, fit(documents, labels))
    return documents.select("doc_id", q.alias("q")).select(
        "doc_id", F.col("q.content").alias("p_content"), F.col("q.metadata").alias("p_metadata"), F.col("q.score").alias("score"), (F.col("q.score") >= least).alias("keep")
    )
