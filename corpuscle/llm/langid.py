"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary, fitted by expectation-maximisation on
labelled texts. A word's probability is the sum over all its segmentations into pieces (forward
algorithm, in logarithms); pieces do not cross words, so a text's is the product over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.session import ship

from .common import col, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\W\d_]+")
#: Marks the start of a word in the vocabulary.
MARK = "▁"
#: Words above this length are taken one by one, so a lattice stays small.
LONG = 48
UNKNOWN = "und"


def load_pieces(path: str = VOCABULARY) -> tuple[dict[str, int], np.ndarray]:
    """``({piece: id}, id of each of the 256 byte pieces)`` of a SentencePiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte = {}, np.zeros(256, dtype=np.int64)
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            of_byte[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = i
    return pieces, of_byte


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Trie:
    """The vocabulary as transitions ``(node, character) -> node`` in sorted arrays, followed for many texts at once."""

    def __init__(self, pieces: dict[str, int]):
        child: dict[int, int] = {}
        piece = [-1]
        for text, p in pieces.items():
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                node = child[key]
            piece[node] = p
        self.piece = np.array(piece, dtype=np.int64)
        self.keys = np.array(sorted(child), dtype=np.int64)
        self.nodes = np.array([child[k] for k in sorted(child)], dtype=np.int64)

    def step(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The next nodes; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(nodes), -1)
        wanted = nodes << 21 | characters
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.nodes[at], -1)


class Lattice:
    """All segmentations of some words: edges ``(word, start, end, piece)`` as arrays.

    A character that is no piece is an edge of its own, whose probability is that of its UTF-8 bytes: piece
    ids from ``-1`` down stand for these.
    """

    def __init__(self, words: list[str], pieces: dict[str, int] | Trie):
        trie = pieces if isinstance(pieces, Trie) else Trie(pieces)
        self.size = np.array([len(w) + 1 for w in words], dtype=np.int64)
        text = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        first = np.cumsum(self.size) - self.size
        word = np.repeat(np.arange(len(words)), self.size)
        limit = (first + self.size)[word]
        start, at = np.arange(len(text)), np.arange(len(text))
        node, lone, found = np.zeros(len(text), dtype=np.int64), np.ones(len(text), dtype=bool), []
        while len(start):
            node = trie.step(node, text[at])
            on = node >= 0
            start, at, node = start[on], at[on] + 1, node[on]
            ends = trie.piece[node] >= 0
            found.append((start[ends], at[ends], trie.piece[node[ends]]))
            if len(found) == 1:
                lone[start[ends]] = False
            on = at < limit[start]
            start, at, node = start[on], at[on], node[on]
        others, which = np.unique(text[lone], return_inverse=True)
        self.others = {chr(c): -1 - i for i, c in enumerate(others.tolist())}
        alone = np.flatnonzero(lone)
        found.append((alone, alone + 1, -1 - which))
        begin, end, self.piece = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        self.word = word[begin]
        self.start, self.end = begin - first[self.word], end - first[self.word]

    def edge_scores(self, logp: np.ndarray, of_byte: np.ndarray) -> np.ndarray:
        """``[edge, language]``."""
        if not self.others:
            return logp[self.piece]
        extra = np.array([logp[of_byte[list(c.encode("utf-8", "surrogatepass"))]].sum(axis=0) for c in self.others])
        return np.concatenate([logp, extra[::-1]])[self.piece]  # -1 is the last row

    def sums(self, scores: np.ndarray, backward: bool = False) -> np.ndarray:
        """``[word, place, language]``: log of the summed probabilities of all ways from the start, or to the end."""
        n = int(self.size.max(initial=0))
        out = np.full((len(self.size), n + 1, scores.shape[1]), -np.inf)
        out[np.arange(len(self.size)), self.size if backward else 0] = 0
        into, source = (self.start, self.end) if backward else (self.end, self.start)
        order = np.lexsort((self.word, into))
        borders = np.searchsorted(into[order], np.arange(n + 2))
        for place in range(n - 1, -1, -1) if backward else range(1, n + 1):
            edges = order[borders[place] : borders[place + 1]]
            if not len(edges):
                continue
            w = self.word[edges]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            ways = out[w, source[edges]] + scores[edges]
            most = np.maximum.reduceat(ways, first)
            counts = np.diff(np.append(first, len(w)))
            out[w[first], place] = most + np.log(np.add.reduceat(np.exp(ways - np.repeat(most, counts, axis=0)), first))
        return out

    def marginals(self, logp: np.ndarray, of_byte: np.ndarray) -> np.ndarray:
        """``[word, language]``: the log probability of each word."""
        return self.sums(self.edge_scores(logp, of_byte))[np.arange(len(self.size)), self.size]

    def expected(self, logp: np.ndarray, of_byte: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations of words of one language (``logp``: one column)."""
        scores = self.edge_scores(logp, of_byte)
        ahead, back = self.sums(scores), self.sums(scores, backward=True)
        whole = ahead[np.arange(len(self.size)), self.size]
        share = np.exp(ahead[self.word, self.start] + scores + back[self.word, self.end] - whole[self.word])[:, 0] * counts[self.word]
        known = self.piece >= 0
        out = np.bincount(self.piece[known], share[known], minlength=len(logp))
        for c, p in self.others.items():
            np.add.at(out, of_byte[list(c.encode("utf-8", "surrogatepass"))], share[self.piece == p].sum())
        return out


def in_lattices(words: list[str], pieces: Trie, step: int = 4000) -> Iterator[tuple[list[int], Lattice]]:
    """Lattices of the words, with the places of these in the list; long words stand alone."""
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for k in range(0, len(short), step):
        yield short[k : k + step], Lattice([words[i] for i in short[k : k + step]], pieces)
    for i, w in enumerate(words):
        if len(w) > LONG:
            yield [i], Lattice([w], pieces)


class Model:
    """Languages and the log probabilities ``[piece, language]``. Keeps the last words' scores."""

    def __init__(self, langs: list[str], logp: np.ndarray, pieces: dict[str, int], of_byte: np.ndarray, most: int = 200_000):
        self.langs, self.logp, self.pieces, self.of_byte, self.most = langs, logp, pieces, of_byte, most
        self.trie = Trie(pieces)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def __reduce__(self):
        return Model, (self.langs, self.logp, self.pieces, self.of_byte, self.most)

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.most:
            self.known, self.table = {}, self.table[:0]
        new = sorted(words - self.known.keys())
        if not new:
            return
        rows = np.zeros((len(new), len(self.langs)))
        for at, lattice in in_lattices(new, self.trie):
            rows[at] = lattice.marginals(self.logp, self.of_byte)
        self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate([self.table, rows])

    def predict(self, texts: list[str | None], step: int = 200) -> Iterator[tuple[str, float]]:
        """The language and its share of the texts' total probability, all languages being as likely before."""
        for k in range(0, len(texts), step):
            found = [words_of(t) if t else [] for t in texts[k : k + step]]
            if self.langs:
                if len(self.known) > self.most:
                    self.known, self.table = {}, self.table[:0]
                self.learn({w for words in found for w in words})
            for words in found:
                if not self.langs or not any(c.isalpha() for w in words for c in w):
                    yield UNKNOWN, 0.0
                    continue
                total = self.table[[self.known[w] for w in words]].sum(axis=0)
                best = int(total.argmax())
                yield self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for k in range(0, len(texts), 500):
                counts = Counter(w for t in texts.iloc[k : k + 500] if t for w in words_of(t))
                yield pd.DataFrame({"lang": lang, "word": list(counts), "n": list(counts.values())}, columns=["lang", "word", "n"])


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", path: str = VOCABULARY, most_rows: int = 20_000, rounds: int = 3, smooth: float = 0.05, most_langs: int = 512
) -> Model:
    """Piece probabilities of each non-null language of the labelled rows.

    Learns from ``most_rows`` rows at most: all, or those whose keys have the least hashes. ``smooth`` is added to
    each piece's expected count. No rows give a model without languages. Null and empty texts teach nothing, whole
    texts count, repeated rows count as often as they come. More than ``most_langs`` languages raise ValueError, as
    a number for each piece and language is broadcast.
    """
    spark = labelled.sparkSession
    ship(spark)
    pieces, of_byte = load_pieces(path)
    size = max([*pieces.values(), *of_byte.tolist()]) + 1
    rows = labelled.where(col(lang).isNotNull()).select(col(lang).cast("string").alias("lang"), col(text).alias("text"), F.xxhash64(col(key)).alias("h"))
    if rows.count() > most_rows:
        cut = rows.select("h").orderBy("h").limit(most_rows).agg(F.max("h")).first()[0]
        rows = rows.where(F.col("h") <= cut)
    counts = written(
        rows.select("lang", "text").mapInPandas(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words"
    )
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())  # languages of a bounded sample
    if len(langs) > most_langs:
        raise ValueError(f"{len(langs)} languages, more than {most_langs}")
    logp = np.full((size, len(langs)), -np.log(size))
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((langs, logp, pieces, of_byte))  # vocabulary x languages

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            langs, logp, pieces, of_byte = shared.value
            trie = Trie(pieces)
            total = np.zeros_like(logp)
            for batch in batches:
                for name, part in batch.groupby("lang"):
                    k, words, n = langs.index(name), part["word"].tolist(), part["n"].to_numpy()
                    for at, lattice in in_lattices(words, trie):
                        total[:, k] += lattice.expected(logp[:, k : k + 1], of_byte, n[at])
            piece, k = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "k": k, "n": total[piece, k]})

        sums = counts.mapInPandas(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        found = np.full_like(logp, smooth)
        found[sums["piece"], sums["k"]] += sums["n"]
        logp = np.log(found / found.sum(axis=0))
        shared.unpersist()
    return Model(langs, logp, pieces, of_byte)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Null texts and those without a letter give ``und`` and 0.

    Only the text is looked at, the whole of it, however long. Of languages as likely the first by name is taken.
    Repeated rows get equal results, an empty table an empty one. Columns of ``docs`` with the two names are replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(shared.value.predict(series.tolist())), columns=["lang_pred", "score"])

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    predicted = F.pandas_udf(predict, kind)
    kept = docs.drop("lang_pred", "score")
    out = kept.withColumn("lang_pred", predicted(col(text)))
    return out.select(*[col(c) for c in kept.columns], F.col("lang_pred.score").alias("score"), F.col("lang_pred.lang_pred").alias("lang_pred"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def language_report(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents; learned from those not held out.

    A null doc_id is not held out. Other cases are as in ``identify``.
    """
    model = fit(documents.where(~held_out(F.col("doc_id"))))
    narrow = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(narrow, model).select("doc_id", "held_out", "lang_pred", "score")
