"""TF-IDF in long form: (doc_id, term, weight), never a dense matrix; counts are kept packed, a row a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.functions.tagging import LEMMA_EXCEPTIONS
from corpuscle.session import drop, ship, written

#: Of a text column: its terms in order, an array of strings.
Tokeniser = Callable[[Column], Column]
#: Of a column of terms in order: their Penn tags, an array as long (``tagging.Tagger``, or any other).
SequenceTagger = Callable[[Column], Column]


def tokens_long(
    docs: DataFrame, text: str = "text", key: str = "doc_id", ngram_range: tuple[int, int] = (1, 1), stop_words: list[str] | None = None, tokenise: Tokeniser | None = None, tag: SequenceTagger | None = None
) -> DataFrame:
    """``(doc_id, pos, term)``, positions counted after filtering. ``tokenise`` takes the place of ``text.tokens``.

    With ``tag`` also each term's tag in the sequence of all; no n-grams then.
    """
    rows = cut(docs, text, key, stop_words, tokenise, tag)
    if tag is not None:
        return exploded(rows, F.col("terms"), "t").select("doc_id", "pos", "t.term", "t.tag")
    if ngram_range != (1, 1):
        rows = rows.select("doc_id", X.ngrams(F.col("terms"), *ngram_range).alias("terms"))
    return exploded(rows, F.col("terms"), "term")


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", stop_words: list[str] | None = None, tokenise: Tokeniser | None = None, tag: SequenceTagger | None = None) -> DataFrame:
    """``(doc_id, terms)``: each text's terms in order; with ``tag`` structs of term and tag."""
    terms = X.tokens(F.col(text), stop_words) if tokenise is None else tokenise(F.col(text))
    rows = docs.select(F.col(key).alias("doc_id"), terms.alias("terms"))
    if tag is None:
        return rows
    both = F.zip_with("terms", "tags", lambda t, p: F.struct(t.alias("term"), p.alias("tag")))
    return rows.select("doc_id", "terms", tag(F.col("terms")).alias("tags")).select("doc_id", both.alias("terms"))


def exploded(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """``(doc_id, pos, name)``: a row a value. The outer form, as Spark would compute ``values`` twice to skip empty ones."""
    return rows.select("doc_id", F.posexplode_outer(values).alias("pos", name)).where("pos is not null")


def lemmas(tokens: DataFrame, known_terms: DataFrame | None = None, tag: Tokeniser | None = None) -> DataFrame:
    """``tokens`` with terms replaced by the first base form, by suffix rules, that the corpus itself holds.

    ``known_terms``: the corpus' distinct terms, where ``tokens`` are of queries. Only the rules of a part of speech are
    tried if ``tokens`` have a column ``tag``, each term's Penn tag in its context, which also finds irregular forms by a
    table; or with ``tag``: of the term column, a tag that a word has everywhere (``text.penn_tag``).
    """
    by = ["term", "tag"] if "tag" in tokens.columns else ["term"]
    vocabulary = tokens.select(*by).distinct()
    found = tokens.join(lemma_forms(vocabulary, known_terms, tag), by, "left")
    return found.withColumn("term", F.coalesce("lemma", "term")).select(*[c for c in tokens.columns if c != "tag"])


def lemma_forms(vocabulary: DataFrame, known_terms: DataFrame | None = None, tag: Tokeniser | None = None) -> DataFrame:
    """``vocabulary``, distinct terms or terms and tags, with ``lemma``: those that have one, as ``lemmas`` replaces them.

    ``rule``: the place in LEMMA_RULES of the rule that makes it, null for irregular forms.
    """
    by, context = vocabulary.columns, "tag" in vocabulary.columns
    bases = (vocabulary if known_terms is None else known_terms).select(F.col("term").alias("base")).distinct()
    pos = X.wordnet_pos(F.col("tag")) if context else None if tag is None else X.wordnet_pos(tag(F.col("term")))

    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(suffix).alias("suffix"), F.lit(base).alias("base"), F.lit(X.LEMMA_POS.get(suffix, "nv")).alias("of")) for i, (suffix, base) in enumerate(X.LEMMA_RULES)])

    def may(r: Column) -> Column:
        fits = F.col("term").endswith(r["suffix"]) & (F.length("term") > F.length(r["suffix"]) + 2)
        return fits if pos is None else fits & r["of"].contains(F.col("pos"))

    def form(r: Column) -> Column:
        return F.struct(r["rule"].alias("rule"), F.concat(F.substr("term", F.lit(1), F.length("term") - F.length(r["suffix"])), r["base"]).alias("base"))

    asked = vocabulary if pos is None else vocabulary.withColumn("pos", pos)
    tried = asked.select(*by, F.explode_outer(F.transform(F.filter(rules, may), form)).alias("f")).select(*by, "f.rule", "f.base").where("base is not null")
    chosen = tried.join(bases, "base", "left_semi").groupBy(*by).agg(F.min("rule").alias("rule"))
    used = F.get(rules, F.col("rule"))
    chosen = chosen.withColumn("lemma", F.concat(F.substr("term", F.lit(1), F.length("term") - F.length(used["suffix"])), used["base"]))
    if not context:
        return chosen
    irregular = F.create_map(*[F.lit(x) for of, forms in LEMMA_EXCEPTIONS.items() for word, lemma in forms.items() for x in (f"{of}/{word}", lemma)])
    own = F.try_element_at(irregular, F.concat(pos, F.lit("/"), "term"))
    every = vocabulary.join(chosen, by, "left").select(*by, F.when(own.isNull(), F.col("rule")).alias("rule"), F.coalesce(own, "lemma").alias("lemma"))
    return every.where("lemma is not null")


def term_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def lemma_frequency(tokens: DataFrame, tag: Tokeniser | None = None) -> DataFrame:
    """``(term, cnt)`` of the lemmas of ``tokens``, rows or ``term_frequency`` of them: forms are looked up once a term (and tag)."""
    by = ["term", "tag"] if "tag" in tokens.columns else ["term"]
    counted = written(tokens if "cnt" in tokens.columns else tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt")), "frequency")
    return lemmas(counted, tag=tag).groupBy("term").agg(F.sum("cnt").alias("cnt"))


def vocabulary(tokens: DataFrame, min_count: int = 2) -> DataFrame:
    return term_frequency(tokens).where(F.col("cnt") >= min_count)


def top_terms(tokens: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent terms, ties by term. ``tokens``: rows, or counts ``(doc_id, term, tf)`` of them."""
    frequency = tokens.groupBy("term").agg(F.sum("tf").alias("cnt")) if "tf" in tokens.columns else term_frequency(tokens)
    return frequency.orderBy(F.desc("cnt"), "term").limit(n)


def doc_term_counts(tokens: DataFrame) -> DataFrame:
    """How often a document has each term; of tagged tokens, each term and tag."""
    return tokens.groupBy("doc_id", "term", *[c for c in ["tag"] if c in tokens.columns]).agg(F.count(F.lit(1)).alias("tf"))


#: Terms with their IDF, and norms, are broadcast up to so many rows; beyond, the rare terms alone are joined by shuffle.
WIDE_ROWS = 500_000
#: All tasks are told so many lemma forms, nine bytes each; beyond, terms and forms are joined by shuffle.
FORM_ROWS = 8_000_000
#: Terms that a task holds while it counts them.
HELD_TERMS = 500_000
#: All tasks are told the IDF of so many terms, sixteen bytes each, for norms; beyond, norms are grouped by shuffle.
TOLD_ROWS = 8_000_000


def _grams(flat: pa.Array, row: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """The space-joined runs of ``n`` values that lie in one row, and their rows."""
    if n == 1 or len(flat) < n:
        return (flat, row) if n == 1 else (flat.slice(0, 0), row[:0])
    many = len(flat) - n + 1
    whole = row[:many] == row[n - 1 :]
    joined = pc.binary_join_element_wise(*[flat.slice(i, many) for i in range(n)], " ", null_handling="skip")
    return joined.filter(pa.array(whole)), row[:many][whole]


def packed_counts(rows: DataFrame, ngram_range: tuple[int, int] = (1, 1), forms: DataFrame | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """``(doc_id, own)`` of ``(doc_id, terms)``: how often each row has each of its n-grams, as structs of term and tf.

    Terms are counted where their row lies, a batch at a time, so none is shuffled. Rows of one ``doc_id`` stay apart.
    Of ``(doc_id, text)`` texts are cut there, too, as ``text.tokens`` does with ``stop_words``. Of packed counts ``(doc_id, own)``
    terms are looked up and added up again.
    ``forms``, of FORM_ROWS at most, are those of ``lemma_forms``, which all tasks are told by the hash of their term (and tag)
    and their rule: n-grams are made of lemmas. No two terms have one hash (``hashes_apart``).
    """
    kept = next(c for c in ("terms", "own", "text") if c in rows.columns)
    told, columns = None, ["doc_id", kept]
    if forms is not None:
        tagged = "tag" in forms.columns
        table = forms.select(_hash(*[F.col(c) for c in forms.columns if c in ("term", "tag")]).alias("h"), F.coalesce("rule", F.lit(IRREGULAR)).cast("tinyint").alias("rule")).toArrow()
        h = table["h"].to_numpy()
        order = np.argsort(h)
        told = rows.sparkSession.sparkContext.broadcast((h[order], table["rule"].to_numpy()[order]))
        keys = F.transform(kept, lambda t: _hash(t["term"], t["tag"]) if tagged else _hash(t["term"] if kept == "own" else t))
        rows, columns = rows.select(*columns, keys.alias("keys")), [*columns, "keys"]

    def based(flat: pa.Array, keys: np.ndarray) -> pa.Array:
        """The lemmas of terms, made once a distinct term."""
        hashes, rules = told.value
        _, first, ids = np.unique(keys, return_index=True, return_inverse=True)
        own = flat.take(pa.array(first))
        tags, keys = own.field("tag").to_pylist() if tagged else None, keys[first]
        out = (own.field("term") if tagged else own).to_pylist()
        at = np.searchsorted(hashes, keys)
        found = np.flatnonzero(at < len(hashes))
        found = found[hashes[at[found]] == keys[found]]
        for i, rule in zip(found.tolist(), rules[at[found]].tolist(), strict=True):
            if rule == IRREGULAR:
                out[i] = LEMMA_EXCEPTIONS[{"J": "a", "V": "v", "R": "r"}.get(tags[i][:1], "n")][out[i]]
            else:
                suffix, base = X.LEMMA_RULES[rule]
                out[i] = out[i][: len(out[i]) - len(suffix)] + base
        return pa.array(out, pa.string()).take(pa.array(ids))

    ship(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            lists, n = got.column(1), got.num_rows
            lists = X.content_words(lists, stop_words) if kept == "text" else lists
            flat, row = lists.flatten(), np.repeat(np.arange(n), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
            flat, times = (flat.field("term"), flat.field("tf").to_numpy()) if kept == "own" else (flat, None)
            flat = flat if told is None else based(flat, got.column("keys").flatten().to_numpy())
            parts = [_grams(flat, row, size) for size in range(ngram_range[0], ngram_range[1] + 1)]
            coded = pa.concat_arrays([g for g, _ in parts]).dictionary_encode(null_encoding="encode")
            width = max(1, len(coded.dictionary))
            places = np.concatenate([r for _, r in parts]) * width + coded.indices.to_numpy(zero_copy_only=False)
            found, at, tf = np.unique(places, return_inverse=True, return_counts=True)
            tf = tf if times is None else np.bincount(at, times, len(found)).astype(np.int64)
            own = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(found % width)), pa.array(tf, pa.int64())], ["term", "tf"])
            starts = np.searchsorted(found // width, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([got.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), own)], ["doc_id", "own"])

    return rows.select(*columns).mapInArrow(run, f"doc_id {kind}, own array<struct<term:string,tf:bigint>>")


#: Stands for a form that no rule makes.
IRREGULAR = 127


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def hashes_apart(vocabulary: DataFrame) -> bool:
    """Whether no two rows of a vocabulary (terms, or terms and tags) have one hash, so that these can stand for them."""
    hashed = vocabulary.groupBy(_hash(*[F.col(c) for c in vocabulary.columns]).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return hashed.where("n > 1").isEmpty()


def text_frequency(docs: DataFrame, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """``term_frequency`` of the tokens of texts, counted where these are cut.

    A task adds up its batches' counts, up to HELD_TERMS terms, before any is shuffled.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for got in batches:
            found = pc.value_counts(X.content_words(got.column(0), stop_words).flatten())
            held.append(pa.table({"term": found.field(0), "n": found.field(1)}))
            size += len(found)
            if size > HELD_TERMS:
                held = [_added(held)]
                size = len(held[0])
                if 2 * size > HELD_TERMS:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from _added(held).to_batches()

    return docs.select(text).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("cnt"))


def _added(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])


def packed(counts: DataFrame) -> DataFrame:
    """``(doc_id, own)``, a row a document, of counts ``(doc_id, term, tf)``, which are summed."""
    summed = counts.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return summed.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("own"))


def unpacked(own: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)`` of packed counts."""
    return own.select("doc_id", F.explode("own").alias("o")).select("doc_id", "o.term", "o.tf")


def _one_row_a_document(own: DataFrame) -> DataFrame:
    """Packed counts as they are, or, where a ``doc_id`` has several texts, their sums."""
    if own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return own
    return written(packed(unpacked(own)).unionByName(own.where(F.size("own") == 0)), "counts")


def weighed(counts: DataFrame, terms: DataFrame, sublinear: bool = True) -> DataFrame:
    """``(doc_id, term, w)`` of counts by a table ``(term, df, idf)``.

    A larger vocabulary than WIDE_ROWS is parted by document frequency: its frequent terms are broadcast, and only
    the counts of the others, which are few, are joined by shuffle.
    """
    idf, w = terms.select("term", "idf"), (tf_column(sublinear) * F.col("idf")).alias("w")
    if terms.count() <= WIDE_ROWS:
        return counts.join(F.broadcast(idf), "term").select("doc_id", "term", w)
    left, least = WIDE_ROWS, 0  # of different frequencies there are few: their squares sum up to less than all counts
    for df, n in terms.groupBy("df").count().orderBy(F.desc("df")).collect():
        left -= n
        if left < 0:
            least = df
            break
    often, rare = terms.where(F.col("df") > least).select("term", "idf"), terms.where(F.col("df") <= least).select("term", "idf")
    found = counts.join(F.broadcast(often), "term").select("doc_id", "term", w)
    rest = counts.join(F.broadcast(often.select("term")), "term", "left_anti").join(rare, "term").select("doc_id", "term", w)
    return found.unionByName(rest)


def idf_column(n_docs: int) -> Column:
    return F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0


def idf_table(counts: DataFrame, n_docs: int) -> DataFrame:
    """``(term, df, idf)`` with idf = ln((1 + N) / (1 + df)) + 1."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf_column(n_docs))


def tf_column(sublinear: bool) -> Column:
    return 1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")


@dataclass
class LexicalIndex:
    """A fitted TF-IDF: corpus ``(doc_id, text)``, terms ``(term, df, idf)``, weights ``(doc_id, term, w)``, norms ``(doc_id, norm)``.

    ``counts``: (doc_id, term, tf) of all terms; ``whole``: all of them are in ``terms``. With ``lemmatise``, ``vocabulary`` has the corpus' terms before that, by
    which query words are lemmatised. Queries are cut into terms as the corpus was. ``made``: the index' tables.
    """

    corpus: DataFrame
    terms: DataFrame
    weights: DataFrame
    norms: DataFrame
    sublinear: bool = True
    ngram_range: tuple[int, int] = (1, 1)
    lemmatise: bool = False
    vocabulary: DataFrame | None = None
    counts: DataFrame | None = None
    stop_words: list[str] | None = None
    tokenise: Tokeniser | None = None
    tag: SequenceTagger | None = None
    packed: DataFrame | None = None
    n_docs: int | None = None
    whole: bool = True
    made: list[DataFrame] = field(default_factory=list)

    def tokens(self, rows: DataFrame, text: str, key: str, grams: bool = True) -> DataFrame:
        """``(doc_id, pos, term)`` of texts of the corpus or of queries, cut and lemmatised as the index' terms; n-grams if ``grams``."""
        ngram_range = self.ngram_range if grams else (1, 1)
        if self.lemmatise:
            return lemma_tokens(rows, text, key, ngram_range, self.vocabulary, self.stop_words, self.tokenise, self.tag)
        return tokens_long(rows, text, key, ngram_range, self.stop_words, self.tokenise)

    def drop(self) -> None:
        """Deletes the index' tables, once all that is still to be read from them has been written itself."""
        drop(*self.made)


def lemma_tokens(rows: DataFrame, text: str, key: str, ngram_range: tuple[int, int], known_terms: DataFrame | None = None, stop_words: list[str] | None = None, tokenise: Tokeniser | None = None, tag: SequenceTagger | None = None) -> DataFrame:
    """``tokens_long`` over lemmas: n-grams are made of these."""
    return lemma_grams(lemmas(tokens_long(rows, text, key, (1, 1), stop_words, tokenise, tag), known_terms), ngram_range)


def lemma_grams(tokens: DataFrame, ngram_range: tuple[int, int]) -> DataFrame:
    """``tokens`` made into n-grams, in the order of their positions."""
    if ngram_range == (1, 1):
        return tokens
    again = tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
    return again.select("doc_id", F.posexplode(X.ngrams(F.col("terms"), *ngram_range)).alias("pos", "term"))


def fit(
    corpus: DataFrame,
    sublinear: bool = True,
    ngram_range: tuple[int, int] = (1, 1),
    max_features: int | None = None,
    lemmatise: bool = False,
    n_docs: int | None = None,
    stop_words: list[str] | None = None,
    tokenise: Tokeniser | None = None,
    counts: DataFrame | None = None,
    tag: SequenceTagger | None = None,
    terms: DataFrame | None = None,
) -> LexicalIndex:
    """The index over ``(doc_id, text)``. The corpus is cut into terms once; their counts are a table in the shared folder.

    ``counts``: those of another index over the same corpus and terms, to be used again. ``tag``: with ``lemmatise``, the
    tagger by whose tags, in context, words of corpus and queries are lemmatised. ``terms``: the corpus as ``cut`` gives
    it, where several indexes are made of it.
    """
    known, made, own = None, [], None
    if counts is None:
        own, known, n, made = counted(corpus, ngram_range, lemmatise, stop_words, tokenise, tag, terms)
        n_docs = n if n_docs is None else n_docs
        counts = unpacked(own)
    used = counts
    if max_features is not None:
        used = counts.join(top_terms(counts, max_features).select("term"), "term", "left_semi")
    n_docs = corpus.count() if n_docs is None else n_docs
    table = written(idf_table(used, n_docs), "terms")
    made.append(table)
    weights = weighed(used, table, sublinear)
    return LexicalIndex(corpus, table, weights, _norms(weights), sublinear, ngram_range, lemmatise, known, counts, stop_words, tokenise, tag, own, n_docs, max_features is None, made)


def counted(
    corpus: DataFrame, ngram_range: tuple[int, int] = (1, 1), lemmatise: bool = False, stop_words: list[str] | None = None, tokenise: Tokeniser | None = None, tag: SequenceTagger | None = None, terms: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, int, list[DataFrame]]:
    """Packed counts, a row a document, the vocabulary before lemmas were looked up, the number of rows, and the tables made; arguments as of ``fit``."""
    known, made, forms = None, [], None
    alone = lemmatise and tag is None and ngram_range == (1, 1)  # counts of words give those of lemmas
    if terms is None:
        plain = tokenise is None and (alone or not lemmatise)
        terms = corpus.select("doc_id", "text") if plain else cut(corpus, "text", "doc_id", stop_words, tokenise, tag)
    if lemmatise:
        terms = written(packed_counts(terms, stop_words=stop_words) if alone else terms, "cut")
        words = unpacked(terms).select("term") if alone else terms.select(F.explode("terms").alias("term"))
        known = written((words if tag is None else words.select("term.term", "term.tag")).distinct(), "vocabulary")
        forms = written(lemma_forms(known), "forms")
        made += [terms, known, forms]
    if forms is None or (forms.count() <= FORM_ROWS and hashes_apart(known)):
        rows = written(packed_counts(terms, ngram_range, forms, stop_words), "counts")
    else:
        if alone:
            counts = lemma_grams(lemmas(unpacked(terms)), ngram_range)
        else:
            said = terms.select("doc_id", F.posexplode("terms").alias("pos", "term"))
            counts = doc_term_counts(lemma_grams(lemmas(said if tag is None else said.select("doc_id", "pos", "term.term", "term.tag")), ngram_range))
        none = terms.where(F.size("own" if alone else "terms") == 0).select("doc_id", F.array().cast("array<struct<term:string,tf:bigint>>").alias("own"))
        rows = written(packed(counts).unionByName(none), "counts")
    made.append(rows)
    own = _one_row_a_document(rows)
    return own, known, (terms if lemmatise else rows).count(), made + ([] if own is rows else [own])


def _norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def reweighted(index: LexicalIndex, sublinear: bool) -> LexicalIndex:
    """The index by other weights of the same counts and terms."""
    weights = weighed(index.counts, index.terms, sublinear)  # terms left out of the features are in no table of terms
    return replace(index, weights=weights, norms=_norms(weights), sublinear=sublinear, made=[])


def query_weights(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, term, qw)`` of ``(query_id, query)``; unknown terms vanish, nothing is fitted anew."""
    return _asked(index, queries).drop("idf")


def _asked(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    counts = doc_term_counts(index.tokens(queries, "query", "query_id")).withColumnRenamed("doc_id", "query_id")
    return counts.join(index.terms, "term").select("query_id", "term", (tf_column(index.sublinear) * F.col("idf")).alias("qw"), "idf")


#: Weights of queries are rows of the plan, and no table, up to so many.
LITERAL_ROWS = 2_000
#: Query terms and norms are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def score(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)`` of all pairs that share a term; others score 0. Rounded to six decimals.

    The weights of a few queries become rows of the plan; others a table in the shared folder, whose rows are counted before
    they are broadcast.
    """
    q = query_weights(index, queries)
    some = q.limit(LITERAL_ROWS + 1).collect()
    q = q.sparkSession.createDataFrame(some, q.schema) if len(some) <= LITERAL_ROWS else written(q, "query-weights")
    norms = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    small = F.broadcast if len(some) <= LITERAL_ROWS or q.count() <= BROADCAST_ROWS else lambda df: df
    products = index.weights.join(small(q), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    lengths = products.join(small(norms), "query_id").join(index.norms, "doc_id")
    return lengths.select("query_id", "doc_id", F.round(F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("qnorm")), F.lit(0.0)), 6).alias("score"))


def search(index: LexicalIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: min(k, documents) rows a query, score descending, then doc_id.

    Documents without a shared term score 0. Only the k smallest ids can fill a result up, as no score is negative.
    """
    scored = score(index, queries) if index.packed is None else best(index, queries, k)
    fill = (index.corpus if index.packed is None else index.packed).select("doc_id").orderBy("doc_id").limit(k)
    zeros = queries.select("query_id").join(F.broadcast(fill), how="cross").withColumn("score", F.lit(0.0))  # k rows
    both = scored.unionByName(zeros).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return rank(both, k)


#: Queries are told to all tasks as a matrix, terms by queries, of up to so many numbers (32 MB); beyond, see ``score``.
MATRIX = 4_000_000
#: Numbers of one product of documents' weights and the matrix.
PRODUCT = 1 << 20


def best(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id, score)`` as ``score`` gives them, but of each task's documents only the k best of every query.

    Documents are packed rows, which meet the queries' matrix one batch at a time: no pair of query and document is
    shuffled but the best. Scores of 0 are left out.
    """
    asked = written(_asked(index, queries), "query-weights")
    told = asked.limit(BROADCAST_ROWS + 1).toArrow()
    words, names = told["term"].combine_chunks().dictionary_encode(), told["query_id"].combine_chunks().dictionary_encode()
    n_words, n_names = len(words.dictionary), len(names.dictionary)
    if told.num_rows > BROADCAST_ROWS or n_words * n_names > MATRIX:
        return score(index, queries)
    matrix, qw = np.zeros((n_words, n_names)), told["qw"].to_numpy()
    w, q = (x.indices.to_numpy(zero_copy_only=False) for x in (words, names))
    matrix[w, q] = qw * told["idf"].to_numpy()
    lengths = np.sqrt(np.bincount(q, qw * qw, n_names))
    shared = queries.sparkSession.sparkContext.broadcast((matrix, lengths, words.dictionary, names.dictionary))
    told = _told_weights(index)
    sublinear, most = index.sublinear, max(1, PRODUCT // max(1, n_names))
    ship(queries.sparkSession)

    def lengths_of(weight: np.ndarray, row: np.ndarray, got: pa.RecordBatch) -> np.ndarray:
        """The norms of a batch's rows."""
        hashes, idf, other = told.value
        keys, ids = np.unique(got.column("keys").flatten().to_numpy(), return_inverse=True)
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        w = weight * np.where(hashes[at] == keys, idf[at], other)[ids]
        return np.sqrt(np.bincount(row, w * w, got.num_rows))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, lengths, words, names = shared.value
        floor, held, kind = np.zeros(len(names)), [], None

        def kept() -> list[np.ndarray]:
            """The k best of every query so far, ties to smaller ids."""
            q, ids, scores = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            floor[q[last]] = scores[last]
            return [q[place < k], ids[place < k], scores[place < k]]

        for got in batches:
            own, kind = got.column("own"), got.column("doc_id").type
            flat, row = own.flatten(), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
            at = pc.index_in(flat.field("term"), value_set=words)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            if not hit.any():
                continue
            tf = flat.field("tf").to_numpy()
            weight = 1.0 + np.log(tf) if sublinear else tf.astype(np.float64)
            norm = got.column("norm").to_numpy() if told is None else lengths_of(weight, row, got)
            at, row = at.drop_null().to_numpy(), row[hit]
            w = weight[hit]
            rows, starts = np.unique(row, return_index=True)
            ends, ids = np.append(starts, len(row)), np.asarray(got.column("doc_id").to_pylist())
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
                a, b = ends[i], ends[j]
                dots = np.add.reduceat(matrix[at[a:b]] * w[a:b, None], starts[i:j] - a, axis=0)
                scores = np.round(dots / (norm[rows[i:j]][:, None] * lengths), 6)
                least = np.partition(scores, max(0, len(scores) - k), axis=0)[max(0, len(scores) - k)]
                d, q = np.nonzero((scores >= np.maximum(least, floor)) & (scores > 0))
                held.append([q, ids[rows[i:j]][d], scores[d, q]])
                i = j
            if sum(len(x[0]) for x in held) > 8 * k * len(names):
                held = [kept()]
        if held:
            q, ids, scores = kept()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids.tolist(), kind), pa.array(scores)], ["query_id", "doc_id", "score"])

    kinds = ", ".join(f"{c} {f.schema[c].dataType.simpleString()}" for c, f in (("query_id", queries), ("doc_id", index.packed)))
    if told is not None:
        rows = index.packed.where("doc_id is not null").select("doc_id", "own", F.transform("own", lambda o: _hash(o["term"])).alias("keys"))
        return rows.mapInArrow(near, f"{kinds}, score double")
    norms = written(index.norms, "norms")
    few = F.broadcast(norms) if norms.count() <= WIDE_ROWS else norms
    return index.packed.join(few, "doc_id").select("doc_id", "own", "norm").mapInArrow(near, f"{kinds}, score double")


def _told_weights(index: LexicalIndex) -> Broadcast | None:
    """Hashes of terms in order, their IDF, and the IDF of any other term; None where terms are too many or two have one hash.

    A term that a document has, and that is not among those of several documents, is in one only: of a whole index the
    terms of one document, most of the vocabulary, need not be told. Others than those of a part weigh nothing.
    """
    terms = index.terms.where("df > 1") if index.whole else index.terms
    n = terms.count()
    if not 0 < n <= TOLD_ROWS or not hashes_apart(index.terms.select("term")):
        return None
    table = terms.select(_hash(F.col("term")).alias("h"), "idf").toArrow()
    once = index.terms.where("df = 1").select("idf").first() if index.whole else None
    h = table["h"].to_numpy()
    order = np.argsort(h)
    return index.terms.sparkSession.sparkContext.broadcast((h[order], table["idf"].to_numpy()[order], once["idf"] if once else 0.0))


def rank(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each ``by`` (query_id where none is given)."""
    order = Window.partitionBy(*(by or ("query_id",))).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalised(index: LexicalIndex) -> DataFrame:
    """``(doc_id, term, weight)``: weights over their document's norm, to six decimals.

    Weights are computed and dealt by document once, where norms joined to them would need both twice.
    """
    w = F.col("w")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy("doc_id")))
    return index.weights.where("doc_id is not null").select("doc_id", "term", F.round(w / norm, 6).alias("weight"))


def doc_top_terms(index: LexicalIndex, n: int = 10) -> DataFrame:
    """Each document's ``n`` heaviest terms, by normalised weight."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return normalised(index).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def idf_extremes(terms: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` terms of the lowest and of the highest IDF, ties by term."""
    t = terms.select("term", "df", F.round("idf", 6).alias("idf"))
    low = t.orderBy("idf", "term").limit(n).withColumn("side", F.lit("lowest"))
    return low.unionByName(t.orderBy(F.desc("idf"), "term").limit(n).withColumn("side", F.lit("highest")))


def density(index: LexicalIndex, n_docs: int) -> DataFrame:
    """Stored weights, vocabulary and the share of the matrix that is not 0, in percent."""
    terms = index.terms.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("df").alias("nnz"))
    return terms.select("nnz", F.lit(n_docs).cast("long").alias("n_docs"), "vocabulary", F.round(100 * F.try_divide(F.col("nnz"), F.lit(n_docs) * F.col("vocabulary")), 6).alias("density_pct"))


def dense_rows(index: LexicalIndex) -> DataFrame:
    """``(doc_id, vector)``: rows of weights as arrays, in the order of the terms; for small vocabularies.

    Raises ValueError beyond DENSE_TERMS terms, where a row is too long to be held.
    """
    names = [r[0] for r in index.terms.select("term").orderBy("term").limit(DENSE_TERMS + 1).collect()]
    if len(names) > DENSE_TERMS:
        raise ValueError(f"more than {DENSE_TERMS} terms")
    own = index.weights.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("m"))
    of = F.transform(F.array(*map(F.lit, names)).cast("array<string>"), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0)))
    return index.corpus.select("doc_id").join(own, "doc_id", "left").select("doc_id", of.alias("vector"))


#: Terms of a matrix that may be made dense.
DENSE_TERMS = 20_000
