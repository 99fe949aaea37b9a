"""Parts of speech of words in their context: a hidden Markov model over word classes, decoded by Viterbi's recursion.

A word's class says which tags it may have: a lexicon's entry or the word's ending. Costs are whole numbers
(thousandths of a bit), so the cheapest sequence of tags is exact, and of equally cheap ones the least is taken. Words
with one possible tag cut a sequence into pieces that can be decoded by themselves (``pieces``, for fitting a model).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpuscle.session import ship

from .text import let

#: A letter a tag, in ASCII order.
TAGS = {"a": "JJ", "d": "VBD", "g": "VBG", "n": "NN", "p": "NNS", "r": "RB", "v": "VB", "z": "VBZ"}
LETTERS = "".join(TAGS)

#: Word classes by ending, in the order they are tried: a name, a pattern, weights of the tags a word may have.
ENDINGS = [
    ("A", "(tion|sion|ment|ness|ity|ism|ance|ence|ship|logy)$", {"n": 3}),
    ("B", "(tions|sions|ments|ities|isms|ances|ences|ships|logies)$", {"p": 3}),
    ("C", "(ous|ful|less|able|ible|ical)$", {"a": 3}),
    ("D", "(ive|al|ic|ary|ant|ent)$", {"a": 3, "n": 1}),
    ("E", "ly$", {"r": 3}),
    ("F", "ing$", {"g": 4, "n": 2, "a": 1}),
    ("G", "ed$", {"d": 4, "a": 2}),
    ("H", "(ize|ise|ify)$", {"v": 2}),
    ("I", "(izes|ises|ifies)$", {"z": 2}),
    ("J", "ate$", {"v": 2, "a": 1, "n": 1}),
    ("K", "(er|or)$", {"n": 3, "a": 1}),
    ("L", "est$", {"a": 2, "n": 1}),
    ("M", "(ss|us|is)$", {"n": 2}),
    ("N", "s$", {"p": 6, "z": 3}),
    ("O", "", {"n": 8, "a": 4, "v": 4}),
]
#: The seed lexicon: words whose ending misleads, by the tags they may have.
LEXICON = {
    "a": "new good many large small friendly whole",
    "ad": "left known given broken written hidden",
    "an": "red high low key",
    "anv": "open free present",
    "ar": "early daily likely better best first long deep much well",
    "d": "found made shown took wrote went saw built sent kept held led seen done became began grew chose ran",
    "n": "family assembly anomaly thing king string spring nothing bed news hundred problem system idea",
    "np": "series species",
    "nv": "need seed speed feed supply reply fly process use show work study test result focus support design",
    "nvz": "ring bring",
    "p": "data people children men women mice feet criteria phenomena hypotheses analyses",
    "r": "often never always also still yet even perhaps however therefore",
    "v": "apply rely learn make give take become include require improve achieve describe provide propose",
    "z": "uses shows becomes gives makes takes",
}

#: Weights of one tag after another where these are not 1; ``^`` stands before the first.
FOLLOWS = {
    "^": {"n": 3, "a": 3, "v": 2, "p": 2}, "a": {"n": 8, "p": 5, "a": 2}, "d": {"n": 3, "a": 3, "r": 2, "p": 2},
    "g": {"n": 4, "p": 3, "a": 2}, "n": {"n": 4, "p": 3, "z": 3, "d": 3}, "p": {"v": 4, "d": 3, "n": 2, "r": 2},
    "r": {"a": 4, "d": 3, "v": 3, "z": 2}, "v": {"n": 4, "a": 3, "p": 3, "r": 2}, "z": {"n": 4, "a": 3, "p": 2, "r": 2},
}

#: Irregular forms and their lemmas, by part of speech.
LEMMA_EXCEPTIONS = {
    "n": {
        "children": "child", "men": "man", "women": "woman", "mice": "mouse", "feet": "foot", "teeth": "tooth", "people": "person", "criteria": "criterion",
        "phenomena": "phenomenon", "hypotheses": "hypothesis", "analyses": "analysis", "indices": "index", "vertices": "vertex", "matrices": "matrix", "leaves": "leaf", "halves": "half",
    },
    "v": {
        "found": "find", "made": "make", "shown": "show", "took": "take", "taken": "take", "wrote": "write", "written": "write", "went": "go", "gone": "go", "saw": "see", "seen": "see", "built": "build",
        "sent": "send", "kept": "keep", "held": "hold", "led": "lead", "left": "leave", "done": "do", "became": "become", "began": "begin", "grew": "grow", "known": "know", "chose": "choose",
        "chosen": "choose", "ran": "run", "given": "give", "gave": "give", "thought": "think", "taught": "teach", "brought": "bring", "leaves": "leave",
    },
    "a": {"better": "good", "best": "good", "worse": "bad", "worst": "bad"},
    "r": {"better": "well", "best": "well", "worse": "badly", "worst": "badly"},
}

#: The lexicon's classes: a letter for each set of tags.
SETS = {chr(ord("a") + i): tags for i, tags in enumerate(sorted(LEXICON))}
WORDS = {word: code for code, tags in SETS.items() for word in LEXICON[tags].split()}
CLASSES = {code: {t: 1.0 for t in tags} for code, tags in SETS.items()} | {code: dict(weights) for code, _, weights in ENDINGS}
#: Classes of words that may have one tag only.
SURE = "".join(code for code, tags in CLASSES.items() if len(tags) == 1)


def class_of(word: Column) -> Column:
    """The letter of a word's class."""
    by_ending = F.lit(ENDINGS[-1][0])
    for code, pattern, _ in reversed(ENDINGS[:-1]):
        by_ending = F.when(word.rlike(pattern), code).otherwise(by_ending)
    known = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    return F.when(word.isin(list(WORDS)), F.element_at(known, word)).otherwise(by_ending)  # a set is faster than a map


def pieces(terms: Column) -> Column:
    """The classes of a sequence of words, cut behind each that is sure, with the class before each piece (``^``: none) in front."""
    codes = F.array_join(F.transform(terms, class_of), "")
    cut = F.filter(F.split(codes, f"(?<=[{SURE}])"), lambda p: p != "")
    return let(cut, lambda own: F.transform(own, lambda p, i: F.concat(F.when(i == 0, "^").otherwise(F.right(F.get(own, i - 1), F.lit(1))), p)))


def _cost(share: float) -> int:
    return round(-1000 * math.log2(share))


@dataclass(frozen=True)
class Tagger:
    """Costs of a tag after another (``follows[before][tag]``, before is ``^`` at the start) and of a class given a tag.

    An instance tags a column of words: ``tagger(terms)`` is an array of Penn tags, one a word.
    """

    follows: tuple[tuple[str, tuple[int, ...]], ...]
    emits: tuple[tuple[str, tuple[tuple[str, int], ...]], ...]

    @classmethod
    def of(cls, follows: dict[str, dict[str, float]], emits: dict[str, dict[str, float]]) -> Tagger:
        """From weights ``follows[before][tag]`` and ``emits[class][tag]``, all above 0."""
        rows = []
        for before in "^" + LETTERS:
            total = sum(follows[before].values())
            rows.append((before, tuple(_cost(follows[before][t] / total) for t in LETTERS)))
        totals = {t: sum(own.get(t, 0.0) for own in emits.values()) for t in LETTERS}
        return cls(tuple(rows), tuple((code, tuple((t, _cost(w / totals[t])) for t, w in sorted(own.items()))) for code, own in sorted(emits.items())))

    def __call__(self, terms: Column) -> Column:
        if spark := SparkSession.getActiveSession():
            ship(spark)
        return F.arrow_udf(self.tags, "array<string>")(terms)

    def tags(self, terms: pa.Array) -> pa.Array:
        """The tags of lists of words, null where a list is."""
        ends = np.cumsum(pc.fill_null(terms.value_lengths(), 0).to_numpy(zero_copy_only=False))
        codes, start, begin, letters = _classes(terms.flatten()).tobytes(), _start(self), 0, bytearray()
        for end in ends.tolist():
            ways, path = start, []
            for code in codes[begin:end]:
                ways = ways[code]
                path.append(ways)
            t, own = ways.best, bytearray()
            for ways in reversed(path):
                own.append(t)
                t = ways.back[t]
            own.reverse()
            letters += own
            begin = end
        if len(start.known) > KNOWN_WAYS:
            _start.cache_clear()
        names = pa.array(list(TAGS.values())).take(pa.array(np.frombuffer(letters, np.uint8)))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), names, mask=terms.is_null())


#: States of the recursion that a process keeps between batches.
KNOWN_WAYS = 200_000


class _Ways(dict):
    """A state of Viterbi's recursion: by class of the next word (ASCII), the state after it, made when first asked for.

    ``ways``: the last tag and the cost of the cheapest way to each tag that the word may have, less the least such cost, in the
    order of the ways' letters. ``back``: of each of these tags the one before. So equal states are met again and
    again, and a word takes a look into a table instead of a comparison of costs.
    """

    def __init__(self, model: tuple[dict, dict], known: dict, ways: tuple[tuple[int, int], ...], back: tuple[int, ...]):
        super().__init__()
        self.model, self.known, self.ways, self.back = model, known, ways, back
        self.best = min(ways, key=lambda w: w[1])[0]  # the first of equally cheap ones

    def __missing__(self, code: int) -> _Ways:
        follows, emits = self.model
        made, back = [], [0] * len(LETTERS)
        for t, cost in emits[code]:
            reach = [c + follows[before][t] for before, c in self.ways]
            place = reach.index(min(reach))
            made.append((place, t, reach[place] + cost))
            back[t] = self.ways[place][0]
        least = min(cost for _, _, cost in made)
        key = tuple((t, cost - least) for _, t, cost in sorted(made)), tuple(back)
        if key not in self.known:
            self.known[key] = _Ways(self.model, self.known, *key)
        self[code] = self.known[key]
        return self[code]


@lru_cache(maxsize=4)
def _start(tagger: Tagger) -> _Ways:
    """The state before the first word; tags are their places in LETTERS, and -1 at the start."""
    follows = {LETTERS.find(before): own for before, own in tagger.follows}
    emits = {ord(code): [(LETTERS.index(t), cost) for t, cost in own] for code, own in tagger.emits}
    return _Ways((follows, emits), {}, ((-1, 0),), ())


def _classes(words: pa.Array) -> np.ndarray:
    """As ``class_of``, in ASCII (uint8); found once a distinct word."""
    coded = pc.fill_null(words, "").dictionary_encode()
    own = coded.dictionary
    codes = np.full(len(own), ord(ENDINGS[-1][0]), np.uint8)
    at = pc.index_in(own, value_set=pa.array(list(WORDS)))
    known = at.is_valid().to_numpy(zero_copy_only=False)
    codes[known] = np.frombuffer("".join(WORDS.values()).encode(), np.uint8)[at.drop_null().to_numpy()]
    left = np.flatnonzero(~known)
    for code, pattern, _ in ENDINGS[:-1]:
        found = pc.match_substring_regex(own.take(pa.array(left)), pattern).to_numpy(zero_copy_only=False)
        codes[left[found]] = ord(code)
        left = left[~found]
    return codes[coded.indices.to_numpy()]


def seed_weights() -> tuple[dict[str, dict[str, float]], dict[str, dict[str, float]]]:
    """The model before it has seen a corpus: of transitions, and of classes by tag."""
    follows = {before: {t: float(FOLLOWS[before].get(t, 1)) for t in LETTERS} for before in "^" + LETTERS}
    return follows, {code: {t: float(w) for t, w in own.items()} for code, own in CLASSES.items()}


SEED = Tagger.of(*seed_weights())
