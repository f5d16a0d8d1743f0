"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton after folding.

Folding maps look-alike letters of other scripts, digits and signs used as letters, and marks and
width variants to plain lower-case letters; letters that one sign can stand for (i, l, 1, !) fold to
one. Text and lexicon are folded alike, so any spelling of a word finds it.

The lexicon is learned from labelled rows: every folded word, or beginning of words, that toxic rows hold far
oftener than others. A weight is a log ratio of document shares. A phrase of a lexicon word and its neighbour
that mostly occurs in rows that are not toxic becomes an exception and takes the weight back. Counts
run over all labelled rows; only words over the support threshold, whose number is bounded by
total words / threshold and by ``MAX_WORDS``, reach the driver.

A row's figure is log(1 + 100 x weights / (words + ``SMOOTH``)), its score a logistic curve of it.

Defined cases: null and empty texts have no match and the score of that; repeated rows score alike; no
labels give a flat score; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusmap.llm.calibrate import fit_logistic, logistic

#: A word needs so many toxic rows, and at least this share of them, to enter the lexicon.
MIN_ROWS, MIN_SHARE = 4, 0.003
#: Excess of toxic rows over the number expected by chance, in standard deviations.
MIN_EXCESS = 6.0
MIN_WEIGHT = 2.0
#: Bound of the lexicon, by weight x rows; a parameter of the model.
MAX_WORDS = 20_000
SMOOTH = 20
#: Lengths of the word beginnings that the lexicon may hold.
STEMS = (5, 6, 7, 8)
_FLUSH = 200_000
_RANGE = {"x": (0.0, 6.0)}

# Look-alikes of Latin letters and signs that stand for letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ѵ": "v", "ո": "n", "ս": "u",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "€": "e", "ß": "ss", "æ": "ae", "ø": "o",
}
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_TABLE = str.maketrans(_LOOKALIKES) | _INVISIBLE
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded words, each between single blanks; '' has none. Idempotent.

    A trailing ! or | ends a sentence and is no letter, so such signs count inside words only.
    """
    if not text:
        return " "
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = _EDGES.sub(" ", text.lower())
    return f" {' '.join(_WORD.findall(text.translate(_TABLE)))} "


_EDGES = re.compile(r"(?<!\w)[!|$@€]+(?!\w)|(?<=\w)[!|]+(?!\w)|(?<!\w)[!|]+(?=\w)")


@dataclass
class ToxicityModel:
    #: Folded word or phrase -> weight; exceptions have negative ones.
    lexicon: dict[str, float] = field(default_factory=dict)
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0])
    _automaton: object = field(default=None, repr=False)

    def __reduce__(self):
        return ToxicityModel, (self.lexicon, self.curve)

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.lexicon.items():
                self._automaton.add_word(_pattern(term), (weight, term))
            if self.lexicon:
                self._automaton.make_automaton()
        return self._automaton

    def weigh(self, text: str) -> tuple[float, int, list[str]]:
        """(figure, number of words, matched terms) of a text."""
        folded = fold(text)
        words = folded.count(" ") - 1
        if not self.lexicon or words < 1:
            return 0.0, max(words, 0), []
        found = [hit for _, hit in self.automaton().iter(folded)]
        total = max(0.0, sum(w for w, _ in found))
        return total / (words + SMOOTH), words, [t for _, t in found]


def _pattern(term: str) -> str:
    """What the automaton looks for: a whole word or phrase, or with a final * the beginning of a word."""
    return f" {term[:-1]}" if term.endswith("*") else f" {term} "


def _forms(word: str) -> list[str]:
    """A word and its beginnings, as terms: inflected forms share those."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def _terms(folded: str) -> set[str]:
    return {t for w in set(folded.split()) for t in _forms(w)}


def _counts(labelled: DataFrame, features) -> DataFrame:
    """(term, bad, all): rows with each term that ``features(folded)`` gives, counted per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            bad, every = tallies
            terms = list(every)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array([bad[t] for t in terms], pa.int64()),
                    pa.array([every[t] for t in terms], pa.int64()),
                ],
                ["term", "bad", "n"],
            )
            bad.clear(), every.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
                terms = features(fold(text.as_py() or ""))
                tallies[1].update(terms)
                if label.as_py():
                    tallies[0].update(terms)
                if len(tallies[1]) > _FLUSH:
                    yield flush()
        yield flush()

    parts = labelled.select("text", "label").mapInArrow(count, "term string, bad long, n long")
    return parts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def _phrases(lexicon: set[str]):
    def features(folded: str) -> set[str]:
        words = folded.split()
        return {
            f"{words[j]} {words[j + 1]}"
            for i, w in enumerate(words)
            if not lexicon.isdisjoint(_forms(w))
            for j in (i - 1, i)
            if 0 <= j < len(words) - 1
        }

    return features


def fit(labelled: DataFrame) -> ToxicityModel:
    """Model from (text, label 0/1)."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return ToxicityModel(curve=fit_logistic(labelled.select("label", F.lit(0.0).alias("x")), _RANGE))
    least = max(MIN_ROWS, MIN_SHARE * bad)
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    expected = F.col("n") * (bad / (bad + good))
    chosen = (
        _counts(labelled, _terms)
        .where(F.col("bad") >= least)
        .where((F.col("bad") - expected) / F.sqrt(expected) >= MIN_EXCESS)
        .withColumn("weight", weight)
        .where(F.col("weight") >= MIN_WEIGHT)
        .orderBy(F.desc(F.col("weight") * F.col("bad")), "term")
        .limit(MAX_WORDS)
        .collect()
    )
    lexicon = {r["term"]: float(r["weight"]) for r in chosen}
    if lexicon:
        kind = (
            _counts(labelled, _phrases(set(lexicon)))
            .where((F.col("n") >= MIN_ROWS) & (F.col("bad") / F.col("n") < 0.5 * bad / (bad + good)))
            .orderBy(F.desc("n"), "term")
            .limit(MAX_WORDS)
            .collect()
        )
        for r in kind:
            lexicon[r["term"]] = -sum(lexicon.get(t, 0.0) for w in r["term"].split() for t in _forms(w))
    model = ToxicityModel(lexicon)
    model.curve = fit_logistic(figures(labelled.select("label", "text"), model), _RANGE)
    return model


def figures(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``rows`` with x (the normalised figure), n_words and terms instead of their column ``text``."""
    kept = [c for c in rows.columns if c != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.weigh(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                [*kept, "x", "n_words", "terms"],
            )

    fields = T.StructType([f for f in rows.schema if f.name != "text"])
    got = rows.mapInArrow(
        measure, fields.add("x", "double").add("n_words", "long").add("terms", T.ArrayType(T.StringType()))
    )
    return got.withColumn("x", F.log1p(F.col("x") * 100))


def score(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``rows`` with score (higher: toxic is likelier), n_words and the matched terms."""
    return figures(rows, model).withColumn("score", logistic([F.col("x")], model.curve)).drop("x")
