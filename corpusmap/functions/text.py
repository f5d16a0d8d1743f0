"""Column functions over text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, functions as F

from corpusmap.functions.fixed import SOURCE_NAMES, STOPWORDS
from corpusmap.functions.works import let

# Markup removed from titles and abstracts, in the order of removal.
_JATS_TAGS = [
    r"(?i)&lt;/?title&gt;",
    r"(?i)</?title>",
    r"(?i)&lt;/?jats:[a-z]+&gt;",
    r"(?i)</?jats:[a-z]+>",
]

# A label word is four or more ASCII letters with Unicode word boundaries.
_LABEL_WORD = r"(?<![\p{L}\p{N}_])[a-zA-Z]{4,}+(?![\p{L}\p{N}_])"


def strip_markup(text: Column) -> Column:
    """Replace every ``<…>`` by one space."""
    return F.regexp_replace(text, "<[^>]+>", " ")


def strip_jats(text: Column) -> Column:
    """Delete title and JATS tags, raw or escaped."""
    return reduce(lambda t, tag: F.regexp_replace(t, tag, ""), _JATS_TAGS, text)


def truncate(text: Column, n: int, ellipsis: str = "") -> Column:
    """First ``n`` characters, followed by ``ellipsis`` when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(ellipsis))).otherwise(
        text
    )


def embedding_text(title: Column, abstract: Column) -> Column:
    """Text given to the encoder: ``title. abstract``, nulls as empty text."""
    empty = F.lit("")
    return F.concat(F.coalesce(title, empty), F.lit(". "), F.coalesce(abstract, empty))


def label_text(title: Column, abstract: Column) -> Column:
    """Text that topic words are taken from: ``title abstract`` without markup."""
    empty = F.lit("")
    return strip_markup(F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(abstract, empty)))


def source_name(code: Column) -> Column:
    """Display name of a record source, or the code itself."""
    pairs = [F.lit(v) for pair in SOURCE_NAMES.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def _fold(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that fold to one character, that vanish, and that fold to several, by Unicode
    rule over all code points. Hangul syllables keep their form: no other text can equal their parts."""
    singles, dropped, ligatures = [], [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        ch = chr(code)
        folded = _fold(ch)
        if folded == ch:
            continue
        if len(folded) == 1:
            singles.append((ch, folded))
        elif not folded:
            dropped.append(ch)
        else:
            ligatures.append((ch, folded))
    source = "".join(a for a, _ in singles) + "".join(dropped)
    return source, "".join(b for _, b in singles), ligatures


def _ranges(chars: list[str]) -> str:
    """A character class with neighbouring characters as ranges: long lists are walked for every character."""
    codes = sorted(map(ord, chars))
    bounds = [i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1]
    parts = zip([0, *bounds], [*bounds, len(codes)], strict=True)
    return "[" + "".join(f"\\x{{{codes[i]:x}}}-\\x{{{codes[j - 1]:x}}}" for i, j in parts) + "]"


def normalize_text(text: Column) -> Column:
    """Lower-case text without accents and compatibility forms, inside the JVM.

    Characters that fold to one are translated. Texts with characters that fold to several are first cut before and after
    those, and only such pieces are looked up. ASCII texts, and ASCII characters, are passed by.
    """
    source, target, ligatures = _fold_tables()
    spelling = F.create_map(*[F.lit(s) for pair in ligatures for s in pair])
    several = rf"(?![\x00-\x7f]){_ranges([a for a, _ in ligatures])}"

    def spelled(low: Column) -> Column:
        pieces = F.split(low, f"(?={several})|(?<={_ranges([a for a, _ in ligatures])})")
        return F.array_join(
            F.transform(pieces, lambda c: F.when(F.length(c) == 1, F.coalesce(F.try_element_at(spelling, c), c)).otherwise(c)), ""
        )

    def fold(low: Column) -> Column:
        return F.when(
            low.rlike(r"[^\x00-\x7f]"),
            F.translate(F.when(low.rlike(several), spelled(low)).otherwise(low), source, target),
        ).otherwise(low)

    return let(F.lower(text), fold)


def normalize_any_text(text: Column) -> Column:
    """:func:`normalize_text` for every script, through Arrow batches."""

    def fold_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else _fold(t.lower()))

    return F.pandas_udf(fold_all, "string")(text)


def tokenize(normalized: Column) -> Column:
    """Label words of a normalized text, in order, repeats kept."""
    return F.regexp_extract_all(normalized, F.lit(_LABEL_WORD), F.lit(0))


def remove_stopwords(tokens: Column) -> Column:
    """Drop stopwords; repeats of other words stay."""
    return F.filter(tokens, lambda w: ~w.isin(STOPWORDS))


def label_words(title: Column, abstract: Column) -> Column:
    """Label words of a record."""
    return remove_stopwords(tokenize(normalize_text(label_text(title, abstract))))


def term_counts(tokens: Column) -> Column:
    """Distinct tokens with their counts, in term order.

    Counting runs of the sorted tokens stays inside the row, so no shuffle is needed.
    """

    def runs(words: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words)),
            lambda i: (i == 0) | ~F.get(words, i).eqNullSafe(F.get(words, i - 1)),
        )
        return let(
            starts,
            lambda at: F.transform(
                F.slice(at, F.lit(1), F.size(at) - 1),
                lambda p, j: F.struct(
                    F.get(words, p).alias("term"), (F.get(at, j + 1) - p).alias("tf")
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)


def capitalize(word: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1 << 30)))
