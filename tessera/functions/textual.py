"""Text functions in Catalyst expressions: normalising, n-gram bags, cosine, cues, keywords."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon


def normalise(text: Column) -> Column:
    """Letters, digits and U+3400 to U+9FFF only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\x{3400}-\x{9FFF}]", ""))


def normalise_match(text: Column, confusions: Sequence[tuple[str, str]] = lexicon.CONFUSIONS) -> Column:
    """normalise() with known misreadings replaced in order; for scoring, never for display."""
    out = normalise(text)
    for a, b in confusions:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: inside a lambda an outer expression would be computed anew each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def grams(text: Column, size: int) -> Column:
    """All runs of `size` characters. Slices of a character array: substring() walks from the start each time."""

    def runs(chars: Column) -> Column:
        items = F.transform(F.sequence(F.lit(1), F.size(chars) - size + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(size)), ""))
        return F.when(F.size(chars) >= size, items).otherwise(F.array().cast("array<string>"))

    return once(F.split(text, ""), runs)


def features(normal: Column) -> Column:
    """The weighted features of a normalised text, repeats included: (key, weight in hundredths).

    2-grams weigh 1, 3-grams 1.35, runs of two or more Latin letters and digits 1.5.
    """

    def weighted(items: Column, prefix: str, weight: int) -> Column:
        return F.transform(items, lambda x: F.struct(F.concat(F.lit(prefix), x).alias("key"), F.lit(weight).alias("weight")))

    def all_of(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit("([a-z0-9]{2,})"), F.lit(1))
        return F.concat(weighted(grams(t, 2), "2:", 100), weighted(grams(t, 3), "3:", 135), weighted(words, "word:", 150))

    return once(normal, all_of)


def cosine_sums(dot: Column, left: Column, right: Column) -> Column:
    """Cosine of integer sums (dot product and squared norms), within 0 and 1; 0 if one is empty."""
    return F.when((F.coalesce(left, F.lit(0)) == 0) | (F.coalesce(right, F.lit(0)) == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.coalesce(dot, F.lit(0)) / (F.sqrt(left.cast("double")) * F.sqrt(right.cast("double"))))
    )


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray, Counter]:
    """2- and 3-grams of a normalised text as numbers with their weights in hundredths, and its words' counts."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = (two[:-1] << np.uint64(21) | c[2:]) + np.uint64(1 << 63)
    grams, n = np.unique(np.concatenate([two, three]), return_counts=True)
    return grams, n * np.where(grams >> np.uint64(63), 135, 100), Counter(re.findall("[a-z0-9]{2,}", text))


def bag_cosine(a: tuple[np.ndarray, np.ndarray, Counter], b: tuple[np.ndarray, np.ndarray, Counter]) -> float:
    """The cosine of two bags of features(); sums are of integers, hence exact. 0 if one is empty."""
    square = lambda x: int((x[1] * x[1]).sum()) + 22_500 * sum(v * v for v in x[2].values())
    left, right = square(a), square(b)
    if not left or not right:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    dot = int((a[1][i] * b[1][j]).sum()) + 22_500 * sum(v * b[2][k] for k, v in a[2].items() if k in b[2])
    return min(1.0, dot / (left**0.5 * right**0.5))


@F.pandas_udf(T.DoubleType())
def feature_cosine(left: pd.Series, right: pd.Series) -> pd.Series:
    """bag_cosine of two columns of normalised texts; null is empty. No row leaves its task."""
    return pd.Series([bag_cosine(feature_counts(a or ""), feature_counts(b or "")) for a, b in zip(left, right)])


def cues(normal: Column, patterns: Sequence[tuple[str, float, str]] = lexicon.CUES) -> Column:
    """struct(score, names): the largest weight of the patterns that occur, and their names in order."""
    found = F.array_compact(F.array(*[F.when(normal.rlike(p), F.struct(F.lit(w).alias("w"), F.lit(n).alias("n"))) for p, w, n in patterns]))
    return F.struct(
        F.coalesce(F.array_max(F.transform(found, lambda x: x["w"])), F.lit(0.0)).alias("score"),
        F.transform(found, lambda x: x["n"]).alias("names"),
    )


def occurrences(text: Column, term: str) -> Column:
    """How often the term occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def keywords(text: Column, terms: Sequence[str] = lexicon.TERMS, limit: int = 8) -> Column:
    """Terms by count, then list order; filled up with the most frequent Latin words, first seen first."""
    counted = F.filter(F.array(*[F.struct((-occurrences(text, t)).alias("c"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(terms)]), lambda x: x["c"] < 0)
    own = F.slice(F.transform(F.array_sort(counted), lambda x: x["t"]), 1, limit)
    fill = F.slice(latin_words(text), F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.size(own)))
    return F.concat(own, F.filter(fill, lambda x: ~F.array_contains(own, x)))


#: A match needs a word boundary on both sides; trailing dots and hyphens are given back.
LATIN = re.compile(r"(?<!\w)([A-Za-z][A-Za-z0-9.-]{1,15}(?<=[A-Za-z0-9]))(?!\w)")


@F.pandas_udf(T.ArrayType(T.StringType()))
def latin_words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The distinct Latin words of a text, the most frequent first, then by first place; one pass."""
    for texts in parts:
        yield pd.Series([[w for w, _ in Counter(LATIN.findall(t or "")).most_common()] for t in texts])


def collapse(text: Column) -> Column:
    """White space (as Unicode has it) as single blanks."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def replacement_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))


def prompt_ok(text: Column) -> Column:
    """A prompt is 1 to 1000 characters after trimming, without control characters."""
    return ~text.rlike(r"\p{Cc}") & F.length(F.trim(text)).between(1, 1000)


@F.pandas_udf(T.StringType())
def safe_name(names: pd.Series) -> pd.Series:
    """A run's name: NFKC, every run of other than word characters a hyphen, trimmed, 72 characters at most."""
    clean = lambda t: re.sub(r"[^\w]+", "-", unicodedata.normalize("NFKC", t)).strip("-_.")[:72].strip("-_.") or "run"
    return pd.Series([None if t is None else clean(t) for t in names])


def clean_list(items: Column) -> Column:
    """Trimmed, non-empty strings, each once, in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def finite(value: Column) -> Column:
    """A number as JSON can hold it: NaN and infinities are null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _numbers(df, one: Callable[[Column], Column]):
    """df with a function applied to its floating columns, and to those in arrays."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = one(F.col(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.transform(F.col(f.name), one)
    return df.withColumns(out) if out else df


def json_ready(df):
    """df whose floating columns, and those in arrays, are finite or null."""
    return _numbers(df, finite)


def public(df, places: int = 6):
    """The published form of a ledger: floating columns finite or null, and rounded."""
    return _numbers(df, lambda x: F.round(finite(x), places))
