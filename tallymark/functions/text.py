"""Answer-scoring rules as native column expressions.

Each function takes and returns Columns, so a scoring job stays inside
whole-stage code generation.  Character classes follow Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions import lexicons as lx

WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACES = r"[\s\x1c-\x1f]"
_NONSPACES = r"(?U)[^\s\x1c-\x1f]+"
# U: Unicode classes; d: only \n ends a line.
_FLAGS = "(?Ud)"
_DIGIT = r"(?U)\d"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_extract_all(text, F.lit(_NONSPACES), F.lit(0))


def count_hits(text: Column, lexicon: Sequence[str]) -> Column:
    """Number of lexicon entries found in the text, each counted once."""
    hits = [F.contains(text, F.lit(entry)).cast("int") for entry in lexicon]
    return sum(hits[1:], hits[0])


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def exact_match(prediction: Column, truth: Column, blank_scores: bool = False) -> Column:
    """1.0 when equal after trimming and lower-casing.

    Blank text scores 0 unless ``blank_scores``, where blank equals blank.
    """
    equal = (F.lower(strip(prediction)) == F.lower(strip(truth))).cast("double")
    if blank_scores:
        return F.coalesce(equal, F.lit(0.0))
    return F.when(is_blank(prediction) | is_blank(truth), 0.0).otherwise(equal)


def contains_match(prediction: Column, truth: Column) -> Column:
    """1.0 when the trimmed, lower-cased truth occurs in the prediction."""
    found = F.contains(F.lower(strip(prediction)), F.lower(strip(truth))).cast("double")
    return F.when(is_blank(prediction) | is_blank(truth), 0.0).otherwise(found)


def similarity_bound(prediction: Column, truth: Column) -> Column:
    """Largest value the sequence similarity can reach, from lengths alone."""
    a, b = F.length(F.lower(prediction)), F.length(F.lower(truth))
    return F.when(a + b == 0, 1.0).otherwise(2.0 * F.least(a, b) / (a + b))


def _opening(pattern: str) -> str:
    """Plain text every match of the pattern starts with."""
    plain = re.match(r"[^\\()\[\].*+?{}|^$]*", pattern).group()
    optional = pattern[len(plain):len(plain) + 1] in ("?", "*", "{")
    return "" if "|" in re.sub(r"\([^()]*\)", "", pattern) else plain[:-1] if optional else plain


def numeric_answer(text: Column, patterns: Sequence[str] = lx.ANSWER_PATTERNS) -> Column:
    """First number any of the ordered patterns finds; a comma is a decimal point.

    A pattern that opens with plain text is only tried where that text occurs.
    """
    found = []
    for pattern in patterns:
        number = F.translate(F.regexp_extract(text, _FLAGS + pattern, 1), ",", ".").try_cast("double")
        opening = _opening(pattern)
        found.append(F.when(F.contains(text, F.lit(opening)), number) if opening else number)
    return F.coalesce(*found)


def numbers_agree(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


def reasoning_steps(text: Column, indicators: Sequence[str] = lx.STEP_INDICATORS) -> Column:
    """Trimmed lines that open a step or hold a formula with a digit."""
    marked = "(?U)" + "|".join(indicators)
    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(lines, lambda s: s.rlike(marked) | (F.contains(s, F.lit("=")) & s.rlike(_DIGIT)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def reasoning_quality(
    steps: Column, logical: Sequence[str] = lx.LOGICAL_WORDS, signs: Sequence[str] = lx.FORMULA_SIGNS
) -> Column:
    """Blend of step count, connectives per step and share of formula steps."""
    n = F.size(steps)
    connected = _total(F.transform(steps, lambda s: count_hits(s, logical)))
    formulas = F.size(F.filter(steps, lambda s: count_hits(s, signs) > 0))
    score = (
        F.least(n / 5.0, F.lit(1.0)) * 0.3
        + F.least(connected / n, F.lit(0.5)) * 0.3
        + F.least(formulas / n, F.lit(1.0)) * 0.4
    )
    return F.when(n > 0, F.least(score, F.lit(1.0))).otherwise(0.0)


def math_confidence(
    text: Column, sure: Sequence[str] = lx.SURE_WORDS, unsure: Sequence[str] = lx.UNSURE_WORDS
) -> Column:
    """0.5, a tenth up or down per hedging word, more for a formula."""
    formula = (F.contains(text, F.lit("=")) & text.rlike(_DIGIT)).cast("int")
    return clamp(F.lit(0.5) + count_hits(text, sure) * 0.1 - count_hits(text, unsure) * 0.1 + formula * 0.2)


def normalize(text: Column, punctuation: str = lx.PUNCTUATION) -> Column:
    """Collapse whitespace, drop punctuation, lower-case."""
    spaced = F.regexp_replace(strip(text), "(?U)" + _SPACES + "+", " ")
    return F.lower(F.regexp_replace(spaced, punctuation, ""))


def normalized_match(prediction: Column, truth: Column) -> Column:
    return (normalize(prediction) == normalize(truth)).cast("double")


def keywords(text: Column, shape: str = lx.KEYWORD, stopwords: Sequence[str] = lx.STOPWORDS) -> Column:
    """Distinct words of the keyword shape without stop words."""
    found = F.regexp_extract_all(text, F.lit(shape), F.lit(0))
    kept = F.array_except(found, F.array(*[F.lit(w) for w in stopwords]))
    return F.array_distinct(F.transform(kept, F.lower))


def keyword_recall(
    prediction: Column, truth: Column, shape: str = lx.KEYWORD, stopwords: Sequence[str] = lx.STOPWORDS
) -> Column:
    """Share of the truth's keywords found in the prediction; 0 if it has none."""
    wanted = keywords(truth, shape, stopwords)
    found = F.filter(wanted, lambda k: F.contains(F.lower(prediction), k))
    return F.when(F.size(wanted) > 0, F.size(found) / F.size(wanted)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, not below 0; 0 when either is all zero."""

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    square = lambda v: F.transform(v, lambda x: x.cast("double") * x.cast("double"))
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = F.sqrt(total(square(a))) * F.sqrt(total(square(b)))
    return F.when(norms > 0, F.greatest(dot / norms, F.lit(0.0))).otherwise(0.0)


def qa_composite(exact: Column, semantic: Column, keyword: Column) -> Column:
    return exact * 0.4 + semantic * 0.4 + keyword * 0.2


def completeness(text: Column, endings: Sequence[str] = lx.SENTENCE_ENDINGS) -> Column:
    """Proper sentence ending, minimum length and more than one word."""
    trimmed = strip(text)
    ends = F.exists(F.array(*[F.lit(e) for e in endings]), lambda e: F.endswith(trimmed, e))
    score = (
        F.when(ends, 0.4).otherwise(0.0)
        + F.when(F.length(trimmed) >= 5, 0.3).otherwise(0.0)
        + F.when(F.size(words(text)) >= 2, 0.3).otherwise(0.0)
    )
    return F.when(is_blank(text), 0.0).otherwise(F.least(score, F.lit(1.0)))


def fluency(
    text: Column, connectors: Sequence[str] = lx.CONNECTORS, awkward: Sequence[str] = lx.AWKWARD_PATTERNS
) -> Column:
    """0.5, up for varied words and connectors, down per awkward shape."""
    w = words(text)
    n = F.size(w)
    variety = F.when(n > 1, (F.size(F.array_distinct(w)) / n - 0.5) * 0.3).otherwise(0.0)
    linked = F.least(count_hits(text, connectors) * 0.1, F.lit(0.2))
    clumsy = [text.rlike("(?d)" + pattern).cast("int") for pattern in awkward]
    penalty = sum(clumsy[1:], clumsy[0]) * 0.1
    return F.when(is_blank(text), 0.0).otherwise(clamp(F.lit(0.5) + variety + linked - penalty))


def qa_confidence(
    text: Column,
    sure: Sequence[str] = lx.SURE_EXPRESSIONS,
    unsure: Sequence[str] = lx.UNSURE_EXPRESSIONS,
    term: str = lx.LONG_KEYWORD,
) -> Column:
    """0.5, a tenth per expression, number and specific vocabulary."""
    terms = F.size(F.regexp_extract_all(text, F.lit(term), F.lit(0))) > 2
    tenths = count_hits(text, sure) - count_hits(text, unsure) + text.rlike(_DIGIT).cast("int") + terms.cast("int")
    return F.when(is_blank(text), 0.0).otherwise(clamp(F.lit(0.5) + tenths * 0.1))


def token_efficiency(text: Column, output_tokens: Column) -> Column:
    """Words longer than two letters per output token."""
    w = words(text)
    tokens = F.coalesce(output_tokens.cast("long"), F.size(w).cast("long"))
    return F.when(tokens > 0, F.size(F.filter(w, lambda x: F.length(x) > 2)) / tokens).otherwise(0.0)


def performance_score(tokens_per_second: Column, memory_mb: Column) -> Column:
    """Speed up to 100 tokens/s times memory thrift against 8000 MB."""
    speed = F.when(tokens_per_second > 0, F.least(tokens_per_second / 100.0, F.lit(1.0))).otherwise(1.0)
    memory = clamp(F.try_divide(F.lit(8000.0), F.coalesce(memory_mb, F.lit(8000.0))), 0.1, 1.0)
    return speed * memory


def performance_composite(similarity: Column, performance: Column) -> Column:
    return similarity * 0.7 + performance * 0.3
