"""Column -> Column text expressions. All built-in, JVM-side; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.schema import CATEGORICAL_FILL, WS_CLASS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column) -> Column:
    """Unicode strip. The trailing side is stripped as a leading side of the reversed
    text: an anchored match stops at once, where `W+$` is tried at every whitespace run."""
    lead = f"^{WS_CLASS}+"
    return F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(c, lead, "")), lead, ""))


def clean_text(c: Column | str) -> Column:
    """trim (Unicode) -> collapse whitespace runs -> each non-ASCII run to one space -> lower.

    A null input gives "". The order matters: no second collapse after the
    non-ASCII replacement, so "café x" gives "caf  x".
    """
    c = _col(c)
    collapsed = F.regexp_replace(strip_ws(c), f"{WS_CLASS}+", " ")
    ascii_only = F.regexp_replace(collapsed, "[^\\x00-\\x7F]+", " ")
    return F.coalesce(F.lower(ascii_only), F.lit(""))


def clean_categorical(c: Column | str, fill: str = CATEGORICAL_FILL) -> Column:
    """null -> fill, then strip, lower, and "" -> fill."""
    c = _col(c)
    filled = F.coalesce(c, F.lit(fill))
    stripped = F.lower(strip_ws(filled))
    return F.when(stripped == "", F.lit(fill)).otherwise(stripped)


def whitespace_words(c: Column | str) -> Column:
    """Words split on runs of Unicode whitespace, empty pieces removed (str.split())."""
    return F.filter(F.split(_col(c), f"{WS_CLASS}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words of a cleaned (ASCII, space-only) text."""
    return F.size(F.filter(F.split(_col(c), " "), lambda w: w != ""))


def count_char(c: Column | str, ch: str) -> Column:
    """Occurrences of one literal character."""
    c = _col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("int")


def _fully_upper(w: Column) -> Column:
    # At least one uppercase letter, no lowercase or titlecase letter, more than one character.
    return (w.rlike("\\p{IsUppercase}")
            & ~w.rlike("[\\p{IsLowercase}\\p{Lt}]")
            & (F.char_length(w) > 1))


def capitalized_word_ratio(c: Column | str) -> Column:
    """Share of whitespace words of the raw text that are fully capitalised; 0.0 if none."""
    words = whitespace_words(c)
    n = F.size(words)
    upper = F.size(F.filter(words, _fully_upper))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(upper / n)


def tokens(c: Column | str) -> Column:
    """Word tokens of two or more word characters, lower-cased (input is ASCII after clean_text)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("\\b\\w\\w+\\b"), 0)


def ngrams(tok: Column | str, n_max: int = 1) -> Column:
    """Unigrams, plus space-joined adjacent pairs when n_max = 2 (built after tokenising)."""
    tok = _col(tok)
    if n_max == 1:
        return tok
    if n_max != 2:
        raise ValueError("n-gram ranges (1,1) and (1,2) are supported")
    # zip_with pads the shorter array with null; concat with null is null and is dropped.
    pairs = F.zip_with(tok, F.slice(tok, 2, F.greatest(F.size(tok), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tok, F.filter(pairs, lambda x: x.isNotNull()))


def first_sentences(c: Column | str, n: int = 3) -> Column:
    """The first n sentences, a sentence ending at . ! or ? followed by whitespace or the end."""
    parts = F.filter(F.split(_col(c), "(?<=[.!?])(?=\\s)"), lambda s: s.rlike("\\S"))
    return strip_ws(F.array_join(F.slice(parts, 1, n), ""))
