"""Column-level text functions (built-in Spark expressions only, so they stay
inside whole-stage codegen).

Regex note: Java's ``\\w`` and ``\\s`` are ASCII-only while the cleaning rules
mean the Unicode classes, so word characters are spelled ``[\\p{L}\\p{N}_]`` and
white space ``[SPACE_SET]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnxml.functions.cpe import cpe_fields

# Fixed values that must equal the reference's behaviour.
# Unicode word character (Python's ``\w`` on str).
WORD_CHAR = r"[\p{L}\p{N}_]"
# Unicode white space (Python's ``\s`` and ``str.split`` on str), as a string of
# characters and as the inside of a regex class.
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE_SET = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Characters kept by the symbol remover: ASCII letters, digits, '_' and the
# byte range 0x20-0x2F (space ! " # $ % & ' ( ) * + , - . /).
SYMBOLS_PATTERN = r"[^a-zA-Z_0-9 -/]+"
# Characters deleted by the comma/quote remover.
COMMA_QUOTE_CHARS = "'\","
# Characters deleted from tag lists: brackets, both quotes and every space.
TAG_DROP_CHARS = "[]'\" "
# Non-alphanumeric runs in URLs become one space.
URL_NON_ALNUM = r"[^0-9a-zA-Z]+"
# Filler used when a truncated text is empty.
EMPTY_TEXT_FILLER = "filling empty"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_or_empty(col) -> Column:
    """Missing text is the empty string (never the word 'nan')."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def normalize_space(col) -> Column:
    """Whitespace runs become one space, then strip."""
    return F.trim(F.regexp_replace(_c(col), f"[{SPACE_SET}]+", " "))


def strip(col, side: str = "both") -> Column:
    """White space of any kind removed at the left end or at both ends."""
    chars = F.lit(SPACE_CHARS)
    if side == "left":
        return F.ltrim(_c(col), chars)
    if side == "right":
        return F.rtrim(_c(col), chars)
    if side == "both":
        return F.trim(_c(col), chars)
    raise ValueError(f"unknown side {side!r}")


def basic_cleaning(col) -> Column:
    """Lower -> drop non-word, non-space chars -> collapse spaces -> trim."""
    lowered = F.lower(text_or_empty(col))
    no_punct = F.regexp_replace(lowered, rf"[^\p{{L}}\p{{N}}_{SPACE_SET}]", "")
    return normalize_space(no_punct)


def remove_symbols(col) -> Column:
    """Delete every char outside ``[a-zA-Z_0-9 -/]``."""
    return F.regexp_replace(_c(col), SYMBOLS_PATTERN, "")


def remove_comma_quote(col) -> Column:
    """Delete single quotes, double quotes and commas."""
    return F.translate(_c(col), COMMA_QUOTE_CHARS, "")


def parse_list_repr(col) -> Column:
    """Text of a Python list (``"['a', 'b']"``) -> array of trimmed items.
    ``'[]'`` gives one empty item, which marks an invalid report (J1)."""
    inner = F.expr(f"substring({_sql(col)}, 2, greatest(length({_sql(col)}) - 2, 0))")
    unquoted = F.translate(inner, "'\"", "")
    return F.transform(F.split(unquoted, ","), lambda x: strip(x))


def _sql(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("parse_list_repr expects a column name")


def split_labels(col, mode: str = "spaces") -> Column:
    """The three label-list dialects.

    * ``spaces``  - split on commas (the list text is then re-joined by spaces)
    * ``tags``    - drop brackets, quotes and all spaces, split on commas
    * ``symbols`` - remove symbols (P3), split on commas, trim each item
    """
    c = text_or_empty(col)
    if mode == "spaces":
        return F.filter(F.split(c, ","), lambda x: x != "")
    if mode == "tags":
        return F.filter(F.split(F.translate(c, TAG_DROP_CHARS, ""), ","), lambda x: x != "")
    if mode == "symbols":
        return F.transform(F.split(remove_symbols(c), ","), lambda x: strip(x))
    raise ValueError(f"unknown label-list mode {mode!r}")


def cpe_words(cpes) -> Column:
    """Per CPE ``vendor + ' ' + product + ' '``, concatenated, duplicates
    kept; an escaped colon belongs to its field (as P5)."""
    parts = F.transform(_c(cpes), lambda x: F.concat(
        F.coalesce(F.get(cpe_fields(x), 3), F.lit("")), F.lit(" "),
        F.coalesce(F.get(cpe_fields(x), 4), F.lit("")), F.lit(" ")))
    return F.array_join(parts, "")


def url_words(urls) -> Column:
    """P10: non-alphanumeric runs -> one space; each URL followed by a space."""
    parts = F.transform(_c(urls), lambda u: F.concat(F.regexp_replace(u, URL_NON_ALNUM, " "), F.lit(" ")))
    return F.array_join(parts, "")


def url_authority(col) -> Column:
    """Network location including user info and port."""
    return F.try_parse_url(_c(col), F.lit("AUTHORITY"))


def feature_text(description, urls, cpes, page_text=None) -> Column:
    """Cleaned description + URL words + CPE words (+ optional page text),
    separated by single spaces."""
    parts = [basic_cleaning(description), F.trim(url_words(urls)), F.trim(cpe_words(cpes))]
    if page_text is not None:
        parts.append(text_or_empty(page_text))
    return normalize_space(F.concat_ws(" ", *parts))


def words(col) -> Column:
    """Whitespace tokens, empty strings removed."""
    return F.array_remove(F.split(text_or_empty(col), f"[{SPACE_SET}]+"), "")


def truncate_words(col, n: int) -> Column:
    """Lower, first n whitespace words; the filler text when nothing is left."""
    kept = F.array_join(F.slice(words(F.lower(text_or_empty(col))), 1, n), " ")
    return F.when(kept == "", F.lit(EMPTY_TEXT_FILLER)).otherwise(kept)


def strip_newlines(col) -> Column:
    """Newline characters removed (no replacement)."""
    return F.translate(text_or_empty(col), "\n", "")


def lower_strip(col, side: str = "both") -> Column:
    """Lower-case, then strip the left side or both sides."""
    return strip(F.lower(text_or_empty(col)), side)


def tfidf_tokens(col) -> Column:
    """Tokens of the TF-IDF vectoriser: runs of >= 2 word chars, lower-cased."""
    return F.regexp_extract_all(F.lower(text_or_empty(col)), F.lit(WORD_CHAR + "{2,}"), 0)
