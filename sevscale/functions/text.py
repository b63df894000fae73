"""Text cleaning columns (C1-C3): chains of native string expressions, no Python worker.

Patterns are written so that they mean the same on every Java version: Unicode classes are
spelled out instead of relying on what ``\\b``, ``\\d`` or ``\\S`` cover.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the cleaners delete or rewrite.
BLANK = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
URL = rf"https?://[^{BLANK}]+|www\.[^{BLANK}]+"
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[a-z/!?][^>]*>"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
SPECIAL = r"[^a-zA-Z\p{Nd}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
MARK = "\ufdd0"  # a code point that is no character


# Pieces of a text: one reference each, or what lies between references.
PIECE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
# Names that HTML also reads without a semicolon, longest first.
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
OPEN_NAME = f"^&({'|'.join(OPEN_NAMES)})"
# What HTML makes of the C1 code points (128 to 159), as Windows-1252.
C1 = bytes(range(128, 160)).decode("cp1252", "replace")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def _names() -> Column:
    """Names of character references and what they stand for, common ones first, as one literal."""
    common = ("amp;", "quot;", "lt;", "gt;", "nbsp;")
    ordered = [*common, *(n for n in html5 if n not in common)]
    keys, values = "\x1e".join(ordered), "\x1e".join(html5[n] for n in ordered)
    return F.map_from_arrays(F.split(F.lit(keys), "\x1e"), F.split(F.lit(values), "\x1e"))


def _character(code: Column) -> Column:
    """The character of a code point (a number as text); U+FFFD where there is none, nothing if not allowed."""
    n = code.cast("decimal(38,0)")
    c1 = F.substring(F.lit(C1), (n - 127).cast("int"), F.lit(1))
    # C1 code points without a Windows-1252 character stay as they are.
    named = F.when(n.between(128, 159) & (c1 != "\ufffd"), c1)
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF)
    plain = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n.cast("long")), 8, "0"))), "UTF-32")
    return (
        F.when(n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd")
        .when(named.isNotNull(), named)
        .when(n.isin(129, 141, 143, 144, 157) | (n == 13), plain)
        .when(control | (n % 65536).isin(65534, 65535), "")
        .otherwise(plain)
    )


def _reference(piece: Column) -> Column:
    """One piece, decoded if it is a character reference."""
    digits = F.regexp_replace(piece, "[&#xX;]", "")
    wide = F.length(F.regexp_replace(digits, "^0+", ""))
    hexed = F.when(wide <= 8, F.conv(digits, 16, 10))
    decimal = F.when(wide <= 10, digits)
    opening = F.regexp_extract(piece, OPEN_NAME, 1)
    rest = F.substring(piece, F.length(opening) + 2, F.length(piece))
    named = F.element_at(_names(), F.substring(piece, F.lit(2), F.length(piece)))
    return (
        F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece)
        .when(F.lower(F.substring(piece, 1, 3)) == "&#x", _character(hexed))
        .when(F.substring(piece, 1, 2) == "&#", _character(decimal))
        .otherwise(F.coalesce(named, F.when(opening != "", F.concat(F.element_at(_names(), opening), rest)), piece))
    )


def decode_entities(text: Column) -> Column:
    """Decode all character references of HTML, each once, natively.

    Numbers, names, and the names read without a semicolon, as browsers do.
    """
    return F.when(
        F.contains(text, F.lit("&")),
        F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), _reference), ""),
    ).otherwise(text)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times without repeating the expression it comes from."""
    return F.transform(F.array(value), use)[0]


def _after(text: Column, done: Column, change: Callable[[Column], Column]) -> Column:
    """Change what comes after a leading part."""
    return F.concat(done, change(F.substring(text, F.length(done) + 1, F.length(text))))


def _closer(name: str) -> Callable[[Column], Column]:
    """Mark openings of this element after its last closing tag."""
    opening, marked = f"(?i)<({name[:-1]})({name[-1]})", f"<$1{MARK}$2"
    return lambda t: _after(
        t, F.regexp_extract(t, rf"(?is)^(.*</{name}\s*>)", 1),
        lambda rest: F.regexp_replace(rest, opening, marked),
    )


def _close_open_ends(text: Column) -> Column:
    """Mark comment and script openings that nothing closes, so no search for their end starts."""
    text = _bound(text, lambda t: _after(
        t, F.regexp_extract(t, "(?s)^(.*-->)", 1), lambda rest: F.replace(rest, F.lit("<!--"), F.lit(f"<!-{MARK}-"))
    ))
    for name in ("script", "style"):
        text = _bound(text, _closer(name))
    return text


def _without_markup(text: Column) -> Column:
    """Remove markup in time that grows with the text, also where tags stay open.

    No match reaches beyond the last ``>``, so the text after it is left alone.
    """
    tail = F.substring_index(text, ">", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    return F.concat(F.replace(F.regexp_replace(_close_open_ends(head), MARKUP, ""), F.lit(MARK), F.lit("")), tail)


def strip_html(text: Column) -> Column:
    """Drop tags, comments, scripts and styles without leaving a gap; decode entities."""
    bare = F.when(F.contains(text, F.lit(MARK)), F.regexp_replace(text, MARKUP, "")).otherwise(
        _bound(text, _without_markup))
    return _bound(bare, decode_entities)


def strip_emoji(text: Column) -> Column:
    """Drop the emoji ranges.

    The last range also holds CJK, Kana and Hangul, so those go as well and their
    neighbours join up.
    """
    return F.regexp_replace(text, EMOJI, "")


def strip_specials(text: Column) -> Column:
    """Every character that is neither an ASCII letter nor a decimal digit becomes a space."""
    return F.regexp_replace(text, SPECIAL, " ")


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def clean_text(text: Column, order: str = "url_first") -> Column:
    """Whole cleaner: addresses, markup, emoji, specials, spaces.

    ``url_first`` is the established order; an address inside a tag then swallows the rest
    of that tag.  ``html_first`` avoids this.
    """
    if order == "url_first":
        text = strip_html(strip_urls(text))
    elif order == "html_first":
        text = strip_urls(strip_html(text))
    else:
        raise ValueError(f"order must be 'url_first' or 'html_first', not {order!r}")
    return squeeze_spaces(strip_specials(strip_emoji(text)))


# Punctuation rules, pattern and replacement, in the order they apply.
PUNCT_RULES = (
    (r"\n", " \n "),
    (r"(?<![a-zA-Z])([a-zA-Z]++)([/!?.])([a-zA-Z]+)", "$1 $2 $3"),
    (r"([*!?'])\1\1{2,}", "$1$1$1"),
    (r"([*!?']+)", " $1 "),
    (rf"([a-zA-Z])\1{{2,}}(?!{WORD_CHAR})", "$1$1"),
    (rf"([a-zA-Z])\1\1{{2,}}(?={WORD_CHAR})", "$1$1$1"),
    (r"[ ]{2,}", " "),
    (rf"^[{BLANK}]+|[{BLANK}]+$", ""),
)


def normalize_punct(text: Column) -> Column:
    """Space out punctuation and shorten runs of repeated characters."""
    for pattern, replacement in PUNCT_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def as_text(value: Column) -> Column:
    """Cast to string; a missing value stays missing."""
    return value.cast("string")


def words(text: Column) -> Column:
    """Lower-cased words, split at any white space."""
    parts = F.split(F.lower(text), rf"[{BLANK}]+")
    return F.filter(parts, lambda w: w != "")
