"""The column functions under names that ``spark.sql`` knows.

``register`` defines them as temporary SQL functions, whose bodies Catalyst puts in place of the
calls: no Python worker runs, and filters and pruning work as with the DataFrame functions.
Tests hold both forms against each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import SparkSession

from sevscale.functions import labels, text


def quoted(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _replace(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, {quoted(pattern)}, {quoted(by)})"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _character(code: str) -> str:
    n = f"CAST({code} AS DECIMAL(38,0))"
    c1 = f"substring({quoted(text.C1)}, CAST({n} - 127 AS INT), 1)"
    plain = f"decode(unhex(concat('0000FEFF', lpad(hex(CAST({n} AS BIGINT)), 8, '0'))), 'UTF-32')"
    control = (f"{n} BETWEEN 1 AND 8 OR {n} = 11 OR {n} BETWEEN 14 AND 31 OR {n} BETWEEN 127 AND 159 "
               f"OR {n} BETWEEN 64976 AND 65007 OR {n} % 65536 IN (65534, 65535)")
    return (f"CASE WHEN {n} IS NULL OR {n} = 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN '\ufffd' "
            f"WHEN {n} BETWEEN 128 AND 159 AND {c1} <> '\ufffd' THEN {c1} "
            f"WHEN {n} IN (129, 141, 143, 144, 157, 13) THEN {plain} WHEN {control} THEN '' ELSE {plain} END")


def _names() -> str:
    common = ("amp;", "quot;", "lt;", "gt;", "nbsp;")
    ordered = [*common, *(n for n in html5 if n not in common)]
    keys, values = "\x1e".join(ordered), "\x1e".join(html5[n] for n in ordered)
    return f"map_from_arrays(split({quoted(keys)}, '\x1e'), split({quoted(values)}, '\x1e'))"


def _reference(p: str) -> str:
    digits = _replace(p, "[&#xX;]", "")
    wide = f"length({_replace(digits, '^0+', '')})"
    opening = f"regexp_extract({p}, {quoted(text.OPEN_NAME)}, 1)"
    return (f"CASE WHEN NOT startswith({p}, '&') OR {p} = '&' THEN {p} "
            f"WHEN lower(substring({p}, 1, 3)) = '&#x' THEN {_character(f'CASE WHEN {wide} <= 8 THEN conv({digits}, 16, 10) END')} "
            f"WHEN substring({p}, 1, 2) = '&#' THEN {_character(f'CASE WHEN {wide} <= 10 THEN {digits} END')} "
            f"ELSE coalesce(element_at(names, substring({p}, 2)), "
            f"CASE WHEN {opening} <> '' THEN concat(element_at(names, {opening}), substring({p}, length({opening}) + 2)) END, {p}) END")


def _decoded(t: str) -> str:
    pieces = f"regexp_extract_all({t}, {quoted(text.PIECE)}, 0)"
    joined = f"array_join(transform({pieces}, piece -> {_reference('piece')}), '')"
    return f"CASE WHEN contains({t}, '&') THEN {_bound(_names(), 'names', joined)} ELSE {t} END"


def _after(t: str, done: str, rest: str) -> str:
    """``rest``, in which {} stands for what comes after a leading part, behind that part."""
    return f"concat({done}, {rest.format(f'substring({t}, length({done}) + 1)')})"


def _without_markup(t: str) -> str:
    comments = _after("c", f"regexp_extract(c, {quoted('(?s)^(.*-->)')}, 1)", f"replace({{}}, '<!--', '<!-{text.MARK}-')")
    closed = _bound("head", "c", comments)
    for name in ("script", "style"):
        found = f"regexp_extract({name}_, {quoted(rf'(?is)^(.*</{name}\s*>)')}, 1)"
        marked = f"regexp_replace({{}}, {quoted(f'(?i)<({name[:-1]})({name[-1]})')}, {quoted(f'<$1{text.MARK}$2')})"
        closed = _bound(closed, f"{name}_", _after(f"{name}_", found, marked))
    bare = f"replace({_replace(closed, text.MARKUP, '')}, '{text.MARK}', '')"
    tail = f"substring_index({t}, '>', -1)"
    head = f"substring({t}, 1, length({t}) - length({tail}))"
    return f"concat({_bound(head, 'head', bare)}, {tail})"


def _strip_html(t: str) -> str:
    bare = f"CASE WHEN contains({t}, '{text.MARK}') THEN {_replace(t, text.MARKUP, '')} ELSE {_bound(t, 'whole', _without_markup('whole'))} END"
    return _bound(bare, "bare", _decoded("bare"))


def _punct(t: str) -> str:
    for pattern, by in text.PUNCT_RULES:
        t = _replace(t, pattern, by)
    return t


def _present(name: str) -> str:
    return f"nanvl({name}, CAST(NULL AS DOUBLE))"


def _summed(names: Sequence[str]) -> str:
    return " + ".join(f"coalesce({_present(n)}, 0D)" for n in names)


def _weighted(weights: dict[str, float], missing: str | None) -> str:
    parts = [f"coalesce({_present(n)}, {missing})" if missing else _present(n) for n in weights]
    return " + ".join(f"{p} * {float(w)!r}D" for p, w in zip(parts, weights.values()))


_FLAGS = ", ".join(f"{n} DOUBLE" for n in labels.SIX_FLAGS)
_SCORES = ", ".join(f"{n} DOUBLE" for n in ("toxicity", *labels.SUB_SCORES))

# name: arguments, result, body
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "strip_urls": ("t STRING", "STRING", _replace("t", text.URL, "")),
    "decode_entities": ("t STRING", "STRING", _bound("t", "bare", _decoded("bare"))),
    "strip_html": ("t STRING", "STRING", _strip_html("t")),
    "strip_emoji": ("t STRING", "STRING", _replace("t", text.EMOJI, "")),
    "strip_specials": ("t STRING", "STRING", _replace("t", text.SPECIAL, " ")),
    "squeeze_spaces": ("t STRING", "STRING", f"trim({_replace('t', ' +', ' ')})"),
    "clean_text": ("t STRING", "STRING", "squeeze_spaces(strip_specials(strip_emoji(strip_html(strip_urls(t)))))"),
    "clean_text_html_first": ("t STRING", "STRING", "squeeze_spaces(strip_specials(strip_emoji(strip_urls(strip_html(t)))))"),
    "normalize_punct": ("t STRING", "STRING", _punct("t")),
    "text_words": ("t STRING", "ARRAY<STRING>", f"filter(split(lower(t), {quoted(f'[{text.BLANK}]+')}), w -> w <> '')"),
    "severity_sum": (_FLAGS, "INT", f"CAST({_weighted(labels.SUM_WEIGHTS, '0D')} AS INT)"),
    "severity_max_weighted": (_FLAGS, "DOUBLE", f"greatest({', '.join(map(_present, labels.SIX_FLAGS))}) + "
                              + _weighted(labels.MAX_PLUS_WEIGHTS, None)),
    "severity_gated": (_SCORES, "DOUBLE", f"CASE WHEN {_present('toxicity')} <= {labels.SCORE_GATE}D THEN {_present('toxicity')} "
                       f"ELSE {_summed(labels.SUB_SCORES)} END"),
    "label_sum": (_FLAGS, "BIGINT", f"CAST({_summed(labels.SIX_FLAGS)} AS BIGINT)"),
    "any_label": (_FLAGS, "BOOLEAN", f"CAST({_summed(labels.SIX_FLAGS)} AS BIGINT) > 0"),
    "clamp_floor": ("x DOUBLE", "DOUBLE", "CASE WHEN x <= 0 THEN 0D ELSE x END"),
    "stratum_round": ("y DOUBLE", "BIGINT", "CAST(rint(y) AS BIGINT)"),
    "stratum_tenths": ("y DOUBLE", "BIGINT", "CAST(rint(y * 10) AS BIGINT)"),
}


def register(spark: SparkSession) -> list[str]:
    """Define all functions for the session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
