"""Secret scans: fixed patterns, and assignments read with a small lexer.

The lexer reads name-literal pairs of source and configuration syntax (``name = "x"``,
``name: x``, ``"name": "x"``, ``name = other + "x"``), keeps a table of constants so that
literals reach the names they flow into, and scores each literal by the most sensitive name
it reaches and by its own shape.  Literals at or above a threshold are reported where they
stand.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevscale.llm.frames import per_batch

# The patterns, least lengths and kinds that define the base spans.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "literal")

# How much a name says that its value is secret.
SENSITIVE = (
    ("private_key", 1.0), ("privatekey", 1.0), ("password", 1.0), ("passwd", 1.0), ("passphrase", 1.0),
    ("secret", 0.9), ("credential", 0.8), ("api_key", 0.9), ("apikey", 0.9), ("access_key", 0.9),
    ("auth_token", 0.9), ("token", 0.7), ("pwd", 0.8), ("auth", 0.5),
)
THRESHOLD = 0.8
# What any name with a score has: ``name_score`` reads a hyphen as an underscore.
_HINT = re.compile("|".join(sorted({n.replace("_", "[-_]") for n, _ in SENSITIVE})), re.I)
_NAME = r"[A-Za-z_$][\w$-]{0,127}(?:\.[A-Za-z_$][\w$-]{0,127}){0,8}"
# ``var name type = x`` of Go: either word may be the name, as in ``const String name = x``.
_PAIR = re.compile(
    rf"""(?<![\w.$-])(?:(?:var|const)[ \t]+(?P<declared>[A-Za-z_$][\w$]{{0,127}})[ \t]+)?["']?(?P<name>{_NAME})["']?"""
    r"""[ \t]*(?P<op>:=|=>|=(?!=)|\??:(?!:))[ \t]*"""
)
_PREFIX = r"(?:[A-Za-z]{1,2}8?|[@$]{1,2})?"  # of strings: b, r, f, u8, @ and the like
# What stands between ``name:`` and the value of a typed declaration.
_TYPE = re.compile(
    r"""[&*]{0,2}(?:'static[ \t]+)?(?P<type>[A-Za-z_$][\w$.:]{0,127})(?:<[^<>\n=]{0,64}>|\[[^\[\]\n=]{0,64}\]){0,2}[?!]?"""
    r"""(?:[ \t]*\|[ \t]*[A-Za-z_$][\w$.]{0,127}){0,3}"""
    rf"""(?:[ \t]+=[ \t]+|[ \t]*=[ \t]*(?={_PREFIX}["']))"""
)
# A string or a bare word.  ``+`` is a character of a word, unless blanks or quotes stand beside it.
_PART = re.compile(
    rf"""[ \t]*(?:{_PREFIX}(?P<quoted>"{{3}}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{{3}}|'{{3}}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{{3}}"""
    r"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<word>(?:[^\s"',;)}\]+]|\+(?=[^\s"']))(?:[^\s"',;)}\]+]|\+(?=[^\s"']|[ \t]*(?:[\r\n]|\Z)))*))[ \t]*(?P<plus>\+)?"""
)
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\Z")
# A call, a subscript or a placeholder filled in elsewhere, as in ``load(x)``, ``os.environ["X"]``, ``${X}``.
_COMPUTED = re.compile(r"[A-Za-z_$][\w$]*+(?:(?:\.|::|->|\?\.)[\w$]++)*+[(\[{]|[$%][({]|\{\{|<%")
# Names and words of prose: parts of two letters and more in one case or capitalized, no digit.
_WORDLIKE = re.compile(r"(?:[_$.:/<>-]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+))++[_$.:/<>?!-]*+\Z")
# Types and keywords where a value could stand: ``password: string`` declares, it does not assign.
_RESERVED = frozenset(
    "string String undefined nullptr boolean Boolean integer Integer number Number function lambda".split()
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    plain = name.lower().replace("-", "_")
    return max((s for n, s in SENSITIVE if n in plain), default=0.0)


def literal_score(value: str) -> float:
    """0 to 1: short, repetitive or wordlike literals score low."""
    if len(value) < LEAST_VALUE:
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(map(t, value)) for t in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, bits / 4) * (0.6 + 0.1 * kinds)


def _is_literal(word: str) -> bool:
    """Whether a bare word can be a value by itself."""
    return word not in _RESERVED and not _COMPUTED.match(word) and not _WORDLIKE.match(word)


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive name, directly or through other names.

    A name keeps the literals of its latest assignment; assignments are read in text order.
    A bare word that is no constant read before is a literal, unless it is a reserved word, an
    identifier in a sum, a call, a subscript, a placeholder or made of plain words.  Strings may
    have prefixes, and declarations types.  An assignment keeps links to those it reads, and
    weights go back along them once at the end, so time is linear in the text.
    """
    if not _HINT.search(text):
        return []
    latest: dict[str, int] = {}  # name to its assignment
    weights: list[float] = []
    literals: list[list[tuple[int, int]]] = []
    reads: list[list[int]] = []
    at = 0
    while pair := _PAIR.search(text, at):
        names, start = [n for n in (pair["declared"], pair["name"]) if n], pair.end()
        reached: list[tuple[int, int]] = []
        sources: list[int] = []
        weight = max(map(name_score, names))
        if pair["op"].endswith(":") and (typed := _TYPE.match(text, start)):
            start, weight = typed.end(), max(weight, name_score(typed["type"]))
        place, quoted, joined = start, False, False
        while part := _PART.match(text, place):
            place, word = part.end(), part["word"]
            if word is None:
                quoted = quoted or not joined
                edge = 3 if len(part["quoted"]) >= 6 and part["quoted"][:3] in ('"' * 3, "'" * 3) else 1
                reached.append((part.start("quoted") + edge, part.end("quoted") - edge))
            elif word in latest:
                sources.append(latest[word])
            else:
                pieces = word.split("+")
                known = [p for p in pieces if p in latest]
                sources.extend(latest[p] for p in known)
                variable = (joined or part["plus"]) and _IDENTIFIER.match(word)
                if len(known) < len(pieces) and not variable and _is_literal(word):
                    reached.append(part.span("word"))
            if not part["plus"]:
                break
            joined = True
        if start > pair.end() and not quoted and _is_literal(typed["type"]):
            reached.append(typed.span("type"))  # ``name: value = x`` may as well be a bare value
        latest.update(dict.fromkeys(names, len(weights)))
        weights.append(weight)
        literals.append(reached)
        reads.append(sources)
        at = place if quoted else start
    scores: dict[tuple[int, int], float] = {}
    for i in range(len(weights) - 1, -1, -1):  # an assignment reads earlier ones only
        if weights[i]:
            for source in reads[i]:
                weights[source] = max(weights[source], weights[i])
            for span in literals[i]:
                scores[span] = max(scores.get(span, 0.0), weights[i])
    return [
        ("literal", a, b) for (a, b), weight in sorted(scores.items())
        if weight * (0.5 + literal_score(text[a:b])) >= threshold and b - a >= LEAST_VALUE
    ]


def find_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Per row: doc_id and all spans as arrays of (kind, start, end), in code points.

    Spans are ordered by start, then kind.  A null text is empty and has none; every text is
    read whole; repeated rows and null ids are scanned like any other.
    """

    def rows(batch: dict[str, list]) -> dict[str, object]:
        found = []
        for text in batch["text"]:
            text = text or ""
            spans = base_spans(text) + lexed_spans(text, threshold)
            spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        return {"doc_id": batch["doc_id"], "spans": found}

    return per_batch(
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
        "doc_id long, spans array<struct<kind: string, start: long, end: long>>",
        rows,
    )


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans, written out."""
    wrote = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(wrote(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        wrote(F.col("spans")).alias("spans"),
    )
