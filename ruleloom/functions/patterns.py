"""String patterns as Columns: globs, regular expressions and literals.

Each pattern becomes the cheapest equal expression: ``=``, ``startswith``, ``endswith`` and ``contains`` reach the
Parquet scan, ``like`` and ``rlike`` don't. Runs of white space in a value count as one space; where a pattern
can't tell the difference the value is left as it is, so that the filter still reaches the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.plans.rule import RuleError

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY, ONE = object(), object()


class UnsafeRegex(RuleError):
    """A regular expression that may take exponential time, or that the dialect lacks."""


@dataclass(frozen=True)
class RegexLimits:
    """Checks on regular expressions; Java's engine backtracks, so they matter here."""

    max_length: int = 1000
    max_depth: int = 10
    scan: bool = True
    check_nesting: bool = True


#: Shapes of patterns that backtrack without bound.
DANGEROUS = (
    r"\(\.\*\+\)\+",
    r"\(\.\+\*\)\*",
    r"\(\.\*\)\+\$",
    r"\(\.\+\)\*\$",
    r"\([a-zA-Z]+\)\*\$",
    r"\(.*\|.*\)\*",
    r"\(a\+\)\+",
    r"\(a\*\)\+",
    r"\(a\|a\)\*",
)
_NESTED = re.compile(r"\([^)]*[+*][^)]*\)[+*]")
_OVERLAPPING = ("(.*|.*)", "(.+|.+)", "([a-zA-Z]+)*$")
_UNSUPPORTED = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<")


def collapse(text: str) -> str:
    """White space of a pattern: runs become one space, none at the ends."""
    return " ".join(text.split())


def collapsed(value: Column) -> Column:
    """White space of a value: runs become one space, also at the ends."""
    return F.regexp_replace(value, r"(?U)\s+", " ")


def ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def check_regex(pattern: str, limits: RegexLimits = RegexLimits()) -> None:
    """Raise ``UnsafeRegex`` for patterns that are too long, too deep or likely to backtrack without bound."""
    if len(pattern.encode()) > limits.max_length:
        raise UnsafeRegex(f"a regular expression longer than {limits.max_length} bytes")
    if limits.scan and any(re.search(p, pattern) for p in DANGEROUS):
        raise UnsafeRegex(f"a regular expression of a dangerous shape: {pattern}")
    if not limits.check_nesting:
        return
    if not pattern:
        raise UnsafeRegex("an empty regular expression")
    depth = 0
    for c in pattern:
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        if depth > limits.max_depth:
            raise UnsafeRegex(f"a regular expression nested deeper than {limits.max_depth}")
    if _NESTED.search(pattern) or any(p in pattern for p in _OVERLAPPING):
        raise UnsafeRegex(f"a regular expression with nested repetition: {pattern}")


def java_regex(pattern: str, case_insensitive: bool = False) -> str:
    """A pattern of the rules' linear-time dialect in Java's: same classes, line ends and anchors."""
    plain = re.sub(r"\\\\", "", pattern)
    if _UNSUPPORTED.search(plain):
        raise UnsafeRegex(f"look-around and back-references aren't supported: {pattern}")
    out, in_class, i = [], False, 0
    multiline = re.search(r"\(\?[a-z]*m", pattern) is not None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            # Java would read a bracket inside a class as a nested class.
            out.append("\\[" if in_class and pattern[i : i + 2] != "[:" else "[")
            in_class = True
        elif c == "]" and in_class:
            out.append("]")
            in_class = False
        elif c == "$" and not in_class and not multiline:
            out.append("\\z")
        elif pattern.startswith("(?P<", i) and not in_class:
            out.append("(?<")
            i += 4
            continue
        else:
            out.append(c)
        i += 1
    text = "".join(out)
    try:
        re.compile(re.sub(r"\\z", r"\\Z", text).replace("(?<", "(?P<"))
    except re.error as e:
        if not re.search(r"\\[pPxuhH]|\[\[:|&&", text):  # constructs that only the JVM knows
            raise UnsafeRegex(f"not a regular expression: {pattern} ({e})") from e
    return ("(?Udi)" if case_insensitive else "(?Ud)") + text


def glob_tokens(pattern: str) -> list:
    """Literal texts, ``ANY`` and ``ONE``. A backslash makes the next wildcard literal; pairs stand for one."""
    out: list = []

    def literal(text: str) -> None:
        if out and isinstance(out[-1], str):
            out[-1] += text
        elif text:
            out.append(text)

    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = len(pattern) - i - len(pattern[i:].lstrip("\\"))
            i += n
            if i < len(pattern) and pattern[i] in "*?":
                literal("\\" * (n // 2))
                if n % 2:
                    literal(pattern[i])
                    i += 1
            else:
                literal("\\" * ((n + 1) // 2))
        elif c in "*?":
            if not (c == "*" and out and out[-1] is ANY):
                out.append(ANY if c == "*" else ONE)
            i += 1
        else:
            literal(c)
            i += 1
    return out


def _folded(value: Column, text: str, case_insensitive: bool) -> tuple[Column, str]:
    return (F.translate(value, UPPER, LOWER), ascii_lower(text)) if case_insensitive else (value, text)


def _spaces(value: Column, text: str, collapse_whitespace: bool) -> Column:
    return collapsed(value) if collapse_whitespace and any(c.isspace() for c in text) else value


def literal_match(kind: str, value: Column, text: str, case_insensitive: bool = False, collapse_whitespace: bool = True) -> Column:
    """``kind`` is exact, startswith, endswith or contains; the text has no wildcards."""
    value = _spaces(value, text, collapse_whitespace)
    value, text = _folded(value, text, case_insensitive)
    if kind == "exact":
        return value == F.lit(text)
    return getattr(value, kind)(F.lit(text))


def glob_match(value: Column, pattern: str, case_insensitive: bool = False, collapse_whitespace: bool = True) -> Column:
    """An anchored glob."""
    parts = glob_tokens(pattern)
    texts = [p for p in parts if isinstance(p, str)]
    shape = tuple("t" if isinstance(p, str) else "*" if p is ANY else "?" for p in parts)
    kinds = {(): "exact", ("t",): "exact", ("t", "*"): "startswith", ("*", "t"): "endswith", ("*", "t", "*"): "contains"}
    if shape in kinds:
        return literal_match(kinds[shape], value, texts[0] if texts else "", case_insensitive, collapse_whitespace)
    if shape == ("*",):
        return value.isNotNull() | F.lit(None).cast("boolean")
    text = "".join(re.sub(r"([\\%_])", r"\\\1", p) if isinstance(p, str) else "%" if p is ANY else "_" for p in parts)
    if collapse_whitespace and (ONE in parts or any(c.isspace() for p in texts for c in p)):
        value = collapsed(value)
    value, text = _folded(value, text, case_insensitive)
    return value.like(text)


def contains_match(value: Column, text: str, case_insensitive: bool = False, collapse_whitespace: bool = True) -> Column:
    """The text anywhere in the value; its wildcards count."""
    return glob_match(value, f"*{text}*", case_insensitive, collapse_whitespace)


def regex_match(value: Column, pattern: str, case_insensitive: bool = False, limits: RegexLimits = RegexLimits()) -> Column:
    """The expression anywhere in the value as it stands."""
    check_regex(pattern, limits)
    return value.rlike(java_regex(pattern, case_insensitive))
