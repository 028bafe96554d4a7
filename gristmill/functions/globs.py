"""Path globs compiled to Java regexes on the driver, so that matching is one rlike in the plan.

``*`` and ``**`` stay within a path segment, ``?`` is one character of it, ``[...]`` a class and ``\\`` quotes.
A malformed glob matches nothing. A leading ``**/`` also tries the rest against the base name (and, for
filters, the whole path). ``recursive=True`` lets ``**`` cross segments.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = r"(?!)"


def regex_of(glob: str, recursive: bool = False) -> str:
    """An anchored Java regex; NEVER for a malformed glob."""
    out, i, n = [], 0, len(glob)
    quote = lambda c: re.escape(c)
    while i < n:
        c = glob[i]
        if c == "*":
            run = len(glob) - len(glob[i:].lstrip("*")) - i
            out.append(".*" if recursive and run > 1 else "[^/]*")
            i += run
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == n:
                return NEVER
            out.append(quote(glob[i]))
        elif c == "[":
            parsed = char_class(glob, i + 1)
            if parsed is None:
                return NEVER
            out.append(parsed[0])
            i = parsed[1]
            continue
        else:
            out.append(quote(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def char_class(glob: str, i: int) -> tuple[str, int] | None:
    """The regex of a class whose body starts at i, and where it ends; None if it is malformed."""
    negated = glob[i : i + 1] == "^"
    i += negated
    parts: list[str] = []

    def one(j: int) -> tuple[str, int] | None:
        if j >= len(glob) or glob[j] in "-]":
            return None
        if glob[j] == "\\":
            return (glob[j + 1], j + 2) if j + 1 < len(glob) else None
        return glob[j], j + 1

    while not (glob[i : i + 1] == "]" and parts):
        if (low := one(i)) is None:
            return None
        lo, i = low
        hi = lo
        if glob[i : i + 1] == "-":
            if (high := one(i + 1)) is None:
                return None
            hi, i = high
        if i >= len(glob):
            return None
        if lo <= hi:
            parts.append(f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}")
        else:
            parts.append("[^\\x{0}-\\x{10ffff}]")
    body = "".join(parts)
    return (f"(?!/)[^{body}]" if negated else f"(?!/)[{body}]"), i + 1


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def matches_any(path: Column, globs: list[str], whole_rest: bool = True, recursive: bool = False) -> Column:
    """Whether any glob matches. whole_rest: after a leading ``**/`` try the rest on the whole path too."""
    tests = []
    for g in globs:
        tests.append(path.rlike(regex_of(g, recursive)))
        if g.startswith("**/"):
            rest = regex_of(g[3:], recursive)
            tests.append(base_name(path).rlike(rest))
            if whole_rest:
                tests.append(path.rlike(rest))
    return reduce(lambda a, b: a | b, tests, F.lit(False))
