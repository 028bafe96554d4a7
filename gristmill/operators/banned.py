"""Banned patterns of a rules pack: which of thousands of regular expressions each section matches.

Most patterns contain a run of plain characters that every match has. All those runs are looked for at once, by one automaton, and only the patterns whose run a text holds are
tried on it, besides the few that have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shorter runs are in nearly every text, and save no trials.
LEAST_RUN = 3
#: Patterns go to every task, so their text is bounded.
MOST_BYTES = 16 << 20


def required_run(pattern: str) -> str:
    """The longest run of characters that each match of a pattern contains, lower-cased; '' if none is sure."""
    try:
        parsed = parser.parse(pattern)
    except re.error as e:
        raise ValueError(f"no regular expression: {pattern}") from e
    runs, now = [""], ""
    # other scripts' letters can match letters of another length, so only ASCII counts where case is ignored
    simple = lambda c: c < 128 if parsed.state.flags & re.IGNORECASE else True

    def walk(items: Iterator) -> None:
        nonlocal now
        for kind, value in items:
            if kind is op.LITERAL and simple(value):
                now += chr(value)
                continue
            if kind is op.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
                continue
            if kind is op.AT:
                continue
            runs.append(now)
            now = ""
            if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                walk(value[2])
                runs.append(now)
                now = ""

    walk(parsed)
    # an ignored case also lets k and s match two characters beyond ASCII
    parts = [p for r in [*runs, now] for p in (re.split("[kKsS]", r) if parsed.state.flags & re.IGNORECASE else [r])]
    return max(parts, key=len).lower() if parts else ""


class Patterns:
    """Compiled patterns with the index from runs to them."""

    def __init__(self, patterns: list[tuple[str, str]]):
        import ahocorasick

        self.compiled = {name: re.compile(p) for name, p in patterns}
        self.always: list[str] = []
        by_run: dict[str, list[str]] = {}
        for name, p in patterns:
            run = required_run(p)
            (by_run.setdefault(run, []) if len(run) >= LEAST_RUN else self.always).append(name)
        self.automaton = ahocorasick.Automaton() if by_run else None
        for run, names in by_run.items():
            self.automaton.add_word(run, names)
        if self.automaton:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> set[str]:
        found = set(self.always)
        if self.automaton:
            # character by character, as lower() of a whole text can change its length or a sigma by its place
            for _, names in self.automaton.iter("".join(c.lower() for c in text) if not text.isascii() else text.lower()):
                found.update(names)
        return found

    def matches(self, text: str | None) -> list[str]:
        return sorted(name for name in self.candidates(text or "") if self.compiled[name].search(text or ""))


def with_banned(sections: DataFrame, patterns: list[tuple[str, str]], text: str = "body") -> DataFrame:
    """sections with banned, the sorted ids of the patterns (id, regular expression) that their text matches; a null text matches what an empty one does."""
    if len({name for name, _ in patterns}) < len(patterns):
        raise ValueError("two patterns have one id")
    if sum(len(a.encode()) + len(b.encode()) for a, b in patterns) > MOST_BYTES:
        raise ValueError(f"patterns take over {MOST_BYTES} bytes")
    for _, p in patterns:
        required_run(p)  # a bad one is an error here, not in a task

    @F.arrow_udf("array<string>")
    def banned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Patterns(patterns)
        for texts in batches:
            yield pa.array([own.matches(t.as_py()) for t in texts], pa.list_(pa.string()))

    return sections.withColumn("banned", banned(text))
