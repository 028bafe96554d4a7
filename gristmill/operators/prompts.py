"""Prompts as expressions: a builder maps a table's columns to the text of a request (any Column factory can take its place)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import fixed
from gristmill.functions.expr import languages_of

ANSWER = f"""Answer with nothing but a JSON array. Each element is an object with the string fields severity ({", ".join(fixed.SEVERITIES)}), category ({", ".join(fixed.CATEGORIES)}), title, message, suggestion and path, the number confidence between 0 and 1, the integers startLine and endLine, and tags, a list of strings. Nothing to report is []."""
DIFF_SYSTEM = "You review changes to code. Judge only what the diff changes; look for defects, security holes, slow or wrong code rather than taste. Be brief, and say how to mend each problem, at the diff's line numbers.\n" + ANSWER
CODEBASE_SYSTEM = "You review whole source files. Look for defects, security holes, slow or wrong code and weak design rather than taste. Be brief, and say how to mend each problem, at the files' line numbers.\n" + ANSWER


@dataclass
class Rules:
    """A rules pack: areas to stress, severities by category, checks that must be made (id, text)."""

    focus: list[str] = field(default_factory=list)
    severity_overrides: dict[str, str] = field(default_factory=dict)
    required: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Rules | None:
        import json

        if not path:
            return None
        with open(path) as f:
            raw = json.load(f)
        return cls(raw.get("focus") or [], raw.get("severityOverrides") or {}, [(r.get("id", ""), r.get("text", "")) for r in raw.get("required") or []])

    def text(self) -> str:
        """The rules' part of a prompt; categories in sorted order, so that equal rules give equal prompts."""
        parts = []
        if self.focus:
            parts.append(f"\nFocus on: {', '.join(self.focus)}.\n")
        if self.severity_overrides:
            parts.append("\nSeverities by policy:\n" + "".join(f"- {c}: {s}\n" for c, s in sorted(self.severity_overrides.items())))
        if self.required:
            parts.append("\nAlways check:\n" + "".join(f"- [{i}] {t}\n" for i, t in self.required))
        return "".join(parts)


def prompt(body: Column, files: Column, kind: str = "diff", max_findings: int = 0, per_file: int = 0, fail_on: str = "none", rules: Rules | None = None) -> Column:
    """The user's part of a request for a diff ('diff') or whole files ('codebase'). The limit per file is only asked for, not enforced."""
    languages = languages_of(files)
    parts = [F.lit("Review this diff.\n\n" if kind == "diff" else "Review these source files.\n\n")]
    if max_findings > 0:
        parts.append(F.lit(f"Report at most {max_findings} findings.\n"))
    if kind == "codebase" and per_file > 0:
        parts.append(F.lit(f"Report at most {per_file} findings for a file.\n"))
    if fail_on not in ("", "none"):
        parts.append(F.lit(f"Findings of severity {fail_on} or higher matter most.\n"))
    parts.append(F.when(F.size(languages) > 0, F.concat(F.lit("Languages: "), F.array_join(languages, ", "), F.lit("\n"))).otherwise(F.lit("")))
    mark = "DIFF" if kind == "diff" else "FILES"
    return F.concat(*parts, F.lit((rules.text() if rules else "") + f"\n--- BEGIN {mark} ---\n"), body, F.lit(f"\n--- END {mark} ---\n"))
