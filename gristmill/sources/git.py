"""Git as a source: the driver runs git and makes a one-row table of a diff, or a table of commits or files."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import fixed
from gristmill.operators import sections
from gristmill.schemas import COMMIT, DIFF


class GitError(RuntimeError):
    pass


def git(*args: str, cwd: str = ".", tolerate: bool = False) -> str:
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, errors="replace")
    if done.returncode and not (tolerate and done.stdout):
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def diff_args(context: int = 3, include: list[str] = ()) -> list[str]:
    """Lines of context and, as a pushed-down filter, what to include (**/* is everything)."""
    paths = [p for p in include if p != "**/*"]
    return ([f"-U{context}"] if context > 0 else []) + ["--", *paths]


def range_of(rev: str, merge_base: bool) -> str:
    return rev.replace("..", "...", 1) if merge_base and "..." not in rev else rev


def repo_meta(cwd: str = ".") -> dict[str, str]:
    out = {"root": git("rev-parse", "--show-toplevel", cwd=cwd).strip()}
    for k, args in (("head", ("rev-parse", "HEAD")), ("branch", ("rev-parse", "--abbrev-ref", "HEAD"))):
        try:
            out[k] = git(*args, cwd=cwd).strip()
        except GitError:
            out[k] = ""
    return out


class GitSource:
    """Diffs of one working copy as tables; excludes and the byte limit are part of the plan."""

    def __init__(self, spark: SparkSession, cwd: str = ".", context: int = 3, max_bytes: int = 500_000, include: list[str] = (), exclude: list[str] = ()):
        self.spark, self.cwd, self.context, self.max_bytes, self.include, self.exclude = spark, cwd, context, max_bytes, list(include), list(exclude)

    def frame(self, rows: list[tuple[str, str, str, str]], files: list[str] | None = None) -> DataFrame:
        """A diff per row (run_id, diff, mode, range), all in one plan; files: those of a single diff, if they are known."""
        repo = None if rows and rows[0][2] == "snippet" else repo_meta(self.cwd)
        table = self.spark.createDataFrame([(run, diff, files, mode, rev, repo) for run, diff, mode, rev in rows], DIFF)
        if files is None:
            parts = sections.exclude_sections(sections.split_sections(table.select("run_id", "diff")), self.exclude)
            kept = parts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("section_ord", "body"))).alias("s")).select("run_id", F.array_join("s.body", "").alias("kept"))
            files_of = sections.exclude_files(sections.diff_files(F.col("diff")), self.exclude)
            table = table.withColumn("files", files_of).join(kept, "run_id", "left").withColumn("diff", F.coalesce("kept", F.lit(""))).drop("kept")
        return table.withColumn("diff", sections.limit_diff(F.col("diff"), self.max_bytes)).select(*DIFF.names)

    def table(self, diff: str, mode: str, rev: str = "", files: list[str] | None = None) -> DataFrame:
        return self.frame([(mode, diff, mode, rev)], files)

    def run(self, *args: str) -> str:
        return git("diff", *args, *diff_args(self.context, self.include), cwd=self.cwd)

    def unstaged(self) -> DataFrame:
        return self.table(self.run(), "unstaged")

    def staged(self) -> DataFrame:
        return self.table(self.run("--cached"), "staged")

    def commit_diff(self, sha: str, parent: str = "") -> str:
        try:
            return self.run(parent or f"{sha}~1", sha)
        except GitError:
            # a first commit has no parent
            return git("show", "--format=", sha, *diff_args(self.context, self.include), cwd=self.cwd)

    def commit(self, sha: str, parent: str = "") -> DataFrame:
        return self.table(self.commit_diff(sha, parent), "commit", sha)

    def range(self, rev: str, merge_base: bool = False) -> DataFrame:
        rev = range_of(rev, merge_base)
        return self.table(self.run(rev), "range", rev)

    def snippet(self, content: str, path: str, base: str = "") -> DataFrame:
        """A new file, or the change from base (by difflib: close to git's diff, not the same)."""
        if base:
            import difflib

            lines = difflib.unified_diff(base.splitlines(True), content.splitlines(True), f"a/{path}", f"b/{path}")
            diff = f"diff --git a/{path} b/{path}\n" + "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in lines)
            return self.table(diff, "snippet", files=[path])
        one = self.spark.createDataFrame([(path, content)], "path string, content string")
        return self.table(one.select(sections.added_diff(F.col("path"), F.col("content"))).first()[0], "snippet", files=[path])

    def commits(self, rev: str, merge_base: bool = False) -> DataFrame:
        """(commit_ord, sha, subject), oldest first."""
        out = git("log", "--reverse", "--format=%H%x09%s", range_of(rev, merge_base), cwd=self.cwd)
        return self.spark.createDataFrame([(i, *line.split("\t", 1)) for i, line in enumerate(out.splitlines())], COMMIT)

    def per_commit(self, rev: str, merge_base: bool = False) -> DataFrame:
        """The diffs of all commits of a range as one table, run_id their sha, so that all are reviewed in one job."""
        found = self.commits(rev, merge_base)
        diffs = self.frame([(c["sha"], self.commit_diff(c["sha"]), "commit", c["sha"]) for c in found.collect()])
        return diffs.join(found.select(F.col("sha").alias("run_id"), "commit_ord"), "run_id")

    def files(self) -> DataFrame:
        """Tracked files (run_id, path, content, length), read by executors and filtered before content is looked at."""
        names = [n for n in git("ls-files", "-z", cwd=self.cwd).split("\0") if n]
        root = os.path.abspath(self.cwd)
        uris = [f"file://{root}/{n}" for n in names if os.path.isfile(f"{root}/{n}") and os.path.getsize(f"{root}/{n}") <= fixed.FILE_BYTES]
        if not uris:
            return self.spark.createDataFrame([], "run_id string, path string, content binary, length long")
        rows = self.spark.read.format("binaryFile").load([u.replace("*", r"\*").replace("?", r"\?").replace("[", r"\[").replace("{", r"\{") for u in uris])
        path = F.expr(f"substr(path, locate('{root}/', path) + {len(root) + 1})")
        return rows.select(F.lit("codebase").alias("run_id"), path.alias("path"), "content", "length")

    def codebase(self) -> DataFrame:
        """Sections of all tracked text files within the byte budget, in path order."""
        return sections.codebase_sections(self.files(), self.max_bytes, self.include, self.exclude)
