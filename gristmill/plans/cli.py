"""Command line: review <unstaged|staged|commit|range|snippet|codebase>, pr <number>, config, cache, models, hook, version."""

from __future__ import annotations

import argparse
import os
import re
import sys
import time
import uuid
from dataclasses import dataclass
from enum import IntEnum

from gristmill.plans import config as cf


class Exit(IntEnum):
    OK = 0
    FINDINGS = 1
    USAGE = 2
    AUTH = 3
    RUNTIME = 4


@dataclass
class Outside:
    """What a run takes from outside, so that tests can hand in their own: the session, makers of clients for models (by label) and for the code host."""

    spark: object = None
    make: object = None
    host: object = None

    def session(self):
        from pyspark.sql import SparkSession

        return self.spark or SparkSession.builder.getOrCreate()

    def maker(self):
        from gristmill.sources.providers import provider

        return self.make or (lambda label: provider(*label.split(":", 1)))


def review_flags(p: argparse.ArgumentParser) -> None:
    for name in ("provider", "model", "format", "fail-on", "rules-file", "compare", "out", "exclude", "paths"):
        p.add_argument(f"--{name}", default="")
    for name in ("max-findings", "context-lines", "max-diff-bytes"):
        p.add_argument(f"--{name}", type=int)
    for name in ("no-redact", "no-cache"):
        p.add_argument(f"--{name}", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("gristmill")
    sub = top.add_subparsers(dest="command", required=True)
    review = sub.add_parser("review")
    review.add_argument("mode", choices=["unstaged", "staged", "commit", "range", "snippet", "codebase"])
    review.add_argument("rev", nargs="?", default="")
    review_flags(review)
    for name in ("path", "base", "parent"):
        review.add_argument(f"--{name}", default="")
    for name in ("merge-base", "per-commit"):
        review.add_argument(f"--{name}", action="store_true")
    pull = sub.add_parser("pr")
    pull.add_argument("number", type=int)
    review_flags(pull)
    for name in ("owner", "repo"):
        pull.add_argument(f"--{name}", default="")
    pull.add_argument("--dry-run", action="store_true")
    config = sub.add_parser("config")
    config.add_argument("action", choices=["init", "show", "set", "path"])
    config.add_argument("key", nargs="?")
    config.add_argument("value", nargs="?")
    cache = sub.add_parser("cache")
    cache.add_argument("action", choices=["stats", "clear"])
    models = sub.add_parser("models")
    models.add_argument("action", choices=["list", "doctor"])
    for name in ("provider", "model"):
        models.add_argument(f"--{name}", default="")
    hook = sub.add_parser("hook")
    hook.add_argument("action", choices=["install", "uninstall"])
    hook.add_argument("--fail-on", default="high")
    hook.add_argument("--format", default="text")
    hook.add_argument("--max-findings", type=int, default=50)
    sub.add_parser("version")
    return top


def parts(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def settings(args: argparse.Namespace) -> cf.Config:
    flags = {k: getattr(args, k) for k in ("provider", "model", "format", "fail_on", "rules_file", "compare", "max_findings", "context_lines", "max_diff_bytes")}
    flags |= {"exclude": parts(args.exclude), "paths": parts(args.paths)}
    # a flag that turns something off is unset unless it is given
    return cf.load(flags | ({"redact_secrets": False} if args.no_redact else {}) | ({"cache_enabled": False} if args.no_cache else {}))


def labels_of(c: cf.Config) -> list[str]:
    """provider:model of each model to compare; ValueError for what isn't one."""
    labels = [x for x in c.compare if x]
    for x in labels:
        name, _, model = x.partition(":")
        if not name or not model:
            raise ValueError(f"not provider:model: {x}")
    return labels


def cache_of(spark, c: cf.Config):
    from gristmill.operators.cache import ResultCache

    return ResultCache(spark, c.cache_dir or cf.config_dir() + "/cache")


def judged(sections, c: cf.Config, outside: Outside, kind: str = "diff", max_findings: int | None = None):
    """The outcome of a review of sections, by one model or as a comparison of several; what is printed about it goes to stderr."""
    from gristmill.operators import prompts
    from gristmill.operators import review as rv

    limit = c.max_findings if max_findings is None else max_findings
    asking = {"kind": kind, "chunk_bytes": c.chunk_bytes, "max_findings": limit, "rules": prompts.Rules.load(c.rules_file), "redact_paths": list(c.redact_paths), "secrets": c.redact_secrets, "fail_on": c.fail_on}
    if not c.redact_secrets:
        print("secrets are not redacted", file=sys.stderr)
    if labels := labels_of(c):
        outcome, counts = rv.compare(sections, outside.maker(), labels, **asking)
        for r in counts.orderBy("model_idx").collect():
            print(f"{labels[r['model_idx']]}: {r['n_total']} findings, {r['n_unique']} of them its own", file=sys.stderr)
        return outcome
    store = cache_of(outside.session(), c) if c.cache_enabled else None
    return rv.review(sections, outside.maker(), f"{c.provider}:{c.model}", store=store, ttl_seconds=c.cache_ttl_seconds, **asking)


def exit_of(rows: list[dict], c: cf.Config) -> Exit:
    ranks = {"low": 1, "medium": 2, "high": 3}
    hit = c.fail_on not in ("", "none") and any(ranks.get(r["severity"], 0) >= ranks.get(c.fail_on, 0) for r in rows)
    return Exit.FINDINGS if hit else Exit.OK


def millis(since: float) -> int:
    return int(1000 * (time.time() - since))


def run_review(args: argparse.Namespace, outside: Outside) -> int:
    from gristmill.operators import review as rv
    from gristmill.operators import sections
    from gristmill.operators.findings import per_commit
    from gristmill.plans import render
    from gristmill.sources.git import GitSource, repo_meta

    c = settings(args)
    labels_of(c)
    spark, start = outside.session(), time.time()
    src = GitSource(spark, ".", c.context_lines, c.max_diff_bytes, list(c.include), list(c.exclude))
    diffs = found = None
    if args.mode == "commit":
        diffs = src.commit(args.rev, args.parent)
    elif args.mode == "range":
        diffs = src.per_commit(args.rev, args.merge_base) if args.per_commit else src.range(args.rev, args.merge_base)
    elif args.mode == "snippet":
        diffs = src.snippet(sys.stdin.read(), args.path or "snippet", open(args.base).read() if args.base else "")
    elif args.mode != "codebase":
        diffs = getattr(src, args.mode)()
    git_ms = millis(start)
    if diffs is None:
        outcome = judged(sections.numbered(src.codebase()), c, outside, kind="codebase")
    else:
        diffs = diffs.where(~sections.is_blank(diffs["diff"]))
        outcome = judged(rv.sections_of(diffs, list(c.exclude)), c, outside, max_findings=0 if args.per_commit else None)
    found = outcome.findings
    if args.per_commit:
        found = per_commit(found.join(diffs.select("run_id", "commit_ord"), "run_id").withColumnRenamed("run_id", "commit").selectExpr("*", "'range' as run_id"), c.max_findings)
    rows = render.rows_of(found)
    repo = repo_meta() if args.mode != "snippet" else None
    render.write(render.report(rows, uuid.uuid4().hex, args.mode, args.rev, repo, llm_ms=outcome.llm_ms, total_ms=millis(start), git_ms=git_ms), c.format, args.out)
    return exit_of(rows, c)


def run_pull(args: argparse.Namespace, outside: Outside) -> int:
    """Review a pull request's diff and, unless it is a dry run, post what was found."""
    from pyspark.sql import functions as F

    from gristmill.operators import review as rv
    from gristmill.operators.findings import split_inline
    from gristmill.plans import render
    from gristmill.sources import hosting

    c, start = settings(args), time.time()
    labels_of(c)
    owner, repo = args.owner, args.repo
    if not owner or not repo:
        found = hosting.detect_repo()
        if found is None:
            raise RuntimeError("no repository found: give --owner and --repo")
        owner, repo = owner or found[0], repo or found[1]
    host = outside.host() if outside.host else hosting.Host(os.environ.get("GITHUB_TOKEN", ""))
    spark = outside.session()
    text = host.pull_diff(owner, repo, args.number)
    if not text.strip():
        print("nothing to review")
        return Exit.OK
    diffs = spark.createDataFrame([("pr", text)], "run_id string, diff string")
    files = host.pull_files(spark, owner, repo, args.number)
    outcome = judged(rv.sections_of(diffs, list(c.exclude)), c, outside)
    rows = render.rows_of(split_inline(outcome.findings, files.select(F.lit("pr").alias("run_id"), "path")))
    render.write(render.report(rows, uuid.uuid4().hex, "pr", f"#{args.number}", llm_ms=outcome.llm_ms, total_ms=millis(start)), c.format, args.out)
    if not args.dry_run:
        host.post_review(owner, repo, args.number, render.review_payload(rows))
    return exit_of(rows, c)


def run_models(args: argparse.Namespace, outside: Outside) -> int:
    """The providers and the variables that hold their keys, or a call to one of them."""
    from gristmill.sources.providers import APIS, Request

    if args.action == "list":
        for name, api in APIS.items():
            print(f"{name}:<model>  {' or '.join(api.key_vars)}{'' if api.key_needed else ' (not needed)'}")
        return Exit.OK
    c = cf.load({"provider": args.provider, "model": args.model})
    outside.maker()(f"{c.provider}:{c.model}").review(Request("Answer with the word ready.", "Are you there?", 10))
    print(f"{c.provider} answers")
    return Exit.OK


def run_config(args: argparse.Namespace) -> int:
    if args.action == "set":
        cf.set_field(args.key, args.value)
    if args.action == "init":
        print(cf.init())
    else:
        print(cf.config_path() if args.action == "path" else cf.show(cf.load()))
    return Exit.OK


#: Our part of a pre-commit hook.
HOOK = re.compile(r"# gristmill begins\n.*?# gristmill ends\n", re.DOTALL)


def run_hook(args: argparse.Namespace) -> int:
    """Put a review of what is staged into the pre-commit hook, or take it out; what else the hook does stays. Findings stop a commit, failures don't."""
    from gristmill.sources.git import git

    path = os.path.join(git("rev-parse", "--git-dir").strip(), "hooks", "pre-commit")
    rest = ""
    if os.path.exists(path):
        with open(path) as f:
            rest = HOOK.sub("", f.read())
    if args.action == "uninstall" and rest.strip() in ("", "#!/bin/sh"):
        if os.path.exists(path):
            os.remove(path)
        return Exit.OK
    if args.action == "install":
        call = f"{sys.executable} -m gristmill.plans.cli review staged --fail-on {args.fail_on} --format {args.format} --max-findings {args.max_findings}"
        rest = rest or "#!/bin/sh\n"
        rest += "" if rest.endswith("\n") else "\n"
        rest += f"# gristmill begins\n{call}\nfound=$?\nif [ $found -eq {Exit.FINDINGS:d} ]; then exit 1; fi\nif [ $found -ne 0 ]; then echo 'not reviewed' >&2; fi\n# gristmill ends\n"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(rest)
    os.chmod(path, 0o755)
    return Exit.OK


def run_cache(args: argparse.Namespace, outside: Outside) -> int:
    from pyspark.sql import functions as F

    from gristmill.operators.cache import stats

    c = cf.load()
    held = cache_of(outside.session(), c)
    if args.action == "clear":
        held.clear()
    else:
        print(stats(held.entries(), F.current_timestamp(), c.cache_ttl_seconds).first().asDict())
    return Exit.OK


def main(argv: list[str] | None = None, outside: Outside | None = None) -> int:
    from gristmill.sources.hosting import HostError
    from gristmill.sources.providers import AuthError

    outside = outside or Outside()
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return Exit.USAGE if e.code else Exit.OK
    runs = {"review": lambda: run_review(args, outside), "pr": lambda: run_pull(args, outside), "config": lambda: run_config(args), "models": lambda: run_models(args, outside), "cache": lambda: run_cache(args, outside), "hook": lambda: run_hook(args), "version": lambda: print("gristmill 0") or Exit.OK}
    try:
        return runs[args.command]()
    except (KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return Exit.USAGE
    except (AuthError, HostError) as e:
        print(e, file=sys.stderr)
        return Exit.AUTH if isinstance(e, AuthError) or e.status in (401, 403) else Exit.RUNTIME
    except Exception as e:  # the command line's last resort
        print(e, file=sys.stderr)
        return Exit.RUNTIME


if __name__ == "__main__":
    sys.exit(main())
