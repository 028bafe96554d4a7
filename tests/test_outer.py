"""Providers, configuration, git, rendering, streaming: what stands around the plans."""

import json
import subprocess

import pytest

from gristmill.plans import cli, render
from gristmill.plans import config as cf
from gristmill.sources import git as g
from gristmill.sources import hosting
from gristmill.sources import providers as p

ROW = {"id": "1", "severity": "high", "category": "bug", "title": "T", "message": "m " * 60, "suggestion": "return x", "confidence": 0.825, "path": "a.go", "start_line": 1, "end_line": 2, "commit": "", "tags": ["t"]}


def test_retry_and_errors(monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    answers, waits = [(429, ""), (500, ""), (200, json.dumps({"choices": [{"message": {"content": "[]"}}]}))], []
    r = p.HttpReviewer("openai", "o3-x", send=lambda *a: answers.pop(0), sleep=waits.append)
    assert r.review(p.Request("s", "u")).content == "[]" and len(waits) == 2
    with pytest.raises(p.AuthError):
        p.HttpReviewer("openai", "m", send=lambda *a: (401, "")).review(p.Request("s", "u"))
    assert "max_completion_tokens" in p.chat_body("o3-x", p.Request("s", "u")) and "max_tokens" in p.chat_body("m", p.Request("s", "u"))
    with pytest.raises(p.ProviderError):
        p.provider("nobody", "m")


def test_config_layers(tmp_path):
    path = str(tmp_path / "c.json")
    cf.set_field("fail_on", "high", path)
    c = cf.load({"exclude": ["x/**"], "max_findings": 7}, {"GRISTMILL_FORMAT": "json"}, path)
    assert (c.fail_on, c.format, c.max_findings, c.redact_secrets, c.exclude[-1]) == ("high", "json", 7, True, "x/**")
    with pytest.raises(ValueError):
        cf.load({}, {"GRISTMILL_MAX_FINDINGS": "many"}, path)
    with pytest.raises(KeyError):
        cf.set_field("nothing", "1", path)


def test_formats():
    r = render.report([ROW], "run", "staged")
    assert "82% sure" in render.as_text(r) and "[!!] HIGH" in render.as_text(r) and "```go\nreturn x" in render.as_markdown(r)
    assert json.loads(render.as_sarif(r))["runs"][0]["results"][0]["level"] == "error" and json.loads(render.as_json(r))["summary"]["highestSeverity"] == "high"
    pr = render.review_payload([ROW | {"inline_line": 2}, ROW | {"inline_line": None}])
    assert pr["comments"][0]["line"] == 2 and "Outside the diff" in pr["body"]
    assert "Nothing to report" in render.as_text(render.report([], "run", "staged"))


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "vendor").mkdir()
    for name in ("main.go", "vendor/lib.go"):
        (tmp_path / name).write_text("package x\n")
    run("add", ".")
    src = g.GitSource(spark, str(tmp_path), exclude=["vendor/**"])
    assert src.staged().first()["files"] == ["main.go"] and "vendor" not in src.staged().first()["diff"]
    run("commit", "-qm", "first")
    sha = src.commits("HEAD").first()
    assert sha["subject"] == "first" and "main.go" in src.commit(sha["sha"]).first()["diff"]
    assert [r["path"] for r in src.codebase().collect()] == ["main.go"]
    assert src.snippet("a\nb", "f.py").first()["diff"].count("\n+") == 3


def test_hosting():
    h = hosting.Host("t", transport=lambda m, u, hd, b: (404, ""))
    with pytest.raises(hosting.HostError) as e:
        h.pull_diff("o", "r", 1)
    assert e.value.kind == "not found"


def test_problem_agrees_with_the_parser(spark):
    from pyspark.sql import functions as F

    from gristmill.operators import findings as fd
    from gristmill.operators.review import problem

    texts = ["[]", "null", "```json\n[]\n```", "```\n```", "", "junk", "{}", "[1]", "[null]", "[{}]", '[{"title": 1}]', '[{"title": null, "tags": []}]', '[{"tags": [1]}]', '[{"tags": ["a"], "startLine": 3}]', '[{"startLine": 3.5}]', '[{"startLine": "3"}]', '[{"confidence": 1}]', '[{"confidence": true}]', "[] []", "[", '[{"a": 1, "a": 2}]', '[{"Title": 4}]', '[{"confidence": NaN}]']
    # what elements have in common must not hide one of them
    texts += ['[{"title": "a"}, null]', '[{"title": "a"}, {"title": 1}]', '[{"title": "a"}, 3]', '[{"tags": [null]}, {"tags": ["a"]}]', '[{"tags": []}, {"tags": [1]}]', '[{"startLine": 1}, {"startLine": 2.5}]', '[{"startLine": 1}, {}]', '[{"title": null}, {"title": "a"}]', '[{"confidence": 1}, {"confidence": 0.5}]', '[{"confidence": 1}, {"confidence": "x"}]']
    texts += ["[]], [[]", "[],[]", '[],"b":[]', '[],"c":[]', "[]}", '[]},{"a":[]']
    texts += ['[{"title": "a", "extra": {"title": 1}}]', '[{"extra": 1}, {"title": 1}]', '[{"path": "STRING>>"}]', '[{"title": ["a"]}]', '[{"title": {"a": "b"}}]', '[[]]', '[{"title": "a"}, []]', '[{"startLine": true}]', '[{"tags": "a"}]', '[{"tags": [["a"]]}]']
    got = {r["t"]: r["ok"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fd.valid_answer(fd.strip_fence(F.col("t"))).alias("ok")).collect()}
    assert got == {t: not problem(t) for t in texts}
    many = '[{"title": "a", "startLine": 2, "confidence": 1, "tags": ["x", null]}, {"title": null, "startLine": 99999999999, "path": "p", "confidence": 0.25}, {"other": [1]}]'
    rows, _ = fd.parse_findings(spark.createDataFrame([(many,), (many.replace(', {"other": [1]}', ""),)], "content string"))
    want = [(0, "a", "", 2, 1.0, ["x", None]), (1, "", "p", 0, 0.25, [])]
    assert sorted((r["ord"], r["title"], r["path"], r["start_line"], r["confidence"], r["tags"]) for r in rows.collect()) == sorted(want * 2 + [(2, "", "", 0, 0.0, [])])


FINDING = {"severity": "high", "category": "bug", "title": "Bad loop", "message": "m", "suggestion": "", "confidence": 0.9, "path": "main.py", "startLine": 1, "endLine": 2, "tags": []}


class Scripted:
    """A model that says what it is told to; it appends each request to a file, as it runs in tasks."""

    name = "scripted"

    def __init__(self, log, *answers):
        self.log, self.answers = log, list(answers)

    def review(self, request):
        with open(self.log, "a") as f:
            f.write(json.dumps([request.system_prompt, request.user_prompt]) + "\n")
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(answer, Exception):
            raise answer
        return p.Response(answer if isinstance(answer, str) else json.dumps(answer))


@pytest.fixture
def work(spark, tmp_path, monkeypatch):
    """A repository with a staged secret, own settings, and a run of the command line in it."""
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "conf"))
    for args in (["init", "-q"], ["remote", "add", "origin", "https://host.example/own/rep.git"]):
        subprocess.run(["git", *args], cwd=tmp_path, check=True)
    (tmp_path / "main.py").write_text("password = 'hunter2hunter2'\n")
    subprocess.run(["git", "add", "main.py"], cwd=tmp_path, check=True)
    log = str(tmp_path / "log")

    class Work:
        def run(self, *args, makers=None, answers=("[]",), host=None):
            make = (lambda label: makers[label]) if makers else (lambda label: Scripted(log, *answers))
            return cli.main([*args], cli.Outside(spark, make, (lambda: host) if host else None))

        def asked(self):
            try:
                with open(log) as f:
                    return [json.loads(x) for x in f]
            except FileNotFoundError:
                return []

        def report(self):
            return json.loads((tmp_path / "out.json").read_text())

    w = Work()
    w.log = log
    return w


REVIEW = ["review", "staged", "--format", "json", "--out", "out.json"]


def test_review_finds_and_redacts(work):
    assert work.run(*REVIEW, "--no-cache", "--fail-on", "high", answers=[[FINDING]]) == cli.Exit.FINDINGS
    r = work.report()
    assert [f["title"] for f in r["findings"]] == ["Bad loop"] and r["timing"]["llmMs"] <= r["timing"]["totalMs"] and r["repo"]["root"]
    assert "hunter2" not in work.asked()[0][1] and "[REDACTED]" in work.asked()[0][1]
    assert work.run(*REVIEW, "--no-cache", "--no-redact") == cli.Exit.OK and "hunter2" in work.asked()[-1][1]


def test_review_errors_fail(work):
    assert work.run(*REVIEW, "--no-cache", answers=[p.AuthError("denied")]) == cli.Exit.AUTH
    assert work.run(*REVIEW, "--no-cache", answers=[p.ProviderError("down")]) == cli.Exit.RUNTIME
    assert work.run(*REVIEW, "--no-cache", answers=["junk", "junk"]) == cli.Exit.RUNTIME
    n = len(work.asked())
    assert work.run(*REVIEW, "--no-cache", answers=["junk [", [FINDING]]) == cli.Exit.OK and len(work.report()["findings"]) == 1
    repair = work.asked()[n + 1][1]
    assert "junk [" in repair and "Expecting value" in repair


def test_the_first_error_wins(spark):
    from gristmill.operators import review as rv

    class ByChunk:
        def review(self, request):
            raise p.ProviderError("second") if "two" in request.user_prompt else p.AuthError("first")

    text = "".join(f"diff --git a/{x} b/{x}\n+++ b/{x}\n+{x}\n" for x in ("one", "two"))
    parts = rv.sections_of(spark.createDataFrame([("r", text)], "run_id string, diff string"))
    with pytest.raises(p.AuthError, match="chunk 0: first"):
        rv.review(parts, lambda label: ByChunk(), "a:b", chunk_bytes=40)


def test_cache_answers_again(work):
    assert work.run(*REVIEW, answers=[[FINDING]]) == cli.Exit.OK and len(work.asked()) == 1
    assert work.run(*REVIEW, answers=["junk"]) == cli.Exit.OK and len(work.asked()) == 1
    assert [f["title"] for f in work.report()["findings"]] == ["Bad loop"]
    assert work.run(*REVIEW, "--no-cache", answers=[[]]) == cli.Exit.OK and len(work.asked()) == 2
    assert work.run("cache", "stats") == cli.Exit.OK and work.run("cache", "clear") == cli.Exit.OK
    assert work.run(*REVIEW, answers=[[]]) == cli.Exit.OK and len(work.asked()) == 3


def test_compare(work):
    own = FINDING | {"title": "Slow query here", "startLine": 40, "endLine": 41}
    makers = {"a:x": Scripted(work.log, [FINDING]), "b:y": Scripted(work.log, [FINDING | {"severity": "low"}, own])}
    assert work.run(*REVIEW, "--compare", "a:x,b:y", makers=makers) == cli.Exit.OK
    assert [(f["title"], f["severity"]) for f in work.report()["findings"]] == [("Bad loop", "high"), ("Slow query here", "high")]
    assert work.run(*REVIEW, "--compare", "a:x,nothing") == cli.Exit.USAGE
    assert work.run(*REVIEW, "--compare", "a:x,b:y", makers=makers | {"b:y": Scripted(work.log, "junk")}) == cli.Exit.RUNTIME


def test_codebase_has_its_prompt(work):
    assert work.run("review", "codebase", "--no-cache", "--format", "json", "--out", "out.json", answers=[[FINDING]]) == cli.Exit.OK
    system, user = work.asked()[0]
    assert system.startswith("You review whole source files") and "BEGIN FILES" in user and "main.py" in user


def test_per_commit(work):
    subprocess.run("git -c user.name=t -c user.email=t@t commit -qm one; echo 'x = 1' > b.py; git add b.py; git -c user.name=t -c user.email=t@t commit -qm two; echo 'y = 1' > c.py; git add c.py; git -c user.name=t -c user.email=t@t commit -qm three", shell=True, check=True)
    assert work.run("review", "range", "HEAD~2..HEAD", "--per-commit", "--no-cache", "--format", "json", "--out", "out.json", answers=[[FINDING]]) == cli.Exit.OK
    assert len(work.asked()) == 2 and len(work.report()["findings"]) == 1 and len(work.report()["findings"][0]["locations"][0]["commit"]) == 7


def test_pull_request(work):
    diff = "diff --git a/main.py b/main.py\n+++ b/main.py\n+x\n"
    calls = []

    def transport(method, url, headers, body):
        calls.append((method, url, body and json.loads(body)))
        if method == "POST":
            return 200, "{}"
        return 200, json.dumps([{"filename": "main.py"}]) if "/files" in url else diff

    host = hosting.Host("t", transport=transport)
    assert work.run("pr", "7", "--no-cache", "--out", "out.txt", answers=[[FINDING, FINDING | {"path": "else.py", "title": "Away"}]], host=host) == cli.Exit.OK
    method, url, body = calls[-1]
    assert method == "POST" and url.endswith("/repos/own/rep/pulls/7/reviews") and [c["line"] for c in body["comments"]] == [2] and "Away" in body["body"]
    n = len(calls)
    assert work.run("pr", "7", "--no-cache", "--dry-run", "--out", "out.txt", host=host) == cli.Exit.OK and all(c[0] == "GET" for c in calls[n:])
    assert work.run("pr", "7", host=hosting.Host("t", transport=lambda *a: (401, ""))) == cli.Exit.AUTH
    assert work.run("pr", "7", host=hosting.Host("t", transport=lambda *a: (404, ""))) == cli.Exit.RUNTIME


def test_config_and_models(work, capsys):
    assert work.run("config", "init") == cli.Exit.OK and work.run("config", "init") == cli.Exit.USAGE
    assert work.run("config", "set", "fail_on", "high") == cli.Exit.OK and work.run("config", "show") == cli.Exit.OK
    assert '"fail_on": "high"' in capsys.readouterr().out
    assert work.run("models", "list") == cli.Exit.OK and work.run("models", "doctor", answers=["ready"]) == cli.Exit.OK
    assert work.run("models", "doctor", answers=[p.AuthError("no")]) == cli.Exit.AUTH and work.run("models", "doctor", answers=[p.ProviderError("no")]) == cli.Exit.RUNTIME


def test_hook(work, tmp_path):
    path = tmp_path / ".git/hooks/pre-commit"
    path.parent.mkdir(exist_ok=True)
    for before in (None, "#!/bin/sh\necho mine"):
        if before:
            path.write_text(before)
        assert work.run("hook", "install") == cli.Exit.OK and work.run("hook", "install", "--fail-on", "low") == cli.Exit.OK
        text = path.read_text()
        assert text.count("review staged") == 1 and "--fail-on low" in text and text.startswith(before or "#!/bin/sh\n") and path.stat().st_mode & 0o100
        assert work.run("hook", "uninstall") == cli.Exit.OK and (path.read_text().strip() == before if before else not path.exists())


def test_entry_warns_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "gristmill.llm", None)
    monkeypatch.delitem(sys.modules, "gristmill.llm.queries", raising=False)
    with pytest.warns(UserWarning, match="no training-data operators"):
        importlib.reload(e)
    assert e.queries() and not any(q.startswith("op") for q in e.queries())
    monkeypatch.undo()
    importlib.reload(e)


def test_cli():
    assert cli.main(["review", "nothing"]) == cli.Exit.USAGE and cli.main(["version"]) == cli.Exit.OK


def test_shared_folder_of_a_cluster_must_be_named():
    from types import SimpleNamespace as N

    from gristmill.sources.shared import shared_base

    jsc = N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))
    for master in ("yarn", "spark://a:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_base(N(conf=N(get=lambda *a: None), sparkContext=N(master=master, _jsc=jsc)))


def test_stream(spark, tmp_path):
    from gristmill.streaming.gates import dedupe_stream

    spark.sql("select 'r' as run_id, 'i' as id, 'high' as severity, timestamp '2024-01-01 00:00:00' as ts union all select 'r', 'i', 'high', timestamp '2024-01-01 00:01:00'").write.parquet(str(tmp_path / "in"))
    s = dedupe_stream(spark.readStream.schema("run_id string, id string, severity string, ts timestamp").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 1
