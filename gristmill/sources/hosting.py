"""A code host's pull requests over its REST API (driver side, injectable transport): diff, files, posting a review."""

from __future__ import annotations

import json
import re
import subprocess
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.functions import fixed


class HostError(RuntimeError):
    def __init__(self, kind: str, status: int):
        super().__init__(f"{kind} ({status})")
        self.kind, self.status = kind, status


def send(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=60) as r:
            return r.status, r.read().decode(errors="replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


KINDS = {401: "access denied", 403: "access denied", 404: "not found", 422: "review rejected"}


class Host:
    def __init__(self, token: str, base: str = "https://api.github.com", transport: Callable = send):
        if not token:
            raise HostError("access denied", 401)
        self.token, self.base, self.transport = token, base.rstrip("/"), transport

    def call(self, method: str, path: str, accept: str = "application/vnd.github+json", body: dict | None = None) -> str:
        headers = {"Authorization": f"Bearer {self.token}", "Accept": accept}
        status, text = self.transport(method, self.base + path, headers, json.dumps(body).encode() if body is not None else None)
        if status >= 300:
            raise HostError(KINDS.get(status, "request failed"), status)
        return text

    def pull_diff(self, owner: str, repo: str, number: int) -> str:
        return self.call("GET", f"/repos/{owner}/{repo}/pulls/{number}", "application/vnd.github.diff")

    def pull_files(self, spark: SparkSession, owner: str, repo: str, number: int, run_id: str = "pr") -> DataFrame:
        """(run_id, path, status); the first page of the list."""
        rows = json.loads(self.call("GET", f"/repos/{owner}/{repo}/pulls/{number}/files?per_page=100"))
        return spark.createDataFrame([(run_id, r["filename"], r.get("status", "")) for r in rows], "run_id string, path string, status string")

    def post_review(self, owner: str, repo: str, number: int, review: dict) -> None:
        self.call("POST", f"/repos/{owner}/{repo}/pulls/{number}/reviews", body=review)


def parse_remote(url: str) -> tuple[str, str] | None:
    """owner and repository of one URL; functions.expr.repo_of_url does columns."""
    url = url.removesuffix(".git")
    for form in fixed.REMOTES:
        if m := re.search(form, url):
            return m[1], m[2]
    return None


def detect_repo(cwd: str = ".") -> tuple[str, str] | None:
    done = subprocess.run(["git", "remote", "get-url", "origin"], cwd=cwd, capture_output=True, text=True)
    return parse_remote(done.stdout.strip()) if not done.returncode else None
