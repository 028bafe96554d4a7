"""Configuration in layers: defaults, file, environment, flags. Unset is None in every layer, so false and 0 can be set."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    provider: str = "replay"
    model: str = ""
    compare: tuple[str, ...] = ()
    format: str = "text"
    fail_on: str = "none"
    max_findings: int = 50
    context_lines: int = 3
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ("vendor/**", "**/*.gen.go", "**/dist/**")
    max_diff_bytes: int = 500_000
    chunk_bytes: int = 500_000
    rules_file: str = ""
    cache_enabled: bool = True
    cache_dir: str = ""
    cache_ttl_seconds: int = 86_400
    redact_secrets: bool = True
    redact_paths: tuple[str, ...] = field(default=("**/.env", "**/*secrets*"))


KINDS = {f.name: type(f.default) for f in fields(Config)}
ENV = {"GRISTMILL_PROVIDER": "provider", "GRISTMILL_MODEL": "model", "GRISTMILL_FAIL_ON": "fail_on", "GRISTMILL_FORMAT": "format", "GRISTMILL_MAX_FINDINGS": "max_findings", "GRISTMILL_CONTEXT_LINES": "context_lines"}


def typed(key: str, value) -> object:
    """value as the field's type; text is parsed."""
    if key not in KINDS:
        raise KeyError(f"unknown setting: {key}")
    kind = KINDS[key]
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("true", "false"):
            raise ValueError(f"{key} must be true or false")
        return value.lower() == "true"
    if kind is int:
        try:
            return int(value)
        except ValueError:
            raise ValueError(f"{key} must be an integer, got {value!r}") from None
    if kind is tuple:
        return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
    return value


def layer(base: Config, over: Mapping[str, object]) -> Config:
    return replace(base, **{k: typed(k, v) for k, v in over.items() if v is not None and v != ""})


def config_dir() -> str:
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "gristmill")


def config_path() -> str:
    return os.path.join(config_dir(), "config.json")


def load_file(path: str) -> dict:
    """Only what the file sets; nothing if there is none."""
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def load(flags: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None, path: str | None = None) -> Config:
    env = os.environ if env is None else env
    out = layer(Config(), load_file(path or config_path()))
    out = layer(out, {k: env[v] for v, k in ENV.items() if env.get(v)})
    flags = dict(flags or {})
    if more := flags.pop("exclude", None):
        out = replace(out, exclude=out.exclude + tuple(more))
    if paths := flags.pop("paths", None):
        out = replace(out, include=tuple(paths))
    return layer(out, flags)


def set_field(key: str, value: str, path: str | None = None) -> dict:
    """Change one setting of the file and nothing else in it."""
    path = path or config_path()
    held = load_file(path) | {key: typed(key, value)}
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(held, f, indent=2)
        f.write("\n")
    return held


def init(path: str | None = None) -> str:
    """Write the defaults where there is no file yet; the file's path."""
    path = path or config_path()
    if os.path.exists(path):
        raise ValueError(f"{path} is there already")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(show(Config()) + "\n")
    return path


def show(config: Config) -> str:
    return json.dumps(asdict(config), indent=2)
