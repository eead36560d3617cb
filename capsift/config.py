"""Configuration: scan limits, allow and deny lists, scores. Plain dictionaries, merged over defaults."""

from __future__ import annotations

import json
from pathlib import Path

# Imports that need no permission.
NODE_IMPORTS = [
    "buffer", "child_process", "crypto", "events", "fs", "fs/promises", "http", "https", "os", "path", "stream", "timers", "url", "util",
    "node:buffer", "node:child_process", "node:crypto", "node:events", "node:fs", "node:fs/promises", "node:http", "node:https", "node:os", "node:path", "node:stream", "node:timers", "node:url", "node:util",
]
PYTHON_IMPORTS = [
    "argparse", "collections", "datetime", "functools", "hashlib", "itertools", "json", "logging", "math", "os", "os.path", "pathlib", "re", "shutil", "subprocess", "sys", "tempfile", "typing", "urllib", "urllib.parse", "urllib.request",
]
# Limits, scores and thresholds.
DEFAULTS = {
    "scan": {"maxFileSize": 1_000_000, "maxFileCount": 100, "maxScanDepth": 5},
    "allowlist": {"languages": {"javascript": {"imports": NODE_IMPORTS}, "typescript": {"imports": NODE_IMPORTS}, "tsx": {"imports": NODE_IMPORTS}, "python": {"imports": PYTHON_IMPORTS}}, "network": {"domains": []}},
    "denylist": {"languages": {}, "network": {"domains": []}},
    "riskReport": {
        "baseScore": {"info": 0, "warning": 1, "critical": 5},
        "uplift": {"NETWORK:data_exfiltration": 5, "NETWORK:remote_code_execution": 5, "NETWORK:credential_leak": 7, "NETWORK:localhost_secret_exposure": 2},
        "thresholds": {"safe": 0, "caution": 1, "attention": 3, "risky": 5, "avoid": 7},
    },
}
# What an allowed tool grants (tool, scope, permission).
TOOL_GRANTS = {
    "Bash": ("bash", "sys", "shell"),
    "Read": ("read", "fs", "read"),
    "Write": ("write", "fs", "write"),
    "Edit": ("edit", "fs", "write"),
    "WebFetch": ("webfetch", "net", "fetch"),
    "Fetch": ("fetch", "net", "fetch"),
    "Subprocess": ("subprocess", "sys", "subprocess"),
}
# The frontmatter's known fields.
KNOWN_FIELDS = ["name", "description", "license", "compatibility", "metadata", "allowed-tools"]
DEFAULT_VERSION = "0.0.1"


def deep_merge(base: dict, over: dict | None) -> dict:
    """Values of `over` replace those of `base`, dictionaries are merged, lists replaced."""
    out = dict(base)
    for key, value in (over or {}).items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _union(*lists: list[str] | None) -> list[str]:
    return list(dict.fromkeys(x for values in lists for x in values or []))


def _merge_policy(base: dict, over: dict | None) -> dict:
    base, over = base or {}, over or {}
    mine, theirs = base.get("languages", {}), over.get("languages") or {}
    languages = {g: {"imports": _union((mine.get(g) or {}).get("imports"), (theirs.get(g) or {}).get("imports"))} for g in _union(list(mine), list(theirs))}
    return {"languages": languages, "network": {"domains": _union(base.get("network", {}).get("domains"), (over.get("network") or {}).get("domains"))}}


def resolve(config: dict | None = None) -> dict:
    """Limits and scores are merged over the defaults; allow and deny lists are joined with them, defaults first."""
    config = config or {}
    return {
        "scan": deep_merge(DEFAULTS["scan"], config.get("scan")),
        "allowlist": _merge_policy(DEFAULTS["allowlist"], config.get("allowlist")),
        "denylist": _merge_policy(DEFAULTS["denylist"], config.get("denylist")),
        "riskReport": deep_merge(DEFAULTS["riskReport"], config.get("riskReport")),
    }


def validate(config: object) -> dict:
    """The config itself, or a ValueError that names the first bad field. Scores and thresholds are passed on as they are."""
    if not isinstance(config, dict):
        raise ValueError("the config must be an object")
    for key, value in (config.get("scan") or {}).items():
        if key not in DEFAULTS["scan"] or isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
            raise ValueError(f"scan.{key} must be one of {', '.join(DEFAULTS['scan'])} and a number from 0")
    for name in ("allowlist", "denylist"):
        policy = config.get(name) or {}
        lists = [(f"{name}.languages.{g}.imports", (p or {}).get("imports")) for g, p in (policy.get("languages") or {}).items()]
        for where, values in [*lists, (f"{name}.network.domains", (policy.get("network") or {}).get("domains"))]:
            if values is not None and not (isinstance(values, list) and all(isinstance(x, str) for x in values)):
                raise ValueError(f"{where} must be a list of strings")
    return config


def load(path: str) -> dict:
    """A JSON file's config, validated."""
    return validate(json.loads(Path(path).read_text()))


def lookup(config: dict, dotted: str):
    """The value at a path such as scan.maxFileSize; a KeyError if there is none."""
    value = config
    for part in dotted.split("."):
        if not isinstance(value, dict) or part not in value:
            raise KeyError(dotted)
        value = value[part]
    return value


def names(values: list[str]) -> list[str]:
    """Policy names are compared without case and outer white space."""
    return sorted({v.strip().lower() for v in values})
