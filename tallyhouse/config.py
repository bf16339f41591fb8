"""Settings with their defaults; a value that can't be read leaves the default."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

_UNIT = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")


def duration(text: str) -> float | None:
    """Seconds of a text such as ``1m30s``; None if it isn't one."""
    body = text.lstrip("+-")
    if body == "0":
        return 0.0
    if not body or _PART.sub("", body) or len(text) - len(body) > 1:
        return None
    return (-1 if text[0] == "-" else 1) * sum(float(n) * _UNIT[u] for n, u in _PART.findall(body))


@dataclass(frozen=True)
class Config:
    done_percent: int = 90
    stale_messages: int = 1000
    close_grace: float = 1.0
    hard_timeout: float = 300.0
    vote_batch_size: int = 10_000
    issue_limit: int = 1000
    stale_mode: str = "code"  # or "spec": only messages since the poll's last one count

    def __post_init__(self):
        if self.close_grace <= 0:  # no grace at all loses votes of workers not yet seen
            object.__setattr__(self, "close_grace", 1.0)

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> "Config":
        names = {"done_percent": "DONE_PERCENT", "stale_messages": "COMMIT_STALE_MESSAGES", "close_grace": "CLOSE_GRACE", "hard_timeout": "CLOSE_HARD_TIMEOUT", "vote_batch_size": "VOTE_BATCH_SIZE", "issue_limit": "COOKIE_ISSUE_LIMIT"}
        found = {}
        for f in fields(cls):
            raw = env.get(names.get(f.name, ""), "")
            value = duration(raw) if f.type == "float" else int(raw) if re.fullmatch(r"[+-]?\d+", raw) else None
            if value is not None:
                found[f.name] = value
        return cls(**found)
