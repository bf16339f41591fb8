"""Secrets in whole texts: fixed forms, and strings of high entropy by a sliding window.

Three forms are searched by pattern (``BASE``).  The method adds to them: candidate strings,
runs of the alphabet of base64, belong to a character class by the signs that they use, and a
window of the class's length slides over them.  Counts of its signs change by one sign in and
one sign out, and with them the sum of c*log2(c), kept in whole numbers, from which the
Shannon entropy of the window follows; windows that reach the class's bound are joined to spans.

An allow-list suppresses candidates (never a fixed form): what matches one of its patterns as a
whole, or holds one of its words, isn't searched.  Spans inside a fixed form's add nothing and
are left out.

Each text is read alone, by map tasks without a shuffle; a scan by RE2 over the batch tells
which texts have anything to look at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The forms of secrets and the least length of what is measured of a match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", re.compile(ASSIGN, re.I | re.A), 2, 12), ("access", re.compile(ACCESS), 0, 18), ("hex", re.compile(HEX), 0, 16))
#: The same forms for RE2, with their least lengths; it folds case over all of Unicode, so it finds more, never less.
SIEVE = ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", "AKIA[A-Z0-9]{14}", "[0-9a-f]{16}")

_SCALE = 1 << 20


@dataclass(frozen=True)
class SignClass:
    """Signs of a class, length of its window, and the bits a sign from which a window counts."""

    name: str
    signs: str
    window: int
    bits: float

    @property
    def most_sum(self) -> int:
        """The sum of c*log2(c) that a window may have at most: H = log2(W) - sum / W."""
        return int(self.window * (math.log2(self.window) - self.bits) * _SCALE)


#: The first class that has all signs of a candidate is its class.  No window of digits reaches the bits of theirs: long numbers aren't secrets.
CLASSES = (SignClass("digits", "0-9", 32, 9.0), SignClass("hex", "0-9a-fA-F", 24, 3.2), SignClass("base64", "A-Za-z0-9+/_=-", 24, 3.9))
#: Candidates that match as a whole: words without a digit, dates and numbers with dashes, UUIDs, paths of words, names in camel case.
ALLOWED = (r"[A-Za-z_/+=-]+", r"[a-z]*([A-Z][a-z]+)+[0-9]{0,4}", r"[0-9/_+=-]+", r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", r"([A-Za-z]*[0-9]{0,4}[/_-]+)+[A-Za-z]*[0-9]{0,4}")
#: Words of stand-ins; a candidate with one of them, in either case, is no secret.
STAND_INS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxxxx", "sha256-", "sha384-", "sha512-")

_CANDIDATE = re.compile(f"[{CLASSES[-1].signs}]{{{min(c.window for c in CLASSES)},}}")
_TABLE = [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, 1 + max(c.window for c in CLASSES))]


def entropy_windows(run: str, window: int, most_sum: int) -> Iterator[tuple[int, int]]:
    """Joined windows of a string whose sum of c*log2(c) is ``most_sum`` at most: (start, end)."""
    counts: dict[str, int] = {}
    total, start, end = 0, -1, -1
    for i, sign in enumerate(run):
        c = counts.get(sign, 0)
        counts[sign] = c + 1
        total += _TABLE[c + 1] - _TABLE[c]
        if i >= window:
            out = run[i - window]
            c = counts[out]
            counts[out] = c - 1
            total += _TABLE[c - 1] - _TABLE[c]
        if i >= window - 1 and total <= most_sum:
            first = i - window + 1
            if end < first:
                if end > 0:
                    yield start, end
                start = first
            end = i + 1
    if end > 0:
        yield start, end


class SecretFinder:
    """The forms, classes and allow-list of a search."""

    def __init__(self, classes=CLASSES, allowed=ALLOWED, stand_ins=STAND_INS):
        self.classes = [(re.compile(f"[{c.signs}]+"), c.window, c.most_sum) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None
        self.stand_ins = tuple(w.lower() for w in stand_ins)

    def permits(self, run: str) -> bool:
        low = run.lower()
        return any(w in low for w in self.stand_ins) or (self.allowed is not None and self.allowed.fullmatch(run) is not None)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed forms; a match that is too short is used up, but dropped."""
        found = [(m.start(), k, m.end()) for k, (_, form, group, least) in enumerate(BASE) for m in form.finditer(text) if m.end(group) - m.start(group) >= least]
        return sorted(found)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of high entropy that aren't inside a fixed form."""
        out, i, reach = [], 0, -1  # reach: the end of the fixed forms that begin at or before a place
        for m in _CANDIDATE.finditer(text):
            run = m[0]
            window, most_sum = next((w, s) for signs, w, s in self.classes if signs.fullmatch(run))
            if len(run) < window or self.permits(run):
                continue
            for a, b in entropy_windows(run, window, most_sum):
                while i < len(base) and base[i][0] <= m.start() + a:
                    reach = max(reach, base[i][2])
                    i += 1
                if m.start() + b > reach:
                    out.append((m.start() + a, len(BASE), m.start() + b))
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` by start, then kind, comma-joined; places are code points, ends exclusive."""
    names = [k for k, *_ in BASE] + ["entropy"]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, text_col: str = "text", finder: SecretFinder | None = None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base (spans of the fixed forms), spans (all) and base_sha256.

    Other columns pass unchanged; columns of ``docs`` with those six names are replaced.  A null or empty text
    has no spans, and the hash of an empty text.  Texts are read whole, whatever their length; repeated
    rows give repeated results, an empty table an empty one.  Matches of a form don't overlap each other, those of
    different forms may.
    """
    finder = finder or SecretFinder()
    made = ["n_assign", "n_access", "n_hex", "base", "spans", "base_sha256"]
    rest = [c for c in docs.columns if c not in made]
    sieve = (*SIEVE, _CANDIDATE.pattern)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_string())
            hit = None
            for pattern in sieve:
                found = pc.match_substring_regex(texts, pattern).fill_null(False)
                hit = found if hit is None else pc.or_(hit, found)
            rows = []
            for look, text in zip(hit, texts):
                base = finder.base(t := text.as_py()) if look.as_py() else []
                spans = joined(base)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(BASE))), spans, joined(base + finder.added(t, base)) if look.as_py() else "", hashlib.sha256(spans.encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * len(made)
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*rest, *made])

    schema = docs.select(*rest).schema
    for name in made:
        schema = schema.add(name, "long" if name[:2] == "n_" else "string")
    return docs.select(*rest).mapInArrow(run, schema)
