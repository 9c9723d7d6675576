"""Redaction and anonymisation of whole strings and records, key-aware in JSON.

What column expressions cannot say (skipping allowed addresses as a unit,
walking JSON of any shape) runs in one Arrow pass per row over JSON text.
"""

from __future__ import annotations

import json
import math
import posixpath
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from ipaddress import AddressValueError, IPv4Address
from urllib.parse import quote, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import secretscan as S

# Parts of key names that tell a path, an address or a command.
PATH_KEYS = ("path", "cwd", "dir", "file", "target", "dest", "root", "workspace")
URL_KEYS = ("url", "uri")
COMMAND_KEYS = ("command",)

_PATTERNS = [(re.compile(S.translate(p).replace("(?iu)", "(?i)")), g) for _, p, g in S.PATTERNS]
_EMAIL, _IPV4, _QUOTED = (re.compile(S.translate(p)) for p in (S.EMAIL, S.IPV4, S.QUOTED))
_PROVIDERS = [(words, re.compile(p)) for _, words, p in S.PROVIDERS]


#: What may not follow the end of a folder's name.
_EDGE = r"(?![A-Za-z0-9_.\-])"


def mode_of(key: str) -> str:
    """``path``, ``url`` or ``text`` by the name of the key a string stands under (commands count as text)."""
    k = key.lower()
    if any(p in k for p in PATH_KEYS):
        return "path"
    return "url" if any(u in k for u in URL_KEYS) else "text"


def large(value: str) -> bool:
    if len(value.encode("utf-8", "surrogatepass")) < 4096:
        return False
    return value.startswith("data:") and ";base64," in value or re.fullmatch(r"[A-Za-z0-9+/=\n\r]*", value) is not None


def shannon(value: str) -> float:
    n = len(value)
    return round(-sum(c / n * math.log2(c / n) for c in Counter(value).values()), 9) if n else 0.0


def reserved(address: str) -> bool:
    domain = address.lower().rpartition("@")[2]
    return domain in S.RESERVED_DOMAINS or domain.endswith(S.RESERVED_SUFFIXES)


def harmless_ip(value: str) -> bool:
    try:
        ip = IPv4Address(value)
    except AddressValueError:
        return True
    private = ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8)
    return value in S.WELL_KNOWN_DNS or any(int(ip) >> 32 - n == int(IPv4Address(net)) >> 32 - n for net, n in private)


@dataclass(frozen=True)
class Rules:
    """What to redact beside the fixed detectors: literals, handles, the home folder; and the marker."""

    literals: tuple[str, ...] = ()
    handles: tuple[str, ...] = ()
    home: str = ""
    marker: str = S.MARKER
    detectors: tuple[S.Detector, ...] = field(default_factory=S.registered)

    def token(self, name: str) -> str:
        return "anon_" + sha256(name.strip().lower().encode()).hexdigest()[:10]

    def secrets(self, value: str) -> tuple[str, int]:
        """Detectors, allow-lists, entropy and literals, in this order; with the number of replacements."""
        n = 0

        def whole(m: re.Match) -> str:
            nonlocal n
            n += 1
            return self.marker

        def grouped(m: re.Match) -> str:
            nonlocal n
            n += 1
            return m[1] + self.marker

        def unless(ok) -> object:  # noqa: ANN001
            return lambda m: m[0] if ok(m[0]) else whole(m)

        for words, pattern in [*_PROVIDERS, *((d.keywords, re.compile(d.pattern)) for d in self.detectors)]:
            if not words or any(w in value for w in words):
                value = pattern.sub(whole, value)
        for pattern, group in _PATTERNS:
            value = pattern.sub(grouped if group else whole, value)
        value = _EMAIL.sub(unless(reserved), value)
        value = _IPV4.sub(unless(harmless_ip), value)

        def quoted(m: re.Match) -> str:
            inner = m[0][1:-1]
            mixed = all(re.search(c, inner) for c in ("[A-Z]", "[a-z]", "[0-9]"))
            return f'"{whole(m)}"' if mixed and shannon(inner) >= 4.0 else m[0]

        value = _QUOTED.sub(quoted, value)
        for literal in sorted({x.strip() for x in self.literals if len(x.strip().encode()) >= 3}, key=lambda x: (-len(x.encode()), x)):
            n += value.count(literal)
            value = value.replace(literal, self.marker)
        return value, n

    def short_names(self, value: str) -> tuple[str, int]:
        """Handles of less than 4 bytes, which count only as the owner of a home folder."""
        n = 0
        for name in self.handles:
            name = name.strip()
            if name and len(name.encode()) < 4:
                value, k = re.subn(rf"(?:/Users/|/home/|C:\\Users\\){re.escape(name)}{_EDGE}", self.token(name), value)
                n += k
        return value, n

    def path_names(self, value: str) -> tuple[str, int]:
        """A path: cleaned and with short handles alone if it lies in the home folder, else as any text."""
        clean = posixpath.normpath(value)
        if self.home and (clean == self.home or clean.startswith(self.home + "/")):
            parent, _, owner = self.home.rpartition("/")
            out, n = self.short_names(f"{parent}/{self.token(owner)}{clean[len(self.home) :]}")
            return out, n + 1
        return self.names(value)

    def names(self, value: str) -> tuple[str, int]:
        """Home folder, short handles in home paths, long handles between word boundaries; a handle counts once a string."""
        n = 0
        if self.home:
            parent, _, owner = self.home.rpartition("/")
            value, n = re.subn(re.escape(self.home) + _EDGE, f"{parent}/{self.token(owner)}", value)
        value, k = self.short_names(value)
        n += k
        for name in self.handles:
            name = name.strip()
            if len(name.encode()) >= 4:
                new = re.sub(rf"(?i)(^|[^A-Za-z0-9_]){re.escape(name)}([^A-Za-z0-9_]|\Z)", lambda m, t=self.token(name): m[1] + t + m[2], value)
                n, value = n + (new != value), new
        return value, n

    def apply(self, value: str, mode: str = "text") -> tuple[str, int]:
        """One string by its mode; large binaries are left alone."""
        if not value or large(value):
            return value, 0
        value, n = self.secrets(value)
        if mode == "path":
            value, k = self.path_names(value)
            return value, n + k
        if mode == "url":
            try:
                u = urlsplit(value)
            except ValueError:
                u = None
            if u is not None and u.path and (u.scheme or value.startswith("/")):
                path, k = self.path_names(u.path)
                return (urlunsplit(u._replace(path=quote(path, safe="/%:@!$&'()*+,;=~-._[]"))) if k else value), n + k
        value, k = self.names(value)
        return value, n + k

    def walk(self, value: object, key: str = "") -> tuple[object, int]:
        """Every string of a JSON value, by the key it stands under; elements of arrays share their array's key."""
        if isinstance(value, str):
            return self.apply(value, mode_of(key))
        total = 0
        if isinstance(value, dict):
            out: object = {}
            for k, v in value.items():
                out[k], n = self.walk(v, k)  # type: ignore[index]
                total += n
            return out, total
        if isinstance(value, list):
            items = []
            for v in value:
                w, n = self.walk(v, key)
                items.append(w)
                total += n
            return items, total
        return value, 0


#: Signs that join the parts of a credential, and the least length of a part that is looked for by itself.
JOINTS, LEAST_PART = ":;,=|& \t\r\n\"'<>()[]{}", 8


def scrub_parts(value: str, raw: str, combined: str, marker: str = S.MARKER) -> tuple[str, int]:
    """A credential of several parts taken out of a text, and how often: ``combined`` as a whole, then ``raw``.

    Where the combined form does not stand in one piece, its other parts are
    looked for: what is left of it around ``raw``, or, if ``raw`` is no part of
    it, the first split whose halves both occur.
    """

    def take(part: str) -> int:
        nonlocal value
        n = value.count(part) if part else 0
        value = value.replace(part, marker) if n else value
        return n

    whole = take(combined)
    n = whole + (take(raw) if raw != combined else 0)
    if whole or not combined or raw == combined:
        return value, n
    if raw and raw in combined:
        n += sum([take(p.strip(JOINTS)) for p in combined.split(raw)])
        return value, n
    for i in range(LEAST_PART, len(combined) - LEAST_PART + 1):
        left, right = combined[:i], combined[i:]
        if left in value and right in value:
            n += take(left) + take(right)
            break
    return value, n


def redact_column(df: DataFrame, key: str, column: str, rules: Rules, mode: str = "text") -> DataFrame:
    """(key, redacted, redactions) of a string column; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, 0) if v is None else rules.apply(v, mode) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=[key, "redacted", "redactions"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, redacted string, redactions long")


def redact_json(df: DataFrame, key: str, column: str, rules: Rules) -> DataFrame:
    """(key, redacted, redactions) of a column of JSON text; text that is no JSON is redacted as text."""

    def one(value: str | None) -> tuple[str | None, int]:
        if value is None:
            return None, 0
        try:
            parsed = json.loads(value)
        except (ValueError, RecursionError):
            return rules.apply(value)
        out, n = rules.walk(parsed)
        return json.dumps(out, ensure_ascii=False), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [one(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=[key, "redacted", "redactions"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, redacted string, redactions long")


#: Fields of a record that redaction leaves alone.
UNTOUCHED = ("record_id", "origin", "model", "started_at", "ended_at")
_SKIP = {"role": (), "timestamp": (), "media_type": (), "data": ()}


def redact_records(records: DataFrame, rules: Rules) -> DataFrame:
    """Canonical records with every string redacted but ids, origin, model, times, roles, media types and data.

    The record travels as one JSON text through one Arrow pass and is parsed
    back with its own schema; adds ``redactions``.
    """
    schema = records.schema

    def walk(value: object, key: str) -> tuple[object, int]:
        if isinstance(value, dict):
            out, total = {}, 0
            for k, v in value.items():
                out[k], n = (v, 0) if k in _SKIP or k in UNTOUCHED else walk(v, k)
                total += n
            return out, total
        if isinstance(value, list):
            done = [walk(v, key) for v in value]
            return [d[0] for d in done], sum(d[1] for d in done)
        if isinstance(value, str):
            if key in ("input", "raw", "extensions"):
                try:
                    parsed = json.loads(value)
                except (ValueError, RecursionError):
                    return rules.apply(value)
                out, n = rules.walk(parsed, key)
                return json.dumps(out, ensure_ascii=False), n
            return rules.apply(value, mode_of(key))
        return value, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [walk(json.loads(v), "") for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(d[0], ensure_ascii=False) for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["j", "redactions"])

    text = records.select(F.to_json(F.struct("*")).alias("j")).mapInArrow(run, "j string, redactions long")
    return text.select(F.from_json("j", schema).alias("r"), "redactions").select("r.*", "redactions")
