"""The fixed detectors, in their order, for scan and redaction as column expressions.

Patterns are written once in the RE2 dialect, which DuckDB shares, and
translated to Java's: ASCII word boundaries, ``\\s`` without vertical tab,
Unicode case folding, absolute text ends.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import entropy, mixed_classes

MARKER = "[REDACTED]"

# Category, pattern, group that is the secret (0: all of the match).
PATTERNS = (
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)?\b", 0),
    ("db_url", r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s:@]+:[^/\s@]+@[^/\s]+", 0),
    ("cloud_key", r"\b(?:sk-[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9-]{10,}|hf_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{20,})\b", 0),
    ("pem", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", 0),
    ("cli_flag", r"(?i)(--(?:token|api[-_]?key|password|secret)(?:=|\s+))([^\s]+)", 2),
    ("env_assign", r"""\b([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|API[_-]?KEY|ACCESS[_-]?KEY)[A-Z0-9_]*=)([^\s'"]+)""", 2),
    ("generic_assign", r"""(?i)("?(?:token|secret|password|api[_-]?key|access[_-]?key)"?\s*[:=]\s*"?)([^",\s}]+)""", 2),
    ("password_value", r"(?i)(password[^:\n]{0,20}[:=]\s*)([^\s]+)", 2),
    ("query_secret", r"(?i)([?&](?:token|key|secret|api[_-]?key)=)([^&#\s]+)", 2),
    ("bearer", r"(?i)(authorization\s*:\s*bearer\s+)([^\s]+)", 2),
    ("webhook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/_-]+", 0),
    ("wallet_key", r"\b0x[a-fA-F0-9]{64}\b", 0),
)
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
QUOTED = r"""["'][A-Za-z0-9+/=_\-]{20,}["']"""
RESERVED_DOMAINS = ("localhost", "example.com", "example.org", "example.net")
RESERVED_SUFFIXES = (".localhost", ".example", ".test", ".invalid")
WELL_KNOWN_DNS = ("1.1.1.1", "1.0.0.1", "8.8.8.8", "8.8.4.4", "9.9.9.9")
# Local provider detectors: label, keywords, pattern.
PROVIDERS = (
    ("posthog", ("phx_", "phs_", "phc_"), r"(?<![A-Za-z0-9_-])ph[xsc]_[A-Za-z0-9_-]{32,}(?![A-Za-z0-9_-])"),
    ("sparkscan", ("ss_pk_", "ss_sk_"), r"ss_(?:pk|sk)_(?:live|test)_[A-Za-z0-9]{22,}"),
)



@dataclass(frozen=True)
class Detector:
    """A detector of one's own: its label, keywords of which a text must hold one, and a pattern of which all is the secret."""

    label: str
    keywords: tuple[str, ...]
    pattern: str


_REGISTERED: dict[str, Detector] = {}


def register(detector: Detector) -> None:
    """Make a detector known to the rules made from now on; a label can be taken once."""
    if detector.label in _REGISTERED or detector.label in {n for n, _, _ in PROVIDERS}:
        raise ValueError(f"there is a detector {detector.label!r} already")
    re.compile(detector.pattern)
    _REGISTERED[detector.label] = detector


def registered() -> tuple[Detector, ...]:
    return tuple(_REGISTERED.values())


def patterns_of(body: str) -> list[Detector]:
    """Detectors of a YAML document ``patterns: [{name, regex}]`` in block style; broken patterns are errors."""
    found: list[dict[str, str]] = []
    inside = False
    for line in body.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line[0].isspace() and not line.startswith("-"):
            inside = line.split(":")[0].strip() == "patterns"
            continue
        m = re.match(r"\s*(-\s+)?(name|regex):\s*(.*?)\s*$", line)
        if inside and m:
            if m[1]:
                found.append({})
            v = m[3]
            found[-1][m[2]] = v[1:-1].replace("''", "'") if v[:1] == "'" == v[-1:] else json.loads(v) if v[:1] == '"' == v[-1:] else v
    out = [Detector(f["name"], (), f["regex"]) for f in found if f.get("name") and f.get("regex")]
    for d in out:
        re.compile(d.pattern)
    return out


SPACE = r"\t\n\f\r "
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


#: A pattern that begins with a word character needs only the left half of its first boundary.
STARTS_WITH_WORD = re.compile(r"\\b(?:\(\?:|\()*(?:\[(?:[A-Za-z0-9_]-?)+\]|[A-Za-z0-9]|\\d)")

# Literals of which a match has at least one, in lower case; texts without them skip the pattern.
NEEDS = {
    "jwt": ("eyj",), "db_url": ("://",), "cloud_key": ("sk-", "gh", "akia", "xox", "hf_", "npm_"), "pem": ("-----begin",), "cli_flag": ("--",), "env_assign": ("=",), "generic_assign": ("token", "secret", "password", "key"),
    "password_value": ("password",), "query_secret": ("?", "&"), "bearer": ("authorization",), "webhook": ("hooks.slack.com",), "wallet_key": ("0x",), EMAIL: ("@",),
}
_NAME_OF = {p: n for n, p, _ in PATTERNS} | {EMAIL: EMAIL}


def _may_match(value: Column, pattern: str) -> Column | None:
    """A cheap test that every text with a match passes: letters are folded as the patterns fold them."""
    needs = NEEDS.get(_NAME_OF.get(pattern, ""))
    if needs is None:
        return None
    folded = F.lower(F.translate(value, "\u212a\u017f\u0131\u0130", "ksii"))
    test = F.contains(folded, F.lit(needs[0]))
    for n in needs[1:]:
        test = test | F.contains(folded, F.lit(n))
    return test


def translate(pattern: str) -> str:
    """A pattern of the RE2 dialect for Java (and Python) with the same matches."""
    out, inside, i = [], False, 0
    if STARTS_WITH_WORD.match(pattern):
        out, i = ["(?<![A-Za-z0-9_])"], 2
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not inside:
            out.append(BOUNDARY)
        elif two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out).replace("(?i)", "(?iu)")


def found(value: Column, pattern: str, group: int = 0) -> Column:
    all_ = F.regexp_extract_all(value, F.lit(translate(pattern)), F.lit(group))
    test = _may_match(value, pattern)
    # Null stays null.
    return all_ if test is None else F.when(test, all_).when(value.isNotNull(), F.array().cast("array<string>"))


def allowed_email(value: Column) -> Column:
    domain = F.regexp_extract(F.lower(value), r"@([^@]*)$", 1)
    suffix = F.lit(False)
    for s in RESERVED_SUFFIXES:
        suffix = suffix | domain.endswith(s)
    return domain.isin(*RESERVED_DOMAINS) | suffix


def allowed_ip(value: Column) -> Column:
    """Not a public address: unparsable (an octet over 255 or with leading zeros), private, or a well-known resolver."""
    octet = F.split(value, r"\.")
    n = lambda i: octet[i].cast("int")
    broken = F.exists(octet, lambda o: (o.cast("int") > 255) | ((F.length(o) > 1) & o.startswith("0")))
    private = n(0).isin(10, 127) | ((n(0) == 172) & n(1).between(16, 31)) | ((n(0) == 192) & (n(1) == 168))
    return broken | private | value.isin(*WELL_KNOWN_DNS)


def emails(value: Column) -> Column:
    return F.filter(found(value, EMAIL), lambda e: ~allowed_email(e))


def public_ips(value: Column) -> Column:
    return F.filter(found(value, IPV4), lambda e: ~allowed_ip(e))


def tokens(value: Column) -> Column:
    """Distinct secret values of all token patterns, in the order of the patterns."""
    return F.array_distinct(F.concat(*[found(value, p, g) for _, p, g in PATTERNS]))


def high_entropy(value: Column) -> Column:
    """Quoted values of at least 20 characters with entropy of 4 bits and mixed character classes."""
    inner = F.transform(found(value, QUOTED), lambda q: F.substr(q, F.lit(2), F.length(q) - 2))
    return F.filter(inner, lambda v: mixed_classes(v) & (entropy(v) >= 4.0))


def redact(value: Column, marker: str = MARKER) -> Column:
    """The token patterns applied one after another; text around a secret group stays."""
    quoted = re.sub(r"([\\$])", r"\\\1", marker)
    for _, pattern, group in PATTERNS:
        value = F.regexp_replace(value, translate(pattern), quoted if group == 0 else f"$1{quoted}")
    return value


def anonymize(value: Column, identifiers: list[str]) -> Column:
    """Each identifier of 4 bytes or more, between non-word characters, replaced by its token; both neighbours are consumed."""
    import hashlib

    for name in identifiers:
        if len(name.encode()) >= 4:
            token = "anon_" + hashlib.sha256(name.strip().lower().encode()).hexdigest()[:10]
            value = F.regexp_replace(value, rf"(?iu)(^|[^A-Za-z0-9_])(\Q{name}\E)([^A-Za-z0-9_]|\z)", f"$1{token}$3")
    return value
