"""Credentials embedded in source code and tool traffic.

Candidate values are read off the places where a literal can stand (after a
telling name, in a URL's user part, an authorisation header, a command-line
flag, quotes, a PEM block). Each is described by its character Markov
likelihood under the corpus, its make-up, the surrounding identifiers and the
path of its file. A few narrow patterns label some candidates weakly; a
logistic regression trained on those, calibrated on held-out ones, scores them
all, and decides alone on the many that no pattern labels. High scores are
redacted, and only the value's own characters are replaced, so code and JSON
around it stay valid.

The corpus is read once: that pass sends the candidates (a few per text at
most that hold any) and, per batch, a fixed-size table of character pairs.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

MARK = "[SECRET]"
#: The classifier is fitted on about this many weakly labelled candidates at most, taken by hash.
TRAINING_ROWS = 40_000
THRESHOLD = 0.5

# Public key prefixes of providers.
PREFIX = r"(?:sk-|pk_live_|sk_live_|rk_live_|gh[pousr]_|github_pat_|glpat-|glk-|AKIA|ASIA|xox[abposr]-|hf_|npm_|pypi-|ph[xsc]_|ss_[sp]k_|eyJ|AIza|SG\.|dop_v1_|shpat_|lin_api_)"
_NAME = r"(?:[Pp]ass(?:w(?:or[dt])?|phrase|wd)?|PASS(?:W(?:OR[DT])?|PHRASE|WD)?|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi_?-?[Kk]ey|API_?KEY|[Pp]rivate_?-?[Kk]ey|PRIVATE_?KEY|[Aa]ccess_?-?[Kk]ey|ACCESS_?KEY|[Cc]redential|CREDENTIAL|_auth|_AUTH|_key|_KEY|[Kk]ennwort)"
_VALUE = r"[^\s\"'\\,;<>(){}\[\]$`|]"
NAMED = re.compile(rf"({_NAME}[\w\-]{{0,60}})[\"'\]\\)]{{0,4}}[ \t]{{0,4}}(?::=|=>|=|:)(?:[ \t\"'\\(]|\\n)*({_VALUE}{{6,}})", re.A)
QUOTED = re.compile(r"[\"']([A-Za-z0-9+/=_\-]{14,})(?=\\?[\"'])", re.A)
KNOWN = re.compile(rf"(?<![A-Za-z0-9_\-])({PREFIX}[A-Za-z0-9_\-.]{{12,}})", re.A)
URL = re.compile(r"[a-z][a-z0-9+.\-]{1,20}://(?:([^\s:@/\"'\\]*):([^\s@/\"'\\]+)|([^\s:@/\"'\\]{12,}))@", re.A)
HEADER = re.compile(rf"(?:Bearer|Basic|[Tt]oken|[Kk]ey:|Digest)[ ]+({_VALUE}{{8,}})", re.A)
FLAG = re.compile(rf"(?:^|[\s\"])--?(?:p|pw|pass|password|token|secret|api-?key|auth|key)[ =]+\\?[\"']?({_VALUE}{{6,}})", re.A)
USER_FLAG = re.compile(rf"[\s\"](?:-u|--user)[ =]*\\?[\"']?[^\s:\"'\\]+(?::|\s+-p\s?)({_VALUE}{{4,}})", re.A)
LOGIN = re.compile(rf"[Ll]ogin(?: is|:)?\s+\S+\s+(?:/|password|pass|pw)\s+({_VALUE}{{4,}})", re.A)
QUERY = re.compile(r"[?&](?:token|key|sig|signature|access_token|api_?key|password|secret|auth)=([^&\s\"'\\]{6,})", re.A | re.I)
HOOK = re.compile(r"hooks?\.[\w.\-]+/(?:services/)?((?:[A-Za-z0-9]+/){1,3}[A-Za-z0-9]{12,})", re.A)
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)(PRIVATE|PUBLIC) KEY(?: BLOCK)?-----((?:\s|\\[nr]|[+\- ]|[A-Za-z0-9/=:,])*?)(?:-----END|(?=[^\sA-Za-z0-9+/=:,\\\-])|$)", re.A)
#: name of the place -> (pattern, text that must occur first)
PLACES = {
    "pem": (PEM, "-----BEGIN"), "url": (URL, "://"), "header": (HEADER, " "), "flag": (FLAG, "-"), "user_flag": (USER_FLAG, "-"),
    "login": (LOGIN, "ogin"), "query": (QUERY, "="), "hook": (HOOK, "hook"), "known": (KNOWN, ""), "named": (NAMED, ""), "quoted": (QUOTED, ""),
}
_FLAGS = ("p", "pw", "pass", "password", "token", "secret", "api-key", "apikey", "auth", "key")
#: Literals of which every match of a place has one; texts without them skip its pattern.
_TRIGGERS = {"header": ("Bearer ", "Basic ", "oken ", "ey: ", "Digest "), "flag": tuple(f"-{n}{end}" for n in _FLAGS for end in " ="), "user_flag": ("-u",), "query": ("?", "&")}
NEGATIVE = re.compile(r"integrity|checksum|sha\d|request_?id|data:image|public|ssh-|fingerprint|etag|uuid|secretref|_name|_count|max_", re.I)
PLACEHOLDER = re.compile(r"^[*x.\-_#X]+$|your|redact|placeholder|changeme|example|masked|hidden|dummy|todo|^none$|^null$|^true$|^false$|^AKIAX{6,}|^[A-Z]{0,6}X{8,}|^(.)\1+$|process\.|environ|getenv|vault|\*{3,}|^\[|^<|^%\w+%$", re.I)
UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
HEX = re.compile(r"^(?:sha\d+[:\-])?[0-9a-f]{7,}$", re.I)
DOTTED = re.compile(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$", re.A)
PASSWORD = re.compile(r"pass|pwd|kennwort", re.I)

FEATURES = (
    "bias", "markov", "length", "digits", "upper", "lower", "symbols", "entropy", "mixed", "hex", "uuid", "placeholder", "dotted", "prefix",
    "no_digit", "only_digits", "negative", "password_name", "key_name", "encoded", "config_path", "test_path", *PLACES,
)


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    place: str
    name: str
    value: str
    before: str
    path: str


PATH = re.compile(r"""(?:^|\n)(?:\+\+\+|---) ([^\n]*)|"file_path": ?"([^"\n]*)""")


def file_paths(text: str) -> tuple[list[int], list[str]]:
    """Where the paths of files stand in a text (diff headers, file_path fields), and the paths; each holds up to the next."""
    found = [(m.end(), m[1] or m[2] or "") for m in PATH.finditer(text)]
    return [e for e, _ in found], [p for _, p in found]


def candidates(text: str) -> list[Candidate]:
    """The candidate values of a text, without overlaps; a more telling place wins over quotes."""
    out: list[Candidate] = []
    taken = bytearray(len(text))
    paths: tuple[list[int], list[str]] | None = None
    for place, (pattern, need) in PLACES.items():
        if need and need not in text or place in _TRIGGERS and not any(t in text for t in _TRIGGERS[place]):
            continue
        for m in pattern.finditer(text):
            name = ""
            if place == "pem":
                if m[2] == "PUBLIC":
                    taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                    continue
                span = m.span(3)
            elif place == "url":
                span = m.span(2) if m[2] is not None else m.span(3)
            elif place == "named":
                name, span = m[1], m.span(2)
            else:
                span = m.span(1)
            value = text[span[0] : span[1]].rstrip(".:") if place != "pem" else text[span[0] : span[1]]
            if place == "quoted" and not (re.search(r"\d", value) and re.search(r"[A-Z]", value) and re.search(r"[a-z]", value)):
                continue
            if len(value) < 4 or "://" in value:
                continue
            end = span[0] + len(value)
            if taken.find(1, span[0], end) >= 0:
                continue
            taken[span[0] : end] = b"\1" * len(value)
            line = text.rfind("\n", 0, span[0]) + 1
            paths = paths or file_paths(text)
            k = bisect_left(paths[0], span[0] + 1)
            out.append(Candidate(span[0], end, place, name, value, text[max(line, span[0] - 60) : span[0]], paths[1][k - 1] if k else ""))
    return out


def decoded(value: str) -> str:
    """Printable text behind base64, or ''."""
    if len(value) < 12 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return ""
    try:
        text = base64.b64decode(value, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError):
        return ""
    return text if text.isprintable() else ""


def describe(c: Candidate) -> tuple[float, ...]:
    """The features but for the Markov likelihood (0 here), in the order of FEATURES."""
    v = c.value if c.place != "pem" else "pem"
    plain = decoded(v)
    n = len(v)
    counts = np.unique(np.frombuffer(v.encode("utf-8", "replace"), np.uint8), return_counts=True)[1] / max(len(v.encode("utf-8", "replace")), 1)
    digits, upper, lower = (sum(map(f, v)) / n for f in (str.isdigit, str.isupper, str.islower))
    # Base64 of a user and password speaks for itself; judge what it holds.
    inner = plain.partition(":")[2] or plain or v
    has_digit = any(ch.isdigit() for ch in inner)
    near = f"{c.before[-40:]} {c.name}"
    flags = (
        bool(HEX.match(v)), bool(UUID.match(v)), bool(PLACEHOLDER.search(v)), bool(DOTTED.match(v)) and len(v) <= 64 and not re.match(PREFIX, v), bool(re.match(PREFIX, v)),
        not has_digit and c.place != "pem", v.replace(".", "").isdigit(), bool(NEGATIVE.search(near)) or bool(re.match(r"sha\d|iVBOR|data:|AAAA", v)),
        bool(PASSWORD.search(near)), bool(re.search(_NAME, near)), bool(plain), bool(re.search(r"config|\.env|\.ya?ml|\.toml|\.ini|secret", c.path)), "test" in c.path,
    )
    mixed = digits > 0 and upper > 0 and lower > 0
    return (1.0, 0.0, min(n, 64) / 32, digits, upper, lower, max(0.0, 1 - digits - upper - lower), float(-(counts * np.log2(counts)).sum()) / 4, float(mixed), *map(float, flags), *(float(c.place == p) for p in PLACES))


def weak_label(c: Candidate, x: tuple[float, ...]) -> int:
    """1 or 0 where a narrow pattern speaks for or against the value, else -1: that is left to the classifier.

    For: a key block, a provider's prefix, a URL's user part with digits, a
    password by name with digits. Against: placeholders, ids, dotted names,
    digests, public material, and letters of one case. Values in quotes,
    headers, queries, hooks, logins, tokens by name have no label of their own.
    """
    f = dict(zip(FEATURES, x))
    if c.place == "pem":
        return 1
    if f["placeholder"] or f["uuid"] or f["dotted"] or f["only_digits"]:
        return 0
    if f["prefix"]:
        return 1 if len(c.value) >= 16 else -1
    if f["negative"] or f["hex"] and not f["key_name"] or f["no_digit"] and max(f["lower"], f["upper"]) == 1:
        return 0
    strong = c.place == "url" or f["password_name"] and c.place in ("named", "flag")
    return 1 if strong and not f["no_digit"] and len(c.value) >= 8 else -1


PAIRS = 96 * 96
CANDIDATES = "row int, tbl string, id string, turn_no long, call_no long, field string, place string, start int, end int, value string, label int, x array<double>, counts array<long>"
KEYS = ("tbl", "id", "turn_no", "call_no", "field")


def _codes(text: str) -> np.ndarray:
    """Printable ASCII as 0 to 94, all else as 95."""
    a = np.frombuffer(text.encode("latin-1", "replace"), np.uint8).astype(np.int32) - 32
    return np.where((a < 0) | (a >= 95), 95, a)


def pair_counts(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring characters (printable ASCII, all others as one)."""
    a = _codes("\n".join(texts))
    return np.bincount(a[:-1] * 96 + a[1:], minlength=PAIRS)


def scan(texts: DataFrame) -> DataFrame:
    """Candidates with features (row 0) and pair counts per batch (row 1) of ``texts`` (KEYS and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64())]
        names = [c.split(" ")[0] for c in CANDIDATES.split(", ")]
        total = np.zeros(PAIRS, np.int64)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            total += pair_counts([t for t in cols[5] if t])
            out = []
            for *key, text in zip(*cols):
                for c in candidates(text) if text else ():
                    x = describe(c)
                    out.append((0, *key, c.place, c.start, c.end, c.value, weak_label(c, x), list(x), None))
            rows = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(rows, types)], names=names)
        last = (1, None, None, None, None, None, None, None, None, None, None, None, total.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types)], names=names)

    return texts.select(*KEYS, "text").mapInArrow(run, CANDIDATES)


def markov(counts: np.ndarray) -> np.ndarray:
    """Log probability of each character after another, from pair counts."""
    c = counts.reshape(96, 96).astype(float) + 0.5
    return np.log(c / c.sum(axis=1, keepdims=True)).ravel()


def likelihood(value: str, table: np.ndarray) -> float:
    """Mean log likelihood per character step; 0 for values too short to tell."""
    a = _codes(value)
    return float(table[a[:-1] * 96 + a[1:]].mean()) if len(a) > 1 else 0.0


# What one knows of the features before any data; features that the labels do not tell apart keep these weights.
PRIOR = {
    "bias": -3, "mixed": 2, "prefix": 4, "password_name": 2, "key_name": 2, "placeholder": -8, "no_digit": -4, "negative": -5, "uuid": -6, "dotted": -5, "only_digits": -6, "hex": -2,
    "pem": 8, "url": 4, "user_flag": 4, "login": 4, "header": 4, "hook": 6, "query": 2, "flag": 2,
}


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Logistic regression drawn to ``prior`` by a ridge, classes weighing alike; Newton's method.

    Without rows it is the prior, with few it stays near it, with many the rows decide.
    """
    w = prior.astype(float).copy()
    positive = float(y.sum())
    weight = np.where(y == 1, len(y) / (2 * max(positive, 1)), len(y) / (2 * max(len(y) - positive, 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * (w - prior)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        longest = float(np.abs(step).max())
        w = w - step * min(1.0, 5 / max(longest, 1e-12))
        if longest < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Markov table, weights and Platt calibration (scale, shift)."""

    table: np.ndarray
    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray, values: list[str]) -> np.ndarray:
        x = x.copy()
        x[:, 1] = [likelihood(v, self.table) for v in values]
        return 1 / (1 + np.exp(-np.clip(self.scale * (x @ self.weights) + self.shift, -30, 30)))


def train(found: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """The model from scanned candidates: Markov table over all texts, weights from a bounded labelled sample.

    A fifth of the labelled values, by hash, is held out and calibrates the
    scores (Platt). Both fits are drawn to a prior, so a table with few or no
    labelled candidates goes the same way.
    """
    # One fixed-size row per task of the scan.
    counts = found.where("row = 1").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(PAIRS)
    table[counts["k"].to_numpy(int)] = counts["n"].to_numpy(float)
    table = markov(table)
    labelled = found.where("row = 0 and label >= 0").select("value", "label", "x", F.pmod(F.xxhash64("value", *KEYS), F.lit(1_000_000)).alias("h"), (F.pmod(F.xxhash64("value"), F.lit(5)) == 0).alias("held"))
    share = rows / max(labelled.count(), 1)
    sample = (labelled.where(F.col("h") < int(share * 1_000_000)) if share < 1 else labelled).toPandas()
    # In a fixed order, so that sums do not depend on how the files were split.
    sample = sample.sort_values(["value", "label"]).reset_index(drop=True)
    prior = np.array([float(PRIOR.get(n, 0)) for n in FEATURES])
    x, y = np.array(sample["x"].tolist()).reshape(len(sample), len(FEATURES)), sample["label"].to_numpy(float)
    x[:, 1] = [likelihood(v, table) for v in sample["value"]]
    held = sample["held"].to_numpy(bool)
    weights = fit(x[~held], y[~held], prior)
    raw = x[held] @ weights
    # Platt's targets keep the calibration finite where the classes separate.
    pos, neg = y[held].sum(), (1 - y[held]).sum()
    target = np.where(y[held] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    shift, scale = fit(np.c_[np.ones(len(raw)), raw], target, np.array([0.0, 1.0]), ridge=10.0) if len(raw) else (0.0, 1.0)
    return Model(table, weights, max(float(scale), 0.1), float(shift))


def texts_of(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(tbl, id, turn_no, call_no, field, text): all tool inputs, output texts and raw outputs, and document texts."""
    turns = records.select("record_id", F.posexplode("turns.tool_calls").alias("turn_no", "calls"))
    calls = turns.select("record_id", "turn_no", F.posexplode("calls").alias("call_no", "c"))
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("text")) for n, c in (("input", "c.input"), ("output_text", "c.output.text"), ("output_raw", "c.output.raw"))])
    long = lambda c: F.col(c).cast("long").alias(c)
    tools = calls.select(F.lit("records").alias("tbl"), F.col("record_id").alias("id"), long("turn_no"), long("call_no"), F.explode(fields).alias("f")).select("tbl", "id", "turn_no", "call_no", "f.field", "f.text")
    none = F.lit(-1).cast("long")
    docs = documents.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("id"), none.alias("turn_no"), none.alias("call_no"), F.lit("text").alias("field"), "text")
    return tools.unionByName(docs).where("text is not null and text != ''")


def scored(found: DataFrame, model: Model) -> DataFrame:
    """The candidates with their calibrated score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist()).reshape(len(b), len(FEATURES))
            yield b[[*KEYS, "place", "start", "end"]].assign(score=model.score(x, b["value"].tolist()))

    rows = found.where("row = 0").select(*KEYS, "place", "start", "end", "value", "x")
    return rows.mapInPandas(run, "tbl string, id string, turn_no long, call_no long, field string, place string, start int, end int, score double")


def secrets_found(records: DataFrame, documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(tbl, id, turn_no, call_no, field): each field value that holds at least one literal secret, once.

    Null and empty values hold none; repeated deliveries count once; whole
    texts are read, whatever their length.
    """
    found = stage(scan(texts_of(records, documents)))
    return scored(found, train(found)).where(F.col("score") >= threshold).select(*KEYS).distinct()


def redact_text(text: str | None, model: Model, threshold: float = THRESHOLD, mark: str = MARK) -> str | None:
    """The text with every secret's own characters replaced by ``mark``."""
    found = candidates(text) if text else []
    if not found:
        return text
    x = np.array([describe(c) for c in found])
    keep = model.score(x, [c.value for c in found]) >= threshold
    out, at = [], 0
    for c in sorted((c for c, k in zip(found, keep) if k), key=lambda c: c.start):
        # A key block keeps its line ends, so that the lines around it stay where they are.
        out += [text[at : c.start], re.sub(r"[A-Za-z0-9+/=]{4,}", mark, c.value) if c.place == "pem" else mark]
        at = c.end
    return "".join([*out, text[at:]])


def redacted(records: DataFrame, documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(tbl, id, turn_no, call_no, field, text): the changed field values with their secrets replaced.

    The texts are scanned a second time, map-side, rather than joined with
    their spans: that would send every text through a shuffle.
    """
    texts = texts_of(records, documents)
    model = train(stage(scan(texts)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [redact_text(t, model, threshold) for t in b["text"]]
            yield b.assign(text=new)[[a != t for a, t in zip(new, b["text"])]]

    return texts.select(*KEYS, "text").mapInPandas(run, "tbl string, id string, turn_no long, call_no long, field string, text string").dropDuplicates(list(KEYS))
