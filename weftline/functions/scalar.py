"""Scalar functions over strings, paths, times and JSON text; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.timestamps import canonical

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"
PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?$"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    """The first value that is not blank, as it stands; '' if there is none."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns], F.lit(""))


def _clock(value: Column, pattern: str, zone: str = "") -> Column:
    """Seconds since 1970 of a value that fits ``pattern``, or null where a part is out of range."""
    return F.when(value.rlike(pattern), F.unix_seconds(F.concat(F.translate(value, ",", "."), F.lit(zone)).try_cast("timestamp")))


def rfc3339_seconds(value: Column) -> Column:
    return _clock(value, RFC3339)


def timestamp_seconds(value: Column) -> Column:
    """Seconds of RFC 3339, ``yyyy-MM-dd HH:mm:ss`` (UTC) or an integer count of milliseconds; null otherwise."""
    count = F.when(value.rlike(r"^[+-]?\d{1,18}$"), value.try_cast("long"))
    millis = _div(count, 1000)
    return F.coalesce(rfc3339_seconds(value), _clock(value, PLAIN, "Z"), millis)


def _div(a: Column, b: int) -> Column:
    """Floor of a / b, exact for any long."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def utc_text(t: Column) -> Column:
    """Seconds since 1970 as ``yyyy-MM-ddTHH:mm:ssZ`` for any year; far years take more digits, those before 0 a minus.

    The calendar repeats every 400 years, so the day is looked up in the first ones since 1970.
    """
    era = 400 * 365 + 97
    days = _div(t, 86400)
    near = canonical(F.pmod(days, F.lit(era)) * 86400 + F.pmod(t, F.lit(86400)))
    year = F.substring(near, 1, 4).cast("long") + 400 * _div(days, era)
    digits = F.abs(year).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.when(year < 0, "-").otherwise(""), padded, F.substring(near, 5, 16))


def normalize_timestamp(value: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` in UTC, sub-seconds dropped; '' for what is no time. Counts far from now give far years."""
    return F.coalesce(utc_text(timestamp_seconds(value)), F.lit(""))


def display_label(path: Column, home: str = "") -> Column:
    """A path without home folder and without Documents, Downloads and Desktop segments; the last segment if nothing is left."""
    p = F.regexp_replace(path, r"/+", "/")
    if home:
        p = F.when(p.startswith(home), F.substr(p, F.lit(len(home) + 1))).otherwise(p)
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", ".", "Documents", "Downloads", "Desktop"))
    last = F.try_element_at(F.filter(F.split(p, "/"), lambda s: s != ""), F.lit(-1))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise(F.coalesce(last, F.when(p.startswith("/"), "/").otherwise(".")))


def project_name(name: Column, home: str = "") -> Column:
    """A folder name with ``-`` for ``/`` as the path it stands for, labelled."""
    return display_label(F.replace(name, F.lit("-"), F.lit("/")), home)


def repository_name(url: Column) -> Column:
    """Last segment of a repository address, without ``.git`` and final slashes."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(F.trim(url), r"/+$", ""), r"\.git$", ""), "[/:]"), -1)


def attachment_type(mime: Column) -> Column:
    return F.when(F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1)))).startswith("image/"), "image").otherwise("document")


def json_type(value: Column) -> Column:
    """JSON-schema type of JSON text."""
    s = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number")
    )


def json_string(value: Column, path: str) -> Column:
    """The value at ``path`` of a variant if it is a JSON string, else null."""
    v = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(value, path, "string"))


def int_number(value: Column, path: str) -> Column:
    """The number at ``path`` of a variant cut to an integer; 0 for all else."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(F.when(number, F.try_variant_get(value, path, "double").cast("long")), F.lit(0).cast("long"))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character, rounded to 1e-9 (0 for '')."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.length(value).cast("double")
    share = lambda c: F.size(F.filter(letters, lambda d: d == c)) / n
    return F.round(F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))), 9)


def mixed_classes(value: Column) -> Column:
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def large_binary(value: Column) -> Column:
    """At least 4096 bytes of base64 or a base64 data address: left alone by redaction."""
    data = value.startswith("data:") & F.contains(value, F.lit(";base64,"))
    return F.coalesce((F.octet_length(value) >= 4096) & (data | value.rlike(r"\A[A-Za-z0-9+/=\n\r]*\z")), F.lit(False))


def mask_secret(value: Column) -> Column:
    n = F.length(value)
    stars = lambda k: F.repeat(F.lit("*"), (n - k).cast("int"))
    return (
        F.when(n < 4, "[redacted]").when(n <= 8, F.concat(F.substring(value, 1, 1), stars(2), F.substring(value, -1, 1)))
        .otherwise(F.concat(F.substring(value, 1, 4), stars(8), F.substring(value, -4, 4)))
    )


def anon_token(identifier: Column) -> Column:
    return F.concat(F.lit("anon_"), F.substring(F.sha2(F.lower(F.trim(identifier)), 256), 1, 10))


def redaction_key(pipeline: str, redactions: list[str], handles: list[str], keep_images: bool) -> str:
    """``v1:<pipeline>:<config fingerprint>:keep|strip-images``; lists count trimmed, sorted, without blanks."""
    import hashlib

    lines = lambda items: "".join(f"{x}\n" for x in sorted({i.strip() for i in items} - {""}))
    digest = hashlib.sha256(f"redactions:{lines(redactions)}handles:{lines(handles)}".encode()).hexdigest()
    return f"v1:{pipeline}:sha256:{digest}:{'keep' if keep_images else 'strip'}-images"


def parse_redaction_key(key: Column) -> Column:
    """struct<pipeline, config, images> of a well-formed key, else null."""
    pattern = r"^v1:([^:]+):(sha256:.*):(keep|strip)-images$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    return F.when(key.rlike(pattern), F.struct(part(1).alias("pipeline"), part(2).alias("config"), part(3).alias("images")))


def sample_count(value: Column) -> Column:
    """The first whole number of a text, 0 if it has none or one too large."""
    return F.coalesce(F.regexp_extract(value, r"(?<![A-Za-z0-9_])(\d+)(?![A-Za-z0-9_])", 1).try_cast("long"), F.lit(0).cast("long"))


def call_id(turn: Column, call: Column, tool: Column) -> Column:
    return F.concat(F.lit("call_"), turn.cast("string"), F.lit("_"), call.cast("string"), F.lit("_"), text(tool))


def output_text(output: Column) -> Column:
    """Text of a tool output: its text, else its blocks' texts by lines, else its raw value ('' for null)."""
    blocks = F.array_join(F.filter(F.transform(F.coalesce(output["content"], F.array()), lambda b: text(b["text"])), lambda t: t != ""), "\n")
    raw = output["raw"]
    string = F.when(F.ltrim(raw).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
    return F.when(text(output["text"]) != "", output["text"]).when(blocks != "", blocks).otherwise(F.coalesce(string, raw, F.lit("")))
