"""Writing records, training text, redacted native copies and manifests; hashing files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import json_string
from ..operators import records as R
from ..operators.redaction import Rules
from . import build as B

#: Origins whose native files can be copied with redaction.
NATIVE = ("claudecode", "codex")


def json_lines(records: DataFrame) -> DataFrame:
    """(value): one JSON line per record; empty strings, empty arrays and nulls are left out as absent."""
    present = [F.when(F.col(f.name) != "", F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in records.schema]
    return records.select(F.to_json(F.struct(*present)).alias("value"))


def write_records(records: DataFrame, path: str, files: int | None = None) -> None:
    """Canonical JSONL under ``path``; one file only if asked for."""
    lines = json_lines(records)
    (lines.coalesce(files) if files else lines).write.mode("overwrite").text(path)


def write_rendered(records: DataFrame, serializer: Callable[[], Column], path: str) -> None:
    """One JSON line {id, model, content} per record."""
    payload = F.struct(F.col("record_id").alias("id"), "model", serializer().alias("content"))
    records.select(F.to_json(payload).alias("value")).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Canonical JSONL; lines that are no object are skipped, or raise if ``strict``."""
    lines = spark.read.text(path).where("trim(value) != ''")
    parsed = lines.withColumn("r", F.from_json("value", B.schema.RECORD))
    broken = ~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    if strict:
        parsed = parsed.withColumn("r", F.when(broken, F.raise_error(F.lit("a line is no JSON object"))).otherwise(F.col("r")))
    else:
        parsed = parsed.where(~broken)
    return parsed.select("r.*")


def validate_file(spark: SparkSession, path: str) -> tuple[int, int | None, str | None]:
    """(valid records, first bad line from 1, its error); an empty line is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("n", "line"))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    rows = rows.select("n", ok.alias("ok"), F.from_json("line", B.schema.RECORD).alias("r")).select("n", "ok", "r.*")
    error = F.when(~F.col("ok"), "no JSON object").otherwise(R.validity())
    found = rows.select("n", error.alias("e")).agg(F.count_if(F.col("e").isNull()).alias("valid"), F.min(F.when(F.col("e").isNotNull(), F.struct("n", "e"))).alias("bad")).first()
    return (found["valid"], found["bad"]["n"] + 1, found["bad"]["e"]) if found["bad"] else (found["valid"], None, None)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of the raw bytes of all files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.col("length").alias("bytes"))


def _without_blocks(content: object, kind: str, nested: bool) -> object:
    """A list of content blocks without those of one type; with ``nested`` also within the blocks' own content lists."""
    if not isinstance(content, list):
        return content
    kept = [b for b in content if not (isinstance(b, dict) and b.get("type") == kind)]
    return [b | {"content": _without_blocks(b["content"], kind, True)} if nested and isinstance(b, dict) and isinstance(b.get("content"), list) else b for b in kept]


def strip_images(line: dict, origin: str) -> dict:
    """A line of a native log without its images, where the log's own format has them; all else, tool arguments too, stays."""
    part = "message" if origin == "claudecode" else "payload"
    inner = line.get(part)
    if not isinstance(inner, dict):
        return line
    if origin == "claudecode":
        return line | {part: inner | {"content": _without_blocks(inner["content"], "image", True)}} if "content" in inner else line
    kind = (line.get("type"), inner.get("type"))
    if kind == ("response_item", "message") and "content" in inner:
        return line | {part: inner | {"content": _without_blocks(inner["content"], "input_image", False)}}
    if kind == ("event_msg", "user_message"):
        return line | {part: {k: v for k, v in inner.items() if k not in ("images", "local_images")}}
    return line


def isolate(spark: SparkSession, root: str, rules: Rules, keep_images: bool = True, origin: str = "claudecode", before: Callable[[dict], dict] | None = None) -> DataFrame:
    """(path, target, lines, source_hash, redacted_hash, redacted): native line logs redacted line by line, shape kept.

    Objects are walked, other JSON and text is redacted as text; a broken line
    raises. ``target`` is eight hex digits of the folder's hash and the file
    name. Only origins with a native format have copies; ``before`` is a hook
    that sees each object ahead of the redaction.
    """
    if origin not in NATIVE:
        raise ValueError(f"{origin} has no native format to copy; there are {', '.join(NATIVE)}")

    def line(raw: str) -> str:
        value = json.loads(raw)
        if not isinstance(value, dict):
            return rules.apply(raw)[0]
        value = value if keep_images else strip_images(value, origin)
        return json.dumps(rules.walk(before(value) if before else value)[0], ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [[line(x.strip()) for x in v.split("\n") if x.strip()] for v in b.column(1).to_pylist()]
            text = pa.array(["".join(f"{x}\n" for x in d) for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array([len(d) for d in done], pa.int64()), b.column(2)], names=["path", "redacted", "lines", "source_hash"])

    files = B.files(spark, root, "*.jsonl").select("path", "value", F.concat(F.lit("sha256:"), F.sha2("value", 256)).alias("source_hash"))
    rows = files.mapInArrow(run, "path string, redacted string, lines long, source_hash string")
    folder, name = F.regexp_extract("path", r"^(.*)/([^/]+)$", 1), F.regexp_extract("path", r"^(.*)/([^/]+)$", 2)
    target = F.concat(F.substring(F.sha2(folder, 256), 1, 8), F.lit("/"), name)
    return rows.select("path", target.alias("target"), "lines", "source_hash", F.concat(F.lit("sha256:"), F.sha2("redacted", 256)).alias("redacted_hash"), "redacted")


def native_session_id(lines: DataFrame, origin: str) -> DataFrame:
    """(path, session_id): the first session_meta id of a rollout log, or the path's last parts of a project log."""
    if origin == "codex":
        e = B.parsed(lines).where(json_string(F.col("v"), "$.type") == "session_meta")
        return e.groupBy("path").agg(F.min_by(json_string(F.col("v"), "$.payload.id"), "line_no").alias("session_id"))
    return lines.select("path").distinct().withColumn("session_id", F.regexp_replace(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1), r"\.jsonl$", ""))


def manifest_text(header: dict, entries: list[dict]) -> str:
    """A JSONL manifest: the header with ``session_count``, then one line per entry."""
    head = {"kind": "header"} | header | {"session_count": len(entries)}
    return "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in [head, *({"kind": "session"} | e for e in entries)])


def summary_json(total: dict, by_model: list[dict], by_grouping: list[dict]) -> str:
    """The summary of an export as indented JSON: totals, and breakdowns by name."""
    named = lambda rows, key: {r[key]: {k: v for k, v in r.items() if k != key} for r in sorted(rows, key=lambda r: r[key])}
    return json.dumps(total | {"models": named(by_model, "model"), "groupings": named(by_grouping, "grouping")}, indent=2, ensure_ascii=False)


def copies_markdown(formats: list[dict], keys: list[dict]) -> str:
    """A readme of redacted native copies: sessions and lines by format, the mix of redaction keys, and the image policy.

    ``formats`` has format, sessions, lines; ``keys`` redaction_key, images, sessions.
    """
    policies = sorted({k["images"] for k in keys})
    images = {"keep": "Images are kept.", "strip": "Images are stripped."}.get(policies[0] if len(policies) == 1 else "", "Images are kept in some sessions and stripped in others." if {"keep", "strip"} <= set(policies) else "The image policy is not known.")
    out = ["# Redacted native sessions", "", f"- sessions: {sum(f['sessions'] for f in formats)}", f"- lines: {sum(f['lines'] for f in formats)}", "", images, "", "| format | sessions | lines |", "|-|-|-|"]
    out += [f"| {f['format']} | {f['sessions']} | {f['lines']} |" for f in sorted(formats, key=lambda f: f["format"] or "")]
    out += ["", "| redaction key | images | sessions |", "|-|-|-|"]
    return "\n".join([*out, *(f"| {k['redaction_key']} | {k['images']} | {k['sessions']} |" for k in sorted(keys, key=lambda k: k["redaction_key"]))])


def summary_markdown(total: dict, by_model: list[dict], by_grouping: list[dict]) -> str:
    """A readme of an export: totals and the breakdowns sorted by name."""

    def table(title: str, key: str, rows: list[dict]) -> list[str]:
        body = [f"| {r[key]} | {r['records']} | {r['input_tokens']} | {r['output_tokens']} |" for r in sorted(rows, key=lambda r: r[key])]
        return [f"## {title}", "", f"| {key} | records | input tokens | output tokens |", "|-|-|-|-|", *body, ""]

    head = ["# Dataset", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in total.items()), ""]
    return "\n".join([*head, *table("Models", "model", by_model), *table("Groupings", "grouping", by_grouping)])
