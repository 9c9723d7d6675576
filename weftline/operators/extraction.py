"""Steps around an extraction: scope, sources to copy, warnings, origins seen, secrets found, lookups, tools."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import secretscan as S
from ..functions.scalar import text

ALL = "all"


def resolve_scope(flag: str = "", include_all: bool = False, configured: str = "") -> str:
    """The scope that holds: the flag, else everything if asked for, else the configured one ('' if none)."""
    return flag or (ALL if include_all else configured)


def in_scope(records: DataFrame, scope: str, known: tuple[str, ...]) -> DataFrame:
    """The records of one origin, or of all; an origin that is not ``known`` is an error."""
    if scope == ALL:
        return records
    if scope not in known:
        raise ValueError(f"unknown scope {scope!r}; there are {ALL}, {', '.join(known)}")
    return records.where(F.col("origin") == scope)


def copy_target(path: Column) -> Column:
    """Where a native file's copy goes: eight hex digits of its folder's hash and its name."""
    folder, name = F.regexp_extract(path, r"^(.*)/([^/]+)$", 1), F.regexp_extract(path, r"([^/]+)$", 1)
    return F.concat(F.substring(F.sha2(folder, 256), 1, 8), F.lit("/"), name)


def copy_sources(records: DataFrame, native: tuple[str, ...]) -> DataFrame:
    """(path, target): the native files behind the records of origins that can be copied, each once."""
    paths = records.where(F.col("origin").isin(*native)).select(F.col("_provenance.source_path").alias("path")).where("path != ''").distinct()
    return paths.select("path", copy_target(F.col("path")).alias("target"))


def distinct_warnings(warnings: DataFrame, column: str) -> DataFrame:
    """(warning): each warning once, trimmed, without blank ones."""
    return warnings.select(F.trim(column).alias("warning")).where("warning != ''").distinct()


def origins_seen(records: DataFrame, order: str) -> DataFrame:
    """(origin, position): the origins in the order in which they first occur, from 1; null and blank ones are left out."""
    first = records.where("trim(origin) != ''").groupBy("origin").agg(F.min(order).alias("o"))
    # One row per origin.
    return first.select("origin", F.expr("row_number() over (partition by 1 order by o)").cast("long").alias("position"))


def secrets_seen(lines: DataFrame, column: str) -> DataFrame:
    """(fingerprint, label): each distinct secret value once, as its sha256, with the first detector that knows it."""
    v = F.col(column)

    def numbered(i: int, pattern: str, group: int) -> Column:
        return F.transform(S.found(v, pattern, group), lambda x: F.struct(x.alias("raw"), F.lit(i).alias("i")))

    each = F.array(*[numbered(i, p, g) for i, (_, p, g) in enumerate(S.PATTERNS)])
    rows = lines.select(F.explode(F.flatten(F.filter(each, lambda a: a.isNotNull()))).alias("x")).select("x.*").groupBy("raw").agg(F.min("i").alias("i"))
    names = F.array(*[F.lit(n) for n, _, _ in S.PATTERNS])
    return rows.select(F.concat(F.lit("sha256:"), F.sha2("raw", 256)).alias("fingerprint"), names[F.col("i")].alias("label"))


def upload_lookup(wanted: DataFrame, entries: DataFrame, order: Column, strict: bool = False) -> DataFrame:
    """``wanted`` (source_hash) with the ``file`` of the last entry of that hash; a missing one is null, or an error if ``strict``."""
    last = entries.where("source_hash is not null").groupBy("source_hash").agg(F.max_by("file", order).alias("file"))
    out = wanted.join(last, "source_hash", "left")
    return out.withColumn("file", F.when(F.col("file").isNull(), F.raise_error(F.lit("an entry has no file to upload"))).otherwise(F.col("file"))) if strict else out


def staging_faults(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """(file, expected, found): staged files whose bytes are not those of their entry; ``hashes`` is (file, sha256)."""
    both = entries.select("file", F.col("redacted_hash").alias("expected")).join(hashes.select("file", F.col("sha256").alias("found")), "file", "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def lookup(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The native rows of the sessions in ``wanted`` (id), ahead of their assembly: one semi-join for any number of them."""
    return rows.join(wanted.select(F.col("id").alias(column)).distinct(), column, "left_semi")


TOOL = "position long, type string, name string, description string, parameters string"


def tools_of(spark: SparkSession, body: str) -> DataFrame:
    """Tools of a JSON array, flat or wrapped as {type, function}: (position, type, name, description, parameters); nameless ones are left out.

    A tools file or catalog is a small configuration document.
    """
    rows = []
    for i, entry in enumerate(json.loads(body)):
        if isinstance(entry, dict):
            inner = entry["function"] if isinstance(entry.get("function"), dict) else entry
            if inner.get("name"):
                rows.append((i, entry.get("type") or "function", inner["name"], inner.get("description") or "", json.dumps(inner["parameters"], ensure_ascii=False) if inner.get("parameters") else None))
    return spark.createDataFrame(rows, TOOL)


def resolve_tools(inferred: DataFrame, tools_file: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """(name, description, parameters): a tools file replaces all; else the inferred tools, with what a catalog knows of them.

    ``inferred`` is (tool, parameters); the last entry of a name counts.
    """
    from . import records as R

    if tools_file is not None:
        last = tools_file.groupBy("name").agg(F.max_by(F.struct("description", "parameters"), "position").alias("t"))
        return last.select("name", "t.description", "t.parameters")
    none = inferred.sparkSession.createDataFrame([], TOOL) if catalog is None else catalog
    return R.overlay_catalog(inferred, none).select(F.col("tool").alias("name"), "description", "parameters")


def parameters_json(inferred: DataFrame) -> DataFrame:
    """(tool, parameters): the JSON schema of each inferred tool from its parameter rows, names in order."""
    of = F.array_sort(F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "type", "required"))))
    grouped = inferred.groupBy("tool").agg(of.alias("p"))
    quoted = lambda c: F.substring_index(F.substr(F.to_json(F.array(c)), F.lit(2)), "]", 1)
    props = F.array_join(F.transform("p", lambda x: F.concat(quoted(x["param"]), F.lit(':{"type":"'), x["type"], F.lit('"}'))), ",")
    needed = F.array_join(F.transform(F.filter("p", lambda x: x["required"]), lambda x: quoted(x["param"])), ",")
    body = F.concat(F.lit('{"type":"object","properties":{'), props, F.lit("}"), F.when(needed != "", F.concat(F.lit(',"required":['), needed, F.lit("]"))).otherwise(""), F.lit("}"))
    return grouped.select("tool", body.alias("parameters"))


def slashed(path: Column) -> Column:
    """A path with forward slashes."""
    return F.replace(text(path), F.lit("\\"), F.lit("/"))
