"""Whole-file JSON traces (gemini, amp) and small line logs (kimi, openclaw, supplied)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import build as B



def _objects(v: Column, path: str) -> Column:
    return F.filter(B.arr(v, path), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _stem(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _total(items: Column, *paths: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, m: acc + sum((B.number(m, p) for p in paths), F.lit(0).cast("long")))


def _exploded(rows: DataFrame, turns: Column) -> DataFrame:
    return rows.select("path", F.posexplode(F.filter(turns, lambda t: t.isNotNull())).alias("ord", "turn"))


def gemini(spark: SparkSession, root: str, workspaces: DataFrame | None = None) -> DataFrame:
    """``<root>/<digest>/chats/session-*.json``; ``workspaces`` (digest, path) names the digests it knows.

    Equal contents of one grouping are one record, the first by path.
    """
    return gemini_traces(B.files(spark, root, "session-*.json").where("path not like '%/bin/%'"), workspaces)


def gemini_traces(rows: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Records from (path, value), the files of the sessions."""
    rows = rows.withColumn("digest", F.regexp_extract("path", r"([^/]+)/chats/[^/]+$", 1))
    if workspaces is not None:
        rows = rows.join(workspaces.select("digest", F.col("path").alias("workspace")), "digest", "left")
    else:
        rows = rows.withColumn("workspace", F.lit(None).cast("string"))
    v = F.col("v")
    rows = B.parsed(rows, "value").withColumn("m", _objects(v, "$.messages"))

    def turn(m: Column) -> Column:
        at, parts = B.time_at(m, "$.timestamp"), _objects(m, "$.content")
        texts = F.filter(F.transform(parts, lambda b: B.s(b, "$.text")), lambda t: t != "")
        plain = F.when(F.schema_of_variant(B.sub(m, "$.content")) == "STRING", F.try_variant_get(m, "$.content", "string")).otherwise(F.array_join(texts, "\n"))
        bare = F.filter(parts, lambda b: B.s(b, "$.text") == "")

        def file(b: Column, key: str, **to: str) -> Column:
            d = B.sub(b, f"$.{key}")
            kind = B.s(d, "$.mimeType")
            return B.block(F.when(F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1)))).startswith("image/"), "image").otherwise("document"), media_type=kind, **{k: B.s(d, f"$.{p}") for k, p in to.items()})

        inline = F.transform(F.filter(bare, lambda b: B.sub(b, "$.inlineData").isNotNull()), lambda b: file(b, "inlineData", data="data"))
        linked = F.transform(F.filter(bare, lambda b: B.sub(b, "$.fileData").isNotNull()), lambda b: file(b, "fileData", url="fileUri"))
        events = F.filter(F.transform(bare, lambda b: F.coalesce(B.json_at(b, "$.functionCall"), B.json_at(b, "$.functionResponse"))), lambda x: x.isNotNull())
        extensions = F.when(F.size(events) > 0, F.concat(F.lit('{"tool_events":['), F.array_join(events, ","), F.lit("]}")))
        thoughts = F.array_join(F.filter(F.transform(_objects(m, "$.thoughts"), lambda b: B.s(b, "$.description")), lambda t: t != ""), "\n")

        def call(c: Column) -> Column:
            raw = B.json_at(c, "$.output")
            status = F.when(B.s(c, "$.status") != "", B.s(c, "$.status")).when(raw.isNull(), "").otherwise("success")
            return B.call(B.s(c, "$.name", "$.toolName"), F.coalesce(B.json_at(c, "$.args"), B.text_of(c)), F.when(raw.isNotNull(), B.output(None, None, raw)), status)

        user = B.turn(F.lit("user"), at, plain, None, None, F.concat(inline, linked), extensions)
        model = B.turn(F.lit("assistant"), at, B.s(m, "$.content"), thoughts, F.transform(_objects(m, "$.toolCalls"), call))
        return F.when(B.s(m, "$.type") == "user", user).when(B.s(m, "$.type") == "gemini", model)

    said = F.filter("m", lambda m: B.s(m, "$.type") == "gemini")
    models = F.filter(F.transform(said, lambda m: B.s(m, "$.model")), lambda t: t != "")
    meta = rows.select(
        "path", F.coalesce(F.nullif(B.s(v, "$.sessionId"), F.lit("")), _stem()).alias("record_id"), F.coalesce("workspace", "digest").alias("grouping"), F.coalesce("workspace", F.lit("")).alias("working_dir"),
        F.coalesce(F.try_element_at(models, F.lit(-1)), F.lit("gemini/unknown")).alias("model"), B.time_at(v, "$.startTime").alias("started_at"), B.time_at(v, "$.lastUpdated").alias("ended_at"),
        _total(said, "$.tokens.input", "$.tokens.cached").alias("input_tokens"), _total(said, "$.tokens.output").alias("output_tokens"),
    )
    records = B.finish(meta, _exploded(rows, F.transform("m", turn)), "gemini")
    content = F.sha2(F.to_json(F.struct(*[c for c in records.columns if c not in ("grouping", "_provenance")])), 256)
    keep = records.withColumn("h", content).groupBy("grouping", "h").agg(F.min("_provenance.source_path").alias("p")).select("p")
    return records.join(keep, records["_provenance.source_path"] == keep["p"], "left_semi")


def amp(spark: SparkSession, root: str) -> DataFrame:
    """``*.json`` traces under ``root``, grouped by the first folder or ``default``."""
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    rest = F.regexp_replace("path", "^" + base.replace(".", r"\."), "")
    rows = B.files(spark, root, "*.json").withColumn("grouping", F.when(F.contains(rest, F.lit("/")), F.split_part(rest, F.lit("/"), F.lit(1))).otherwise("default"))
    return amp_traces(rows.select("path", "grouping", F.col("value").alias("raw")))


def amp_traces(rows: DataFrame) -> DataFrame:
    """Records from (path, grouping, raw); traces without id, messages or any content give none. Identity ids are not carried over."""
    v = F.col("v")
    rows = B.parsed(rows).withColumn("m", _objects(v, "$.messages")).where(F.trim(B.s(v, "$.id")) != "")

    def turn(m: Column) -> Column:
        blocks = _objects(m, "$.content")
        starts = F.filter(F.transform(blocks, lambda b: B.time_at(b, "$.startTime")), lambda t: t != "")
        at = F.coalesce(F.nullif(B.time_at(m, "$.meta.sentAt"), F.lit("")), F.try_element_at(starts, F.lit(1)), F.nullif(B.time_at(m, "$.usage.timestamp"), F.lit("")), F.lit(""))
        return B.turn(B.s(m, "$.role"), at, B.texts(blocks, "text", "", "$.text"), B.texts(blocks, "thinking", "\n", "$.thinking", "$.text"))

    turns = F.filter(F.transform("m", turn), lambda t: t["role"].isin("user", "assistant") & ((t["text"] != "") | (t["reasoning"] != "")))
    rows = rows.withColumn("ts", turns).where(F.size("ts") > 0)
    times = F.filter(F.transform("ts", lambda t: t["timestamp"]), lambda t: t != "")
    known = lambda *c: F.filter(F.concat(F.array(*c), times), lambda t: t != "")
    models = F.filter(F.transform("m", lambda m: B.s(m, "$.usage.model")), lambda t: t != "")
    uri = F.try_element_at(F.filter(F.transform(_objects(v, "$.env.initial.trees"), lambda t: B.s(t, "$.uri")), lambda u: u != ""), F.lit(1))
    fields = {"agent_mode": "$.agentMode", "workspace_id": "$.meta.workspaceID", "project_id": "$.meta.projectID", "visibility": "$.meta.visibility", "client_version": "$.env.initial.platform.clientVersion", "client_type": "$.env.initial.platform.clientType"}
    more = F.to_json(F.struct(*[F.nullif(B.s(v, p), F.lit("")).alias(n) for n, p in fields.items()]))
    meta = rows.select(
        "path", "grouping", B.s(v, "$.id").alias("record_id"), B.s(v, "$.title").alias("title"), F.coalesce(F.try_element_at(models, F.lit(1)), F.lit("amp/unknown")).alias("model"),
        F.coalesce(F.array_min(known(B.time_at(v, "$.created"))), F.lit("")).alias("started_at"), F.coalesce(F.array_max(known(B.time_at(v, "$.updatedAt"), B.time_at(v, "$.meta.lastUserMessageAt"))), F.lit("")).alias("ended_at"),
        F.coalesce(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), F.lit("")).alias("working_dir"),
        _total(F.col("m"), "$.usage.inputTokens", "$.usage.cacheReadInputTokens", "$.usage.cacheCreationInputTokens").alias("input_tokens"), _total(F.col("m"), "$.usage.outputTokens").alias("output_tokens"),
        F.when(more != "{}", F.concat(F.lit('{"amp":'), more, F.lit("}"))).alias("extensions"),
    )
    return B.finish(meta, rows.select("path", F.posexplode("ts").alias("ord", "turn")), "amp")


def kimi(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/sessions/<md5 of the work folder>/<session>/context.jsonl``; ``kimi.json`` lists the folders."""
    known = B.parsed(B.files(spark, root, "kimi.json").where("path not like '%/sessions/%'"), "value").select(F.explode(B.arr(F.col("v"), "$.work_dirs")).alias("d"))
    folder = F.when(F.schema_of_variant("d") == "STRING", F.try_variant_get("d", "$", "string")).otherwise(B.s(F.col("d"), "$.path"))
    return kimi_sessions(B.lines(B.files(spark, f"{root}/sessions", "context.jsonl")), known.select(folder.alias("dir")))


def kimi_sessions(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Records from (path, line_no, raw), with the work folders (dir) that are known."""
    rows = rows.select("path", F.regexp_extract("path", r"([^/]+)/([^/]+)/context\.jsonl$", 1).alias("digest"), F.regexp_extract("path", r"([^/]+)/([^/]+)/context\.jsonl$", 2).alias("session"), F.col("line_no").alias("ord"), "raw")
    known = folders.where("dir != ''").distinct().select(F.md5("dir").alias("digest"), "dir")
    e = B.parsed(rows.join(known, "digest", "left"))
    v = F.col("v")
    role = B.s(v, "$.role")
    blocks = B.arr(v, "$.content")
    calls = F.transform(_objects(v, "$.tool_calls"), lambda c: B.call(B.s(c, "$.function.name"), B.decoded(B.s(c, "$.function.arguments")), F.lit(None).cast(schema.OUTPUT), F.lit("")))
    turn = F.when(role == "user", B.turn(F.lit("user"), F.lit(""), B.s(v, "$.content"))).when(role == "assistant", B.turn(F.lit("assistant"), F.lit(""), B.texts(blocks, "text", "", "$.text"), B.texts(blocks, "think", "\n", "$.text"), calls))
    meta = e.groupBy("path").agg(
        F.concat(F.first("digest"), F.lit("/"), F.first("session")).alias("record_id"), F.first(F.coalesce("dir", F.concat(F.lit("kimi:"), "digest"))).alias("grouping"), F.coalesce(F.first("dir"), F.lit("")).alias("working_dir"),
        F.max(F.when(role == "_usage", B.number(v, "$.token_count")).otherwise(0)).alias("output_tokens"),
    ).withColumns({"model": F.lit("kimi-k2"), "input_tokens": F.lit(0)})
    return B.finish(meta, e.select("path", "ord", turn.alias("turn")).where("turn is not null"), "kimi")


def openclaw(spark: SparkSession, root: str) -> DataFrame:
    """``**/sessions/*.jsonl`` whose first JSON line is a session header; other files give no record."""
    return openclaw_sessions(B.lines(B.files(spark, root, "*.jsonl").where("path like '%/sessions/%'")))


def openclaw_sessions(lines: DataFrame) -> DataFrame:
    """Records from (path, line_no, raw)."""
    e = B.parsed(lines)
    v = F.col("v")
    kind, role = B.s(v, "$.type"), B.s(v, "$.message.role")
    head = e.groupBy("path").agg(F.min("line_no").alias("h"))
    e = e.join(head, "path").withColumn("kind", kind)
    good = e.where("line_no = h and kind = 'session'").select("path")
    e = e.join(good, "path", "left_semi").withColumn("role", role)
    body = e.where("line_no > h")
    content = F.transform(_objects(v, "$.message.content"), lambda b: B.block(F.lit("text"), text=B.s(b, "$.text")))
    joined = F.array_join(F.filter(F.transform(content, lambda b: b["text"]), lambda t: t != ""), "\n")
    results = body.where("kind = 'message' and role = 'toolResult'").select("path", "line_no", B.s(v, "$.message.toolCallId").alias("id"), B.output(joined, content).alias("out"))
    results = results.groupBy("path", "id").agg(F.max_by("out", "line_no").alias("out")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("id", "out"))).alias("results"))
    body = body.join(results, "path", "left").withColumn("results", F.coalesce("results", F.map_from_arrays(F.array(), F.array()).cast(f"map<string,{schema.OUTPUT}>")))
    at = B.time_at(v, "$.timestamp")
    blocks = B.arr(v, "$.message.content")

    def call(b: Column) -> Column:
        out = F.col("results")[B.s(b, "$.id")]
        return B.call(B.s(b, "$.name"), B.decoded(B.s(b, "$.arguments")), out, F.when(F.coalesce(F.contains(F.lower(out["text"]), F.lit("error")), F.lit(False)), "error").otherwise("success"))

    said = B.turn(F.col("role"), at, B.texts(blocks, "text", "", "$.text"), B.texts(blocks, "thinking", "\n", "$.text"), F.transform(F.filter(blocks, B.is_type("toolCall")), call))
    code = F.coalesce(F.when(F.schema_of_variant(B.sub(v, "$.exitCode")) != "STRING", F.try_variant_get(v, "$.exitCode", "bigint")), F.lit(1))
    shell = B.call(F.lit("bash"), F.to_json(F.struct(B.s(v, "$.command").alias("command"))), B.output(B.s(v, "$.output"), None, F.to_json(F.struct(code.alias("exit_code")))), F.when(code == 0, "success").otherwise("error"))
    turn = F.when((F.col("kind") == "message") & F.col("role").isin("user", "assistant"), said).when(F.col("kind") == "bashExecution", B.turn(F.lit("assistant"), at, F.lit(""), None, F.array(shell)))
    turns = body.select("path", F.col("line_no").alias("ord"), turn.alias("turn")).where("turn is not null")
    model = F.when(F.col("kind") == "model_change", F.regexp_replace(F.trim(F.concat(B.s(v, "$.provider"), F.lit("/"), B.s(v, "$.modelId"))), "^/+|/+$", "")).otherwise("")
    spoken = F.when((F.col("kind") == "message") & F.col("role").isin("user", "assistant"), at).otherwise("")
    header = F.col("line_no") == F.col("h")
    of = lambda path: F.coalesce(F.max(F.when(header, B.s(v, path))), F.lit(""))
    start = F.coalesce(F.max(F.when(header, at)), F.lit(""))
    meta = e.groupBy("path").agg(of("$.id").alias("record_id"), of("$.cwd").alias("working_dir"), start.alias("started_at"), F.coalesce(F.nullif(B.latest(spoken), F.lit("")), start).alias("ended_at"), F.coalesce(F.nullif(B.last(model, F.col("line_no")), F.lit("")), F.lit("openclaw/unknown")).alias("model"))
    meta = meta.withColumns({"grouping": F.coalesce(F.nullif("working_dir", F.lit("")), F.lit("openclaw:unknown")), "input_tokens": F.lit(0), "output_tokens": F.lit(0)})
    return B.finish(meta, turns, "openclaw")


def supplied(spark: SparkSession, root: str) -> DataFrame:
    """Canonical JSONL under ``<root>/<folder>/``: rows without id, model or turns are left out; origin and grouping come from the folder."""
    rows = B.lines(B.files(spark, root, "*.jsonl")).withColumn("r", F.from_json("raw", schema.RECORD, {"mode": "PERMISSIVE"}))
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    folder = F.split_part(F.regexp_replace("path", "^" + base.replace(".", r"\."), ""), F.lit("/"), F.lit(1))
    rows = rows.where("r.record_id != '' and r.model != '' and size(r.turns) > 0").select("r.*", folder.alias("g"))
    return rows.withColumn("origin", F.lit("supplied")).withColumn("grouping", F.concat(F.lit("supplied/"), "g")).drop("g")
