"""Sessions kept in SQLite files, read through a Python data source, and their adapters."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .. import schema
from ..functions.scalar import first_non_empty, normalize_timestamp, repository_name
from . import build as B


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


class Rowids(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]) -> None:
        self.path, self.table, self.fields = options["path"], options["table"], fields
        self.partitions_wanted = int(options.get("partitions", "8"))
        self.where = options.get("where", "1")

    def partitions(self) -> list[InputPartition]:
        try:
            with connect(self.path) as c:
                low, high = c.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        except sqlite3.OperationalError as e:
            if "no such column" not in str(e):
                raise
            return [Rowids(0, -1)]  # tables without rowid are read as one
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.partitions_wanted))
        return [Rowids(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rowids) -> Iterator[tuple]:
        ranged = f" and rowid between {partition.low} and {partition.high}" if partition.high >= partition.low else ""
        names = ", ".join(f'"{f}"' for f in self.fields)
        with connect(self.path) as c:
            for row in c.execute(f'select {names} from "{self.table}" where ({self.where}){ranged}'):
                yield tuple(x.decode("utf-8", "replace") if isinstance(x, bytes) else None if x is None else str(x) for x in row)


class SqliteSource(DataSource):
    """``format("weftline_sqlite")`` with path, table and optional where and partitions; every column is text."""

    @classmethod
    def name(cls) -> str:
        return "weftline_sqlite"

    def schema(self) -> StructType:
        with connect(self.options["path"]) as c:
            names = [r[1] for r in c.execute(f'pragma table_info("{self.options["table"]}")')]
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema.names)


def tables(path: str) -> dict[str, list[str]]:
    """Column names by table; {} for a missing file."""
    if not os.path.exists(path):
        return {}
    with connect(path) as c:
        names = [r[0] for r in c.execute("select name from sqlite_master where type = 'table'")]
        return {n: [r[1] for r in c.execute(f'pragma table_info("{n}")')] for n in names}


def read_table(spark: SparkSession, path: str, table: str, where: str = "1") -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("weftline_sqlite").options(path=path, table=table, where=where).load()


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.RECORD)


def _time(c: Column) -> Column:
    return normalize_timestamp(F.coalesce(c, F.lit("")))


def _raw_output(v: Column, path: str) -> Column:
    raw = B.json_at(v, path)
    text = F.when(F.schema_of_variant(B.sub(v, path)) == "STRING", F.try_variant_get(v, path, "string"))
    return F.when(raw.isNotNull(), B.output(text, None, raw))


def opencode(spark: SparkSession, path: str) -> DataFrame:
    """Sessions with their messages and parts, both in order of creation; messages without content only stretch the times."""
    if not {"session", "message", "part"} <= set(tables(path)):
        return empty(spark)
    return opencode_sessions(*(read_table(spark, path, t) for t in ("session", "message", "part")))


def opencode_sessions(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """Records from the three tables, all columns text."""
    p = B.parsed(part, "data").select("message_id", F.struct(F.col("time_created").try_cast("double").alias("t"), "id").alias("o"), "v")
    v = F.col("v")
    kind = B.s(v, "$.type")
    status = B.s(v, "$.state.status")
    call = B.call(B.s(v, "$.tool"), B.json_at(v, "$.state.input"), _raw_output(v, "$.state.output"), F.when(status == "completed", "success").otherwise(status))
    url, mime = B.s(v, "$.url"), B.s(v, "$.mime")
    null = F.lit(None).cast("string")
    data = url.startswith("data:")
    file = B.block(F.when(F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1)))).startswith("image/"), "image").otherwise("document"), media_type=mime, data=F.when(data, url).otherwise(null), url=F.when(data, null).otherwise(url))
    item = lambda cond, x: F.array_sort(F.collect_list(F.when(cond, F.struct("o", x.alias("x")))))
    parts = p.groupBy("message_id").agg(
        item(kind == "text", B.s(v, "$.text")).alias("text"), item((kind == "reasoning"), B.s(v, "$.text")).alias("why"), item(kind == "tool", call).alias("calls"), item(kind == "file", file).alias("files"),
    )
    values = lambda c: F.transform(c, lambda x: x["x"])
    m = B.parsed(message, "data").join(parts, F.col("id") == parts["message_id"], "left").withColumn("at", _time(F.col("time_created")))
    listed = lambda c: F.coalesce(values(F.col(c)), F.array())
    turn = B.turn(B.s(v, "$.role"), F.col("at"), F.array_join(listed("text"), ""), F.array_join(listed("why"), "\n"), F.coalesce(values(F.col("calls")), F.array().cast(B.CALLS)), F.coalesce(values(F.col("files")), F.array().cast(B.BLOCKS)))
    m = m.select(F.col("session_id").alias("path"), F.struct(F.col("time_created").try_cast("double").alias("t"), "id").alias("ord"), "v", "at", turn.alias("turn"))
    name = F.regexp_replace(F.trim(F.concat(B.s(v, "$.model.providerID"), F.lit("/"), B.s(v, "$.model.modelID"))), "^/+|/+$", "")
    total = lambda *ps: F.coalesce(F.sum(sum((B.number(v, x) for x in ps), F.lit(0))), F.lit(0))
    facts = m.groupBy("path").agg(B.last(name, F.col("ord")).alias("m"), total("$.tokens.input", "$.tokens.cache.read", "$.tokens.cache.write").alias("i"), total("$.tokens.output").alias("u"), B.earliest(F.col("at")).alias("a"), B.latest(F.col("at")).alias("z"))
    joined = session.join(facts, session["id"] == facts["path"], "left")
    known = lambda *c: F.filter(F.array(*c), lambda t: t.isNotNull() & (t != ""))
    directory = F.coalesce("directory", F.lit(""))
    meta = joined.select(
        F.col("id").alias("path"), F.col("id").alias("record_id"), F.when(directory == "", "opencode:unknown").otherwise(directory).alias("grouping"), directory.alias("working_dir"),
        F.coalesce(F.nullif("m", F.lit("")), F.lit("opencode/unknown")).alias("model"), F.coalesce(F.array_min(known(_time(F.col("time_created")), F.col("a"))), F.lit("")).alias("started_at"),
        F.coalesce(F.array_max(known(_time(F.col("time_updated")), F.col("z"))), F.lit("")).alias("ended_at"), F.coalesce("i", F.lit(0)).alias("input_tokens"), F.coalesce("u", F.lit(0)).alias("output_tokens"),
    )
    return B.finish(meta, m.where(B.contentful()).select("path", "ord", "turn"), "opencode")


def cursor(spark: SparkSession, path: str) -> DataFrame:
    """A key-value table: composers list their bubbles, each found under its own key; missing bubbles are skipped."""
    if "cursorDiskKV" not in tables(path):
        return empty(spark)
    return cursor_composers(read_table(spark, path, "cursorDiskKV", "key like 'composerData:%' or key like 'bubbleId:%'"))


def cursor_composers(pairs: DataFrame) -> DataFrame:
    """Records from (key, value)."""
    composers = B.parsed(pairs.where("key like 'composerData:%'"), "value").withColumn("composer", F.substring("key", 14, 1000))
    v = F.col("v")
    full = B.arr(v, "$.fullConversationHeadersOnly")
    heads = composers.select("composer", F.posexplode(F.when(F.size(full) > 0, full).otherwise(B.arr(v, "$.conversation"))).alias("ord", "h"))
    heads = heads.select("composer", "ord", F.concat(F.lit("bubbleId:"), "composer", F.lit(":"), B.s(F.col("h"), "$.bubbleId")).alias("key"))
    bubbles = B.parsed(pairs.where("key like 'bubbleId:%'"), "value").select("key", "v")
    rows = heads.join(bubbles, "key")
    at = B.time_at(v, "$.createdAt")

    def payload(path_: str) -> Column:
        text = B.json_string(v, path_)
        return F.when(text.isNotNull(), B.decoded(text)).otherwise(B.json_at(v, path_))

    params = payload("$.toolFormerData.params")
    inner = B.json_at(F.try_parse_json(params), "$.tools[0].parameters")
    result = payload("$.toolFormerData.result")
    result_v = F.try_parse_json(result)
    out = F.when(result.isNotNull(), B.output(F.when(F.schema_of_variant(result_v) == "STRING", F.try_variant_get(result_v, "$", "string")), None, result))
    name = B.s(v, "$.toolFormerData.name")
    short = F.when(name.startswith("mcp_"), F.element_at(F.split(name, "_"), -1)).when(name.startswith("mcp-"), F.element_at(F.split(name, "-"), -1)).otherwise(name)
    status = B.s(v, "$.toolFormerData.status", "$.toolFormerData.status.status", "$.toolFormerData.status.state")
    has_tool = F.coalesce(F.schema_of_variant(B.sub(v, "$.toolFormerData")).startswith("OBJECT"), F.lit(False))
    calls = F.when(has_tool, F.array(B.call(short, F.coalesce(inner, params), out, status))).otherwise(F.array().cast(B.CALLS))
    kind = B.number(v, "$.type")
    role = F.when(kind == 1, "user").when(kind == 2, "assistant")
    rows = rows.withColumn("role", role).withColumn("at", F.when(role.isNotNull(), at).otherwise(""))
    turns = rows.where("role is not null").select(F.col("composer").alias("path"), "ord", B.turn(F.col("role"), F.col("at"), B.s(v, "$.text"), B.s(v, "$.thinking.text"), calls).alias("turn"))
    uri = F.regexp_replace(B.s(v, "$.workspaceUris[0]"), "^file://", "")
    meta = rows.groupBy("composer").agg(
        F.coalesce(F.nullif(B.last(B.s(v, "$.modelInfo.modelName"), F.col("ord")), F.lit("")), F.lit("cursor/unknown")).alias("model"), B.first(F.when(F.col("ord") < 5, uri).otherwise(""), F.col("ord")).alias("working_dir"),
        B.earliest(F.col("at")).alias("started_at"), B.latest(F.col("at")).alias("ended_at"), F.sum(B.number(v, "$.tokenCount.inputTokens")).alias("input_tokens"), F.sum(B.number(v, "$.tokenCount.outputTokens")).alias("output_tokens"),
    )
    meta = meta.withColumn("path", F.col("composer")).withColumnRenamed("composer", "record_id").withColumn("grouping", F.coalesce(F.nullif("working_dir", F.lit("")), F.lit("cursor:unknown")))
    return B.finish(meta, turns, "cursor")


# Names of agents by their stripped lower-case spellings.
AGENTS = {"ampcli": "amp", "ampcode": "amp", "ampcodecli": "amp", "claude": "claudecode", "claudecodecli": "claudecode", "anthropic": "claudecode", "geminicli": "gemini", "kimicli": "kimi"}


def agent(name: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{Nd}]", ""))
    known = F.create_map(*[F.lit(x) for kv in AGENTS.items() for x in kv])
    return F.coalesce(known[plain], plain)


def named(names: list[str], *wanted: str) -> str | None:
    """The first name equal to a wanted one in any case, else the first that contains one."""
    for test in (lambda n, w: n.lower() == w, lambda n, w: w in n.lower()):
        for w in wanted:
            for n in names:
                if test(n, w):
                    return n
    return None


# Names by which the drifting tables and columns are found, best first.
ORCHESTRATOR = {
    "repos": ("repositories", "repos", "repository"), "workspaces": ("workspaces", "workspace"), "sessions": ("sessions", "session"), "messages": ("session_messages", "sessionmessages", "messages"),
}
COLUMNS = {
    "repos": {"id": ("id",), "name": ("display_name", "name", "repo_name"), "remote": ("remote_origin", "remote_url", "origin_url", "git_url"), "path": ("path", "root_path", "directory")},
    "workspaces": {"id": ("id",), "repo": ("repository_id", "repo_id"), "label": ("label", "directory_name", "name"), "codename": ("codename", "nickname"), "branch": ("branch", "branch_name"), "path": ("path", "root_path")},
    "sessions": {"id": ("id",), "workspace": ("workspace_id",), "agent": ("agent_type", "agent"), "external": ("external_session_id", "claude_session_id", "agent_session_id"), "model": ("model", "model_id"), "title": ("title", "name")},
    "messages": {"id": ("id",), "session": ("session_id",), "role": ("role",), "content": ("content", "text"), "payload": ("payload", "rich_payload", "data"), "model": ("model", "model_id"), "sent": ("sent_at", "timestamp"), "created": ("created_at", "created_at_ms", "time_created")},
}


def orchestrator(spark: SparkSession, path: str, external: DataFrame | None = None) -> DataFrame:
    """Sessions of repositories and workspaces; a session whose agent's own store knows it takes that record's turns.

    ``external`` holds canonical records of the other stores, matched by (agent,
    id) in one join; its metadata gives way to the session's where that is not blank.
    """
    found = tables(path)
    at = {k: named([t for t in found if t not in ("sqlite_sequence",)], *w) for k, w in ORCHESTRATOR.items()}
    if at["sessions"] and at["messages"] and at["sessions"].lower() == at["messages"].lower() or not all(at.values()):
        return empty(spark)

    def load(kind: str) -> DataFrame:
        df = read_table(spark, path, at[kind])  # type: ignore[arg-type]
        names = {c: named(found[at[kind]], *w) for c, w in COLUMNS[kind].items()}  # type: ignore[index]
        return df.select(*[(F.col(f"`{n}`") if n else F.lit(None).cast("string")).alias(c) for c, n in names.items()])

    return orchestrated(*(load(k) for k in ORCHESTRATOR), external=external)


def orchestrated(repos: DataFrame, workspaces: DataFrame, sessions: DataFrame, messages: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """The orchestrator's records from its four tables, with the columns named as in ``COLUMNS``, all text."""
    # Where a schema has one of the two times of a message, it stands for both.
    messages = messages.withColumn("sent", F.coalesce("sent", "created")).withColumn("created", F.coalesce("created", "sent"))
    r = repos.select(F.col("id").alias("repo"), F.coalesce(F.nullif("name", F.lit("")), "remote").alias("repo_label"), F.col("path").alias("repo_path"))
    w = workspaces.select(F.col("id").alias("workspace"), "repo", first_non_empty(F.col("label"), F.col("codename")).alias("label"), F.coalesce("branch", F.lit("")).alias("branch"), F.col("path").alias("ws_path"))
    folder = F.when((F.coalesce("repo_path", F.lit("")) != "") & (F.col("label") != ""), F.concat_ws("/", F.regexp_replace("repo_path", "/+$", ""), "label")).otherwise(F.coalesce("ws_path", F.lit("")))
    s = sessions.join(w, "workspace").join(r, "repo").select(
        "id", F.coalesce("agent", F.lit("")).alias("agent"), F.trim(F.coalesce("external", F.lit(""))).alias("external"), F.trim(F.coalesce("model", F.lit(""))).alias("model"), F.coalesce("title", F.lit("")).alias("title"),
        "branch", folder.alias("working_dir"), F.concat(F.lit("orchestrator:"), repository_name(F.coalesce("repo_label", F.lit("")))).alias("grouping"),
    )
    v = F.try_parse_json("payload")
    objects = F.filter(B.arr(v, "$.tool_calls"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    calls = F.transform(objects, lambda c: B.call(B.s(c, "$.tool", "$.name"), B.json_at(c, "$.input"), _raw_output(c, "$.output"), B.s(c, "$.status")))
    role = F.when(F.lower("role").isin("user", "assistant"), F.lower("role"))
    time = _time(F.coalesce(F.nullif("sent", F.lit("")), "created"))
    text = first_non_empty(F.coalesce("content", F.lit("")), B.s(v, "$.text", "$.content"))
    turn = B.turn(role, time, F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(text), B.s(v, "$.reasoning"), calls)
    m = messages.select(F.col("session").alias("path"), F.struct(F.coalesce("sent", "created").alias("a"), F.col("created").alias("b"), "id").alias("ord"), turn.alias("turn"), F.coalesce("model", F.lit("")).alias("m"), time.alias("at"))
    turns = m.where(F.col("turn.role").isNotNull()).where(B.contentful())
    times = turns.groupBy("path").agg(B.earliest(F.col("at")).alias("started_at"), B.latest(F.col("at")).alias("ended_at"))
    models = m.groupBy("path").agg(B.first(F.col("m"), F.col("ord")).alias("m"))
    empty_ = lambda c: F.coalesce(c, F.lit("")).alias(c)
    meta = s.withColumn("path", F.col("id")).join(times, "path", "left").join(models, "path", "left")

    def more(source: Column, preferred: Column) -> Column:
        x = F.struct(F.struct(F.col("agent").alias("agent_type"), F.col("id").alias("orchestrator_session_id"), F.col("external").alias("external_session_id"), source.alias("content_source"), preferred.alias("external_store_preferred")).alias("orchestrator"))
        return F.to_json(x)

    own = meta.select("path", F.col("id").alias("record_id"), "grouping", F.coalesce(F.nullif("model", F.lit("")), F.nullif("m", F.lit("")), F.lit("orchestrator/unknown")).alias("model"), "branch", "title", "working_dir",
                      empty_("started_at"), empty_("ended_at"), F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), more(F.lit("orchestrator"), F.lit(False)).alias("extensions"))
    records = B.finish(own, turns.select("path", "ord", "turn"), "orchestrator").where("size(turns) > 0")
    if external is None:
        return records
    e = external.where("size(turns) > 0").select(F.col("origin").alias("e_origin"), F.regexp_extract("record_id", r"([^/]+)$", 1).alias("e_id"), F.struct("*").alias("e"))
    hit = s.where("external != ''").withColumn("key", agent(F.col("agent"))).join(e, (F.col("key") == F.col("e_origin")) & (F.col("external") == F.col("e_id"))).dropDuplicates(["id"])
    pick = lambda c: first_non_empty(F.coalesce(c, F.lit("")), F.coalesce(f"e.{c}", F.lit(""))).alias(c)
    taken = hit.select(
        "e.record_id", F.lit("orchestrator").alias("origin"), "grouping", pick("model"), pick("branch"), "e.started_at", "e.ended_at", pick("working_dir"), pick("title"), "e.turns", "e.usage",
        more(F.col("e_origin"), F.lit(True)).alias("extensions"), "e._provenance", F.col("id").alias("__id"),
    )
    rest = records.join(taken.select(F.col("__id").alias("record_id")), "record_id", "left_anti")
    return rest.unionByName(taken.drop("__id"))
