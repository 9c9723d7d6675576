"""Queries of the steps around extraction and of the session folds' facts, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, secretscan
from ..operators import attest, extraction, manifest, records
from ..session import table
from ..sources import claudecode, codex, databases, sinks, traces
from . import layouts
from .reference import _EMAILS, _ENT, _IPS, ONE, _entries, _lit, _quoted, _records

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("scope_filter", f"select record_id, origin from {ONE} where origin = 'codex'")
def scope_filter(s: SparkSession, d: str) -> DataFrame:
    scope = extraction.resolve_scope("", False, "codex")
    return extraction.in_scope(_records(s, d), scope, ("codex", "claudecode")).select("record_id", "origin")


@query("copy_sources", f"""select path, substr(sha256(regexp_extract(path, '^(.*)/([^/]+)$', 1)), 1, 8) || '/' || regexp_extract(path, '([^/]+)$', 1) as target
 from (select distinct _provenance.source_path as path from records where origin in ('claudecode', 'codex') and _provenance.source_path <> '')""")
def copy_sources(s, d):
    return extraction.copy_sources(table(s, d, "records"), sinks.NATIVE)


@query("warning_dedup", "select distinct trim(author) as warning from documents where trim(author) <> ''")
def warning_dedup(s, d):
    return extraction.distinct_warnings(table(s, d, "documents"), "author")


@query("origins_seen", f"select origin, row_number() over (order by min(record_id)) as position from {ONE} where trim(origin) <> '' group by 1")
def origins_seen(s, d):
    return extraction.origins_seen(_records(s, d), "record_id")


_FOUND = " union all ".join(f"select unnest(regexp_extract_all(text, {_lit(p)}, {g})) as raw, {i} as i from documents where text is not null" for i, (_, p, g) in enumerate(secretscan.PATTERNS))
_LABELS = "[" + ", ".join(f"'{n}'" for n, _, _ in secretscan.PATTERNS) + "]"


@query("secrets_seen", f"select 'sha256:' || sha256(raw) as fingerprint, {_LABELS}[min(i) + 1] as label from ({_FOUND}) group by raw")
def secrets_seen(s, d):
    return extraction.secrets_seen(table(s, d, "documents"), "text")


@query("secrets_distinct", f"select count(distinct raw) as secrets from ({_FOUND})")
def secrets_distinct(s, d):
    return extraction.secrets_seen(table(s, d, "documents"), "text").agg(F.count_distinct("fingerprint").alias("secrets"))


@query("upload_lookup", """select e.entry_id, f.file from (select distinct on (entry_id) entry_id, source_hash from manifest_entries) e
 left join (select source_hash, arg_max(file, (coalesce(batch_no, -1), entry_id)) as file from (select distinct on (entry_id) * from manifest_entries) where source_hash is not null group by 1) f using (source_hash)""")
def upload_lookup(s, d):
    e = _entries(s, d)
    order = F.struct(F.coalesce("batch_no", F.lit(-1)).alias("b"), F.col("entry_id").alias("e"))
    return extraction.upload_lookup(e.select("entry_id", "source_hash"), e, order).select("entry_id", "file")


@query("path_slashes", f"select record_id, replace(coalesce(working_dir, ''), chr(92), '/') as path from {ONE}")
def path_slashes(s, d):
    return _records(s, d).select("record_id", extraction.slashed(F.col("working_dir")).alias("path"))


@query("sample_count", r"select doc_id, coalesce(try_cast(regexp_extract(text, '\b(\d+)\b', 1) as bigint), 0) as n from documents where text is not null")
def sample_count(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", scalar.sample_count(F.col("text")).alias("n"))


@query("name_examples")
def name_examples(s, d):
    return attest.name_examples(table(s, d, "documents"), "doc_id", "text", "Orrin")


@query("name_lines", "select doc_id from documents where contains(lower(text), 'orrin') order by doc_id limit 5")
def name_lines(s, d):
    return attest.name_examples(table(s, d, "documents"), "doc_id", "text", "Orrin").select("doc_id")


@query("entropy_contexts", f"""select doc_id, v as value from (select doc_id, unnest(list_transform(regexp_extract_all(text, {_lit(secretscan.QUOTED)}), lambda q: q[2:-2])) as v from documents where text is not null)
 where regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]') and {_ENT} >= 4.0""")
def entropy_contexts(s, d):
    return attest.entropy_contexts(table(s, d, "documents"), "doc_id", "text").select("doc_id", "value")


@query("findings_entropy", f"""select doc_id, v as value from (select doc_id, generate_subscripts(q, 1) as i, unnest(q) as v from (select doc_id, list_transform(regexp_extract_all(text, {_lit(secretscan.QUOTED)}), lambda q: q[2:-2]) as q from documents where text is not null))
 where regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]') and {_ENT} >= 4.0 order by doc_id, i limit 15""")
def findings_entropy(s, d):
    return attest.samples(table(s, d, "documents"), "doc_id", "text", "high_entropy").select("doc_id", "value")


_TURN_IPS = f"(select record_id, i - 1 as turn_no, x.text as text from (select record_id, unnest(turns) as x, generate_subscripts(turns, 1) as i from {ONE}) where x.text is not null)"


@query("public_ips_in_turns", f"select record_id, turn_no::bigint as turn_no, unnest({_IPS}) as value from {_TURN_IPS}")
def public_ips_in_turns(s, d):
    turns = _records(s, d).select("record_id", F.posexplode("turns").alias("turn_no", "x")).where("x.text is not null")
    return turns.select("record_id", F.col("turn_no").cast("long").alias("turn_no"), F.explode(secretscan.public_ips(F.col("x.text"))).alias("value"))


@query("canonical_content", f"""select record_id, coalesce(model, '') as model, coalesce(title, '') as title, coalesce(len(turns), 0)::bigint as turns, coalesce(md5(turns[1].text), '') as first_text, coalesce(usage.input_tokens, 0)::bigint as input_tokens from {ONE}""")
def canonical_content(s, d):
    v = F.try_parse_json("value")
    of = lambda p, t: F.try_variant_get(v, p, t)
    lines = sinks.json_lines(_records(s, d))
    return lines.select(
        of("$.record_id", "string").alias("record_id"), F.coalesce(of("$.model", "string"), F.lit("")).alias("model"), F.coalesce(of("$.title", "string"), F.lit("")).alias("title"),
        F.coalesce(F.size(of("$.turns", "array<variant>")), F.lit(0)).cast("long").alias("turns"), F.coalesce(F.md5(of("$.turns[0].text", "string")), F.lit("")).alias("first_text"),
        F.coalesce(of("$.usage.input_tokens", "bigint"), F.lit(0)).cast("long").alias("input_tokens"),
    )


@query("reasoning_dropped", f"""select record_id, coalesce(sum(length(x.text)), 0)::bigint as text_chars, coalesce(sum(length(x.reasoning)), 0)::bigint as dropped_chars, 0::bigint as left_chars
 from (select record_id, unnest(case when len(turns) > 0 then turns else [null] end) as x from {ONE}) group by 1""")
def reasoning_dropped(s, d):
    chars = lambda a, f: F.aggregate(F.filter(F.coalesce(a, F.array().cast("array<void>")), lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda acc, x: acc + F.length(F.coalesce(x[f], F.lit(""))))
    blank = F.transform("turns", lambda x: F.when(x.isNotNull(), x.withField("reasoning", F.lit(""))))
    rows = _records(s, d).select("record_id", "turns", blank.alias("b"))
    some = lambda c, f: F.when(F.size(F.filter(F.coalesce(c, F.array().cast("array<void>")), lambda x: x.isNotNull())) > 0, chars(c, f)).otherwise(0).cast("long")
    return rows.select("record_id", some(F.col("b"), "text").alias("text_chars"), some(F.col("turns"), "reasoning").alias("dropped_chars"), some(F.col("b"), "reasoning").alias("left_chars"))


@query("findings_counted", f"""select (select count(*) from (select unnest({_EMAILS}) from documents where text is not null)) as emails, (select count(*) from (select unnest({_IPS}) from documents where text is not null)) as public_ips,
 (select count(*) from (select distinct doc_id, raw from ({" union all ".join(f"select doc_id, unnest(regexp_extract_all(text, {_lit(p)}, {g})) as raw from documents where text is not null" for _, p, g in secretscan.PATTERNS)}))) as tokens""")
def findings_counted(s, d):
    return attest.counts(table(s, d, "documents"), "doc_id", "text").select("emails", F.col("public_ips").cast("long").alias("public_ips"), F.col("tokens").cast("long").alias("tokens"))


# The adapters' folds, by facts that SQL can count over the same lines.
@query("codex_facts", """with r as (select distinct on (row_id) * from codex_session where session_id is not null)
 select session_id, count(distinct file) as files, sum(n)::bigint as calls from (select session_id, file, count(*) filter (where type = 'response_item' and case when json_valid(payload) then json_extract_string(payload, '$.type') end in ('function_call', 'custom_tool_call')) as n from r group by 1, 2) group by 1""")
def codex_facts(s, d):
    rows = table(s, d, "codex_session").where("session_id is not null").dropDuplicates(["row_id"])
    raw = F.concat(F.lit('{"type":'), _quoted("type"), F.lit(',"timestamp":'), F.coalesce(_quoted("timestamp"), F.lit("null")), F.lit(',"payload":'), F.coalesce(F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")), F.lit("null")), F.lit("}"))
    lines = rows.select(F.concat_ws("\t", "session_id", F.coalesce("file", F.lit(""))).alias("path"), F.col("line_no").alias("ord"), raw.alias("raw"), F.col("session_id").alias("record_id"))
    done = codex.assemble(lines).select(F.split_part("_provenance.source_path", F.lit("\t"), F.lit(1)).alias("session_id"), F.split_part("_provenance.source_path", F.lit("\t"), F.lit(2)).alias("file"), "usage.tool_calls")
    return done.groupBy("session_id").agg(F.count_distinct(F.nullif("file", F.lit(""))).alias("files"), F.sum("tool_calls").alias("calls"))


_OUT = "json_extract(raw, '$.message.usage.output_tokens')"


@query("claudecode_facts", f"""with l as (select distinct on (file_id, line_no) file_id, raw from raw_lines where store = 'claudecode' and raw is not null and json_valid(raw) and left(ltrim(raw), 1) = '{{')
 select file_id::varchar as path, coalesce(sum(case when json_extract_string(raw, '$.type') = 'assistant' and json_type({_OUT}) in ('UBIGINT', 'BIGINT', 'DOUBLE') then trunc({_OUT}::double)::bigint end), 0)::bigint as output_tokens from l group by 1""")
def claudecode_facts(s, d):
    rows = table(s, d, "raw_lines").where("store = 'claudecode'").dropDuplicates(["file_id", "line_no"])
    done = claudecode.assemble(rows.select(F.col("file_id").cast("string").alias("path"), F.col("line_no").alias("ord"), "raw", F.col("file").alias("record_id"), F.lit("claudecode").alias("grouping")).where("raw is not null"))
    return done.select(F.col("_provenance.source_path").alias("path"), "usage.output_tokens")


_REPO = r"string_split_regex(regexp_replace(regexp_replace(trim(g), '/+$', ''), '\.git$', ''), '[/:]')[-1]"


@query("orchestrated_sessions", f"""select 'orchestrator:' || {_REPO} as grouping, branch, count(*) as sessions, sum(n)::bigint as turns from (
 select record_id, grouping as g, coalesce(branch, '') as branch, (select count(*) from (select unnest(ts) as x) where x.role in ('user', 'assistant') and x.text <> '') as n
 from (select record_id, grouping, branch, list_filter(coalesce(turns, []), lambda x: x is not null) as ts from {ONE} where trim(grouping) <> '')) where n > 0 group by 1, 2""")
def orchestrated_sessions(s, d):
    """The records taken apart into the orchestrator's four tables and put together again by its adapter."""
    r = _records(s, d).where("trim(grouping) != ''")
    none = F.lit(None).cast("string")
    place = F.concat_ws("\t", "grouping", F.coalesce("branch", F.lit("")))
    repos = r.select(F.col("grouping").alias("id"), F.col("grouping").alias("name"), none.alias("remote"), none.alias("path")).distinct()
    workspaces = r.select(place.alias("id"), F.col("grouping").alias("repo"), none.alias("label"), none.alias("codename"), "branch", none.alias("path")).dropDuplicates(["id"])
    sessions = r.select(F.col("record_id").alias("id"), place.alias("workspace"), F.col("origin").alias("agent"), none.alias("external"), "model", "title")
    turns = r.select("record_id", F.posexplode("turns").alias("n", "x")).where("x.role in ('user', 'assistant') and x.text != ''")
    at = F.lpad(F.col("n").cast("string"), 9, "0")
    messages = turns.select(F.concat_ws("\t", "record_id", at).alias("id"), F.col("record_id").alias("session"), "x.role", F.col("x.text").alias("content"), none.alias("payload"), none.alias("model"), at.alias("sent"), at.alias("created"))
    done = databases.orchestrated(repos, workspaces, sessions, messages)
    return done.groupBy("grouping", "branch").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.size("turns")).cast("long").alias("turns"))


@query("resolved_tools", f"""with n as (select distinct call.tool as name from (select unnest(x.tool_calls) as call from (select unnest(turns) as x from {ONE}) where x is not null) where call is not null and coalesce(call.tool, '') <> '')
 select name, case name when 'bash' then 'Runs a command' else '' end as description from n""")
def resolved_tools(s, d):
    inferred = extraction.parameters_json(records.infer_tools(_records(s, d)))
    catalog = extraction.tools_of(s, '[{"type": "function", "function": {"name": "bash", "description": "Runs a command"}}, {"name": "never_called", "description": "x"}, {"description": "nameless"}]')
    return extraction.resolve_tools(inferred, None, catalog).select("name", "description")


@query("session_lookup", """select session_id, count(*) as rows from (select distinct on (row_id) * from codex_session) where session_id in (select min(session_id) from codex_session union all select max(session_id) from codex_session) group by 1""")
def session_lookup(s, d):
    rows = table(s, d, "codex_session").dropDuplicates(["row_id"])
    wanted = table(s, d, "codex_session").agg(F.array(F.min("session_id"), F.max("session_id")).alias("ids")).select(F.explode("ids").alias("id"))
    return extraction.lookup(rows, "session_id", wanted).groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))


@query("manifest_claims")
def manifest_claims(s, d):
    e = _entries(s, d).withColumn("b", F.coalesce("batch_no", F.lit(-1)))
    newest = e.agg(F.max("b")).first()[0]
    return manifest.diff(e.where(F.col("b") == F.lit(newest)), e.where(F.col("b") != F.lit(newest)), F.col("entry_id"))


# The other stores: the records' turns are spelled as the store keeps them and read back by its adapter.
_SPOKEN = f"(select record_id, i, x.role as role, x.text as text from (select record_id, unnest(turns) as x, generate_subscripts(turns, 1) as i from {ONE}) where x.role in ('user', 'assistant') and trim(x.text) <> '')"
for _store, _id in {"gemini": "record_id", "kimi": "md5(record_id)", "openclaw": "record_id", "opencode": "record_id", "cursor": "record_id"}.items():
    SQL[f"{_store}_turns"] = f"select {_id} as record_id, count(*) as turns, count(*) filter (where role = 'user') as user_turns, md5(string_agg(text, chr(10) order by i)) as texts from {_SPOKEN} group by record_id"


def _spoken(s: SparkSession, d: str) -> DataFrame:
    turns = _records(s, d).select("record_id", F.posexplode("turns").alias("n", "x"))
    return turns.where("x.role in ('user', 'assistant') and trim(x.text) != ''").select("record_id", "n", "x.role", "x.text")


def _told(records_: DataFrame, key) -> DataFrame:  # noqa: ANN001
    texts = F.array_join(F.transform("turns", lambda x: x["text"]), "\n")
    return records_.select(key.alias("record_id"), F.size("turns").cast("long").alias("turns"), F.col("usage.user_turns").alias("user_turns"), F.md5(texts).alias("texts"))


@query("gemini_turns", SQL["gemini_turns"])
def gemini_turns(s, d):
    said = F.struct(F.when(F.col("role") == "user", "user").otherwise("gemini").alias("type"), F.col("text").alias("content"))
    docs = _spoken(s, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("n", said.alias("m")))).alias("a"))
    docs = docs.select(F.concat(F.lit("/g/"), F.md5("record_id"), F.lit("/chats/session-1.json")).alias("path"), F.to_json(F.struct(F.col("record_id").alias("sessionId"), F.transform("a", lambda x: x["m"]).alias("messages"))).alias("value"))
    return _told(traces.gemini_traces(docs), F.col("record_id"))


@query("kimi_turns", SQL["kimi_turns"])
def kimi_turns(s, d):
    block = F.array(F.struct(F.lit("text").alias("type"), "text"))
    raw = F.when(F.col("role") == "user", F.to_json(F.struct("role", F.col("text").alias("content")))).otherwise(F.to_json(F.struct("role", block.alias("content"))))
    lines = _spoken(s, d).select(F.concat(F.lit("/k/sessions/x/"), F.md5("record_id"), F.lit("/context.jsonl")).alias("path"), F.col("n").cast("long").alias("line_no"), raw.alias("raw"))
    return _told(traces.kimi_sessions(lines, s.createDataFrame([], "dir string")), F.substring_index("record_id", "/", -1))


@query("openclaw_turns", SQL["openclaw_turns"])
def openclaw_turns(s, d):
    spoken = _spoken(s, d)
    path = F.concat(F.lit("/o/sessions/"), F.md5("record_id")).alias("path")
    heads = spoken.select("record_id").distinct().select(path, F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("session").alias("type"), F.col("record_id").alias("id"))).alias("raw"))
    message = F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    lines = spoken.select(path, (F.col("n") + 1).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("message").alias("type"), message.alias("message"))).alias("raw"))
    return _told(traces.openclaw_sessions(heads.unionByName(lines)), F.col("record_id"))


@query("opencode_turns", SQL["opencode_turns"])
def opencode_turns(s, d):
    spoken = _spoken(s, d)
    at = F.col("n").cast("string").alias("time_created")
    mid = F.concat_ws("#", "record_id", F.col("n"))
    none = F.lit(None).cast("string")
    session = spoken.select("record_id").distinct().select(F.col("record_id").alias("id"), none.alias("directory"), none.alias("time_created"), none.alias("time_updated"))
    message = spoken.select(mid.alias("id"), F.col("record_id").alias("session_id"), at, F.to_json(F.struct("role")).alias("data"))
    part = spoken.select(F.lit("p").alias("id"), mid.alias("message_id"), at, F.to_json(F.struct(F.lit("text").alias("type"), "text")).alias("data"))
    return _told(databases.opencode_sessions(session, message, part), F.col("record_id"))


@query("cursor_turns", SQL["cursor_turns"])
def cursor_turns(s, d):
    spoken = _spoken(s, d)
    name = F.col("n").cast("string")
    heads = spoken.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("n", F.struct(name.alias("bubbleId")).alias("h")))).alias("a"))
    heads = heads.select(F.concat(F.lit("composerData:"), "record_id").alias("key"), F.to_json(F.struct(F.transform("a", lambda x: x["h"]).alias("fullConversationHeadersOnly"))).alias("value"))
    bubbles = spoken.select(F.concat(F.lit("bubbleId:"), "record_id", F.lit(":"), name).alias("key"), F.to_json(F.struct(F.when(F.col("role") == "user", 1).otherwise(2).alias("type"), "text")).alias("value"))
    return _told(databases.cursor_composers(heads.unionByName(bubbles)), F.col("record_id"))


#: A tool as the layouts' queries announce it.
SHELL = {"name": "bash", "description": "Runs a command", "parameters": {"type": "object", "properties": {"command": {"type": "string", "description": "what to run"}}, "required": ["command"]}}

for _name in layouts.LAYOUTS:
    QUERIES["layout_" + _name.replace(".", "_")] = lambda s, d, n=_name: layouts.render_layout(_records(s, d), n, [SHELL], "<s>")

# A record of turns without calls, attachments, outputs or nulls is a plain line of frames in two of the layouts.
_PLAIN = f"""(select record_id, ts from (select record_id, list_filter(coalesce(turns, []), lambda x: x is not null) as ts from {ONE}) where len(list_filter(ts, lambda x: coalesce(len(list_filter(x.tool_calls, lambda c: c is not null)), 0) > 0)) = 0)"""
_HERMES = layouts.hermes([], None, "", False).replace("'", "''")
SQL["hermes_plain"] = f"""select record_id, '{_HERMES}' || coalesce(list_aggregate(list_transform(list_filter(ts, lambda x: x.role in ('user', 'assistant', 'system')), lambda x: '<|im_start|>' || x.role || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), 'string_agg', ''), '') as content from {_PLAIN}"""


@query("hermes_plain", SQL["hermes_plain"])
def hermes_plain(s, d):
    r = _records(s, d)
    called = r.select("record_id", F.explode("turns").alias("x")).where(F.size(F.filter("x.tool_calls", lambda c: c.isNotNull())) > 0).select("record_id").distinct()
    return layouts.render_layout(r.join(called, "record_id", "left_anti"), "hermes").select("record_id", "content")
