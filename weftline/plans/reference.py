"""Queries of the operators on canonical records, texts and manifests, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, secretscan
from ..operators import attest, manifest, records, redaction
from ..operators.timestamps import canonical
from ..session import table
from ..sources import claudecode, codex, sinks, traces
from . import render, templates

QUERIES: dict = {}
SQL: dict[str, str] = {}
MARK = secretscan.MARKER


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _records(s: SparkSession, d: str) -> DataFrame:
    """Records once per record_id, the first delivery by source path."""
    return records.first_wins(table(s, d, "records"))


ONE = """(select * exclude (rn) from (select *, row_number() over (partition by record_id
 order by case when origin = 'orchestrator' then 0 else 1 end, origin nulls first, _provenance.source_path nulls first) as rn from records) where rn = 1)"""


@query("record_dedup", f"""select record_id, origin, _provenance.source_path as source_path from {ONE}""")
def record_dedup(s, d):
    return _records(s, d).select("record_id", "origin", F.col("_provenance.source_path").alias("source_path"))


RFC = r"'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$'"


def _bad(c: str) -> str:
    return f"""(coalesce({c}, '') <> '' and not coalesce(regexp_matches({c}, {RFC}) and try_cast(substr({c}, 1, 10) as date) is not null
 and substr({c}, 1, 4) <> '0000' and try_cast(substr({c}, 12, 2) as int) < 24 and try_cast(substr({c}, 15, 2) as int) < 60 and try_cast(substr({c}, 18, 2) as int) < 60
 and (right({c}, 1) = 'Z' or (try_cast(substr(right({c}, 6), 2, 2) as int) <= 24 and try_cast(right({c}, 2) as int) < 60)), false))"""


@query("record_validity", f"""with t as (select *, case
  when trim(coalesce(record_id, '')) = '' then 'record_id is required' when trim(coalesce(origin, '')) = '' then 'origin is required'
  when trim(coalesce(grouping, '')) = '' then 'grouping is required' when trim(coalesce(model, '')) = '' then 'model is required'
  when coalesce(len(turns), 0) = 0 then 'turns must not be empty' when {_bad('started_at')} then 'started_at' when {_bad('ended_at')} then 'ended_at'
  else list_filter(list_transform(turns, lambda x, i: case when coalesce(x.role, '') not in ('user', 'assistant') then 'turn ' || (i - 1) || ': invalid role "' || coalesce(x.role, '') || '"'
    when {_bad('x.timestamp')} then 'turn ' || (i - 1) || ' timestamp'
    when coalesce(x.text, '') = '' and coalesce(x.reasoning, '') = '' and coalesce(len(x.tool_calls), 0) = 0 and coalesce(len(x.attachments), 0) = 0 then 'turn ' || (i - 1) || ' has no content' end), lambda e: e is not null)[1] end as err from {ONE})
 select record_id, coalesce(err, '') as error from t""")
def record_validity(s, d):
    return _records(s, d).select("record_id", F.coalesce(records.validity(), F.lit("")).alias("error"))


@query("usage_counts", f"""select record_id, len(list_filter(ts, lambda x: x.role = 'user'))::bigint as user_turns, len(list_filter(ts, lambda x: x.role = 'assistant'))::bigint as assistant_turns,
 coalesce(list_sum(list_transform(ts, lambda x: len(list_filter(coalesce(x.tool_calls, []), lambda c: c is not null)))), 0)::bigint as tool_calls
 from (select record_id, list_filter(coalesce(turns, []), lambda x: x is not null) as ts from {ONE})""")
def usage_counts(s, d):
    return records.usage_counts(_records(s, d))


for _key in ("model", "grouping", "origin"):
    SQL[f"breakdown_by_{_key}"] = f"""select coalesce({_key}, '') as {_key}, count(*) as records, coalesce(sum(usage.input_tokens), 0)::bigint as input_tokens, coalesce(sum(usage.output_tokens), 0)::bigint as output_tokens from {ONE} group by 1"""
    QUERIES[f"breakdown_by_{_key}"] = lambda s, d, k=_key: records.breakdown(_records(s, d), k)

_BODY = "list_aggregate(list_transform(list_filter(turns, lambda x: x is not null), lambda x: coalesce(x.text, '') || chr(10) || coalesce(x.reasoning, '')), 'string_agg', chr(10))"


@query("summary_totals", f"""select count(*) as records, coalesce(sum(usage.input_tokens), 0)::bigint as input_tokens, coalesce(sum(usage.output_tokens), 0)::bigint as output_tokens,
 coalesce(sum((length({_BODY}) - length(replace({_BODY}, '[EMAIL]', ''))) // 7), 0)::bigint as redactions from {ONE}""")
def summary_totals(s, d):
    return records.totals(_records(s, d), "[EMAIL]").select("records", "input_tokens", "output_tokens", F.col("redactions").cast("long").alias("redactions"))


_KEPT = "list_filter(turns, lambda x: x is not null)"
for _name, _sql in {
    "chatml": "'<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || chr(10) || '<|im_end|>'",
    "zephyr": "'<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '')",
    "flat": "'[' || coalesce(x.role, '') || '] ' || coalesce(x.text, '')",
}.items():
    SQL[f"render_{_name}"] = f"select record_id, model, coalesce(list_aggregate(list_transform({_KEPT}, lambda x: {_sql}), 'string_agg', chr(10)), '') as content from {ONE}"
    QUERIES[f"render_{_name}"] = lambda s, d, n=_name: _records(s, d).select("record_id", "model", render.SERIALIZERS[n]().alias("content"))
for _name, _sql in {
    "openai": "case when coalesce(x.reasoning, '') <> '' and x.role = 'assistant' then coalesce(x.text, '') || case when coalesce(x.text, '') <> '' then chr(10) || chr(10) else '' end || x.reasoning else coalesce(x.text, '') end",
    "anthropic": "case when coalesce(x.text, '') = '' and coalesce(len(x.attachments), 0) > 0 then '[attachments omitted]' else coalesce(x.text, '') end",
}.items():
    SQL[f"render_{_name}"] = f"""select record_id, i - 1 as position, m.role as role, m.content as content from (select record_id, unnest(list_transform({_KEPT}, lambda x: {{'role': coalesce(x.role, ''), 'content': {_sql}}})) as m,
 generate_subscripts({_KEPT}, 1) as i from {ONE})"""
    QUERIES[f"render_{_name}"] = lambda s, d, n=_name: _records(s, d).select("record_id", F.posexplode(render.SERIALIZERS[n]()).alias("position", "m")).select("record_id", F.col("position").cast("long").alias("position"), "m.role", "m.content")

# Runs of one role: gaps and islands in SQL, an expression fold in Spark.
_RUNS = f"""with t as (select record_id, unnest({_KEPT}) as x, generate_subscripts({_KEPT}, 1) as i from {ONE}),
 k as (select record_id, i, coalesce(x.role, '') as role, coalesce(x.text, '') as text from t where coalesce(x.role, '') <> 'tool'),
 f as (select *, case when lag(role) over w is not distinct from role then 0 else 1 end as new from k window w as (partition by record_id order by i)),
 g as (select *, sum(new) over (partition by record_id order by i) as run from f),
 runs as (select record_id, run, min(role) as role, coalesce(string_agg(text, chr(10) order by i) filter (where text <> ''), '') as content from g group by record_id, run)"""


@query("merged_messages", f"{_RUNS} select record_id, (run - 1)::bigint as position, role, content from runs")
def merged_messages(s, d):
    return _records(s, d).select("record_id", F.posexplode(records.merged_messages()).alias("position", "m")).select("record_id", F.col("position").cast("long").alias("position"), "m.role", "m.content")


@query("template_chatml", f"{_RUNS} select r.record_id, coalesce(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' order by run), '') as content from {ONE} r left join runs using (record_id) group by 1")
def template_chatml(s, d):
    return _records(s, d).select("record_id", render.template_chatml(records.merged_messages()).alias("content"))


@query("template_zephyr", f"""{_RUNS} select r.record_id, coalesce(string_agg('<|' || role || '|>' || chr(10) || content || '</s>' || chr(10), '' order by run) filter (where role in ('user', 'system', 'assistant')), '') as content
 from {ONE} r left join runs using (record_id) group by 1""")
def template_zephyr(s, d):
    return _records(s, d).select("record_id", render.template_zephyr(records.merged_messages()).alias("content"))


_STRIPPED = r"regexp_replace(content, '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g')"


@query("template_vicuna", f"""{_RUNS} select record_id, case when bool_and(right_) then '<s>' || coalesce(string_agg(line, '' order by run), '') end as content from (select r.record_id, run,
 coalesce((role = 'user') = (run % 2 = 1), true) as right_, case role when 'user' then 'USER: ' || {_STRIPPED} || chr(10) when 'assistant' then 'ASSISTANT: ' || {_STRIPPED} || '</s>' || chr(10) else '' end as line
 from {ONE} r left join runs using (record_id)) group by 1""")
def template_vicuna(s, d):
    return _records(s, d).select("record_id", render.template_vicuna(records.merged_messages()).alias("content"))


@query("role_adjacency", f"""select record_id, (i - 1)::bigint as turn_no, coalesce(role, '') as role, coalesce(lag(role) over w, '') as prev_role, coalesce(lead(role) over w, '') as next_role
 from (select record_id, x.role as role, i from (select record_id, unnest(turns) as x, generate_subscripts(turns, 1) as i from {ONE})) window w as (partition by record_id order by i)""")
def role_adjacency(s, d):
    return records.role_adjacency(_records(s, d))


@query("template_messages")
def template_messages(s, d):
    return records.messages(_records(s, d))


@query("infer_tools", f"""with c as (select record_id, turn_no, generate_subscripts(calls, 1) - 1 as call_no, unnest(calls) as call from (select record_id, i - 1 as turn_no, x.tool_calls as calls
   from (select record_id, unnest(turns) as x, generate_subscripts(turns, 1) as i from {ONE}) where x is not null and x.tool_calls is not null)),
 rows as (select record_id, turn_no, call_no, call.tool as tool, call.input as input from c where call is not null and coalesce(call.tool, '') <> ''),
 n as (select tool, count(*) as calls from rows group by 1),
 p as (select *, unnest(json_keys(input)) as param from rows where ltrim(input)[1] = '{{' and json_valid(input)),
 q as (select tool, param, count(distinct (record_id, turn_no, call_no)) as seen, min_by(case json_type(input, '$."' || param || '"') when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string'
   when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end, (record_id, turn_no, call_no)) as type from p group by 1, 2)
 select n.tool, q.param, q.type, coalesce(q.seen = n.calls, false) as required, n.calls from n left join q using (tool)""")
def infer_tools(s, d):
    return records.infer_tools(_records(s, d))


@query("catalog_overlay", f"""with n as (select call.tool as tool from (select unnest(x.tool_calls) as call from (select unnest(turns) as x from {ONE})) where coalesce(call.tool, '') <> '' group by 1)
 select tool, case tool when 'bash' then 'Runs a command' when 'read_file' then 'Reads a file again' else '' end as description from n""")
def catalog_overlay(s, d):
    tools = records.infer_tools(_records(s, d)).groupBy("tool").agg(F.to_json(F.array_sort(F.array_compact(F.collect_list("param")))).alias("parameters"))
    catalog = s.createDataFrame([("bash", "Runs a command", None, 1), ("read_file", "Reads a file", None, 2), ("read_file", "Reads a file again", None, 3), ("never_called", "Not in the data", None, 4)], "name string, description string, parameters string, position int")
    return records.overlay_catalog(tools, catalog).select("tool", "description")


# Detectors over document texts; RE2 runs the same patterns in DuckDB.
def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


SQL["detector_counts"] = "select doc_id, " + ", ".join(f"len(regexp_extract_all(text, {_lit(p)}, {g}))::bigint as {n}" for n, p, g in secretscan.PATTERNS) + " from documents where text is not null"
_re2 = "text"
for _n, _p, _g in secretscan.PATTERNS:
    _re2 = f"regexp_replace({_re2}, {_lit(_p)}, {_lit((chr(92) + '1' if _g else '') + MARK)}, 'g')"
SQL["redact_text"] = f"select doc_id, md5({_re2}) as digest from documents where text is not null"
SQL["marker_count"] = f"select source, sum((length(t) - length(replace(t, '{MARK}', ''))) // {len(MARK)})::bigint as markers from (select coalesce(source, '') as source, {_re2} as t from documents where text is not null) group by 1"


@query("detector_counts", SQL["detector_counts"])
def detector_counts(s, d):
    v = F.col("text")
    return table(s, d, "documents").where("text is not null").select("doc_id", *[F.size(secretscan.found(v, p, g)).cast("long").alias(n) for n, p, g in secretscan.PATTERNS])


@query("redact_text", SQL["redact_text"])
def redact_text(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(secretscan.redact(F.col("text"))).alias("digest"))


@query("marker_count", SQL["marker_count"])
def marker_count(s, d):
    hits = F.regexp_count(secretscan.redact(F.col("text")), F.lit(r"\Q" + MARK + r"\E")).cast("long")
    return table(s, d, "documents").where("text is not null").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(hits).alias("markers"))


_EMAILS = f"""list_filter(regexp_extract_all(text, {_lit(secretscan.EMAIL)}), lambda e: not (regexp_extract(lower(e), '@([^@]*)$', 1) in ('localhost', 'example.com', 'example.org', 'example.net')
 or regexp_matches(regexp_extract(lower(e), '@([^@]*)$', 1), '\\.(localhost|example|test|invalid)$')))"""
_IPS = f"""list_filter(regexp_extract_all(text, {_lit(secretscan.IPV4)}), lambda v: not (len(list_filter(string_split(v, '.'), lambda o: o::int > 255 or (length(o) > 1 and o[1] = '0'))) > 0
 or split_part(v, '.', 1)::int in (10, 127) or (split_part(v, '.', 1)::int = 172 and split_part(v, '.', 2)::int between 16 and 31) or (split_part(v, '.', 1)::int = 192 and split_part(v, '.', 2)::int = 168)
 or v in ('1.1.1.1', '1.0.0.1', '8.8.8.8', '8.8.4.4', '9.9.9.9')))"""


@query("email_findings", f"select doc_id, i - 1 as position, e as value from (select doc_id, unnest({_EMAILS}) as e, generate_subscripts({_EMAILS}, 1) as i from documents where text is not null)")
def email_findings(s, d):
    return attest.line_findings(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.posexplode("email").alias("position", "value")).withColumn("position", F.col("position").cast("long"))


@query("public_ip_findings", f"select doc_id, i - 1 as position, e as value from (select doc_id, unnest({_IPS}) as e, generate_subscripts({_IPS}, 1) as i from documents where text is not null)")
def public_ip_findings(s, d):
    return attest.line_findings(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.posexplode("public_ip").alias("position", "value")).withColumn("position", F.col("position").cast("long"))


_ENT = """round(-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, ''))) / length(v)::double * log2((length(v) - length(replace(v, c, ''))) / length(v)::double))), 9)"""


@query("entropy_findings", f"""select doc_id, v as value, round({_ENT}, 6) as bits from (select doc_id, unnest(list_transform(regexp_extract_all(text, {_lit(secretscan.QUOTED)}), lambda q: q[2:-2])) as v from documents where text is not null)
 where regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]') and {_ENT} >= 4.0""")
def entropy_findings(s, d):
    v = F.col("value")
    return attest.line_findings(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.explode("high_entropy").alias("value")).select("doc_id", "value", F.round(scalar.entropy(v), 6).alias("bits"))


@query("findings_totals")
def findings_totals(s, d):
    return attest.counts(table(s, d, "documents"), "doc_id", "text")


@query("findings_topk", f"""select value, doc_id, i - 1 as position from (select doc_id, unnest({_EMAILS}) as value, generate_subscripts({_EMAILS}, 1) as i from documents where text is not null) order by doc_id, i limit 20""")
def findings_topk(s, d):
    return attest.samples(table(s, d, "documents"), "doc_id", "text", "email")


@query("name_scan", "select count(*) filter (where contains(lower(text), 'orrin')) as lines_with_name from documents")
def name_scan(s, d):
    return attest.name_scan(table(s, d, "documents"), "text", "Orrin")


@query("large_binary", r"""select doc_id, coalesce(octet_length(encode(text)) >= 4096 and ((starts_with(text, 'data:') and contains(text, ';base64,')) or regexp_matches(text, '\A[A-Za-z0-9+/=\n\r]*\z')), false) as is_large_binary from documents""")
def large_binary(s, d):
    return table(s, d, "documents").select("doc_id", scalar.large_binary(F.col("text")).alias("is_large_binary"))


@query("redact_full")
def redact_full(s, d):
    return redaction.redact_column(table(s, d, "documents"), "doc_id", "text", redaction.Rules(handles=("orrinf", "thornstrom"), home="/home/orrinf"))


@query("redact_records")
def redact_records(s, d):
    return redaction.redact_records(_records(s, d), redaction.Rules(home="/Users/allervale")).select("record_id", "turns", "redactions")


@query("redact_json_lines")
def redact_json_lines(s, d):
    lines = table(s, d, "raw_lines").where("raw is not null").select(F.concat_ws(":", "file_id", "line_no").alias("line"), "raw").dropDuplicates(["line"])
    return redaction.redact_json(lines, "line", "raw", redaction.Rules())


@query("anon_token", "select account_id, 'anon_' || substr(sha256(lower(trim(handle))), 1, 10) as token from accounts where handle is not null")
def anon_token(s, d):
    return table(s, d, "accounts").where("handle is not null").select("account_id", scalar.anon_token(F.col("handle")).alias("token"))


@query("handle_anonymize", r"""select doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(^|[^A-Za-z0-9_])(session)([^A-Za-z0-9_]|$)', '\1anon_' || substr(sha256('session'), 1, 10) || '\3', 'g'), '(?i)(^|[^A-Za-z0-9_])(orrin)([^A-Za-z0-9_]|$)', '\1anon_' || substr(sha256('orrin'), 1, 10) || '\3', 'g')) as digest
 from documents where text is not null""")
def handle_anonymize(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(secretscan.anonymize(F.col("text"), ["session", "orrin"])).alias("digest"))


@query("secret_mask", """select doc_id, case when length(v) < 4 then '[redacted]' when length(v) <= 8 then v[1] || repeat('*', length(v) - 2) || v[-1] else left(v, 4) || repeat('*', length(v) - 8) || right(v, 4) end as masked
 from (select doc_id, coalesce(commit_id, source, '') as v from documents)""")
def secret_mask(s, d):
    return table(s, d, "documents").select("doc_id", scalar.mask_secret(F.coalesce("commit_id", "source", F.lit(""))).alias("masked"))


_TS = r"""case when regexp_matches(v, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$') then epoch(try_cast(substr(v, 1, 10) || ' ' || substr(v, 12, 8) as timestamp))::bigint
   - case when right(v, 1) = 'Z' then 0 else (case when substr(right(v, 6), 1, 1) = '-' then -1 else 1 end) * (substr(right(v, 6), 2, 2)::int * 60 + right(v, 2)::int) * 60 end
 when regexp_matches(v, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}([.,]\d+)?$') then epoch(try_cast(substr(v, 1, 19) as timestamp))::bigint
 when regexp_matches(v, '^[+-]?\d{1,18}$') then floor(v::bigint / 1000.0)::bigint end"""
_ROWS = "(select row_id, any_value(timestamp) as v, any_value(session_id) as session_id from codex_session group by row_id)"
_FMT = "coalesce(strftime(make_timestamp(({0}) * 1000000), '%Y-%m-%dT%H:%M:%SZ'), '')"


def _times(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "codex_session").groupBy("row_id").agg(F.first("timestamp").alias("v"), F.first("session_id").alias("session_id"))


@query("ts_normalize", f"select row_id, {_FMT.format('t')} as utc from (select row_id, {_TS} as t from {_ROWS}) where t is null or t between 0 and 4000000000")
def ts_normalize(s, d):
    t = scalar.timestamp_seconds(F.col("v"))
    return _times(s, d).withColumn("t", t).where("t is null or t between 0 and 4000000000").select("row_id", F.coalesce(canonical(F.col("t")), F.lit("")).alias("utc"))


@query("ts_bounds", f"select session_id, {_FMT.format('min(t)')} as started_at, {_FMT.format('max(t)')} as ended_at from (select session_id, {_TS} as t from {_ROWS}) where session_id is not null and (t is null or t between 0 and 4000000000) group by 1")
def ts_bounds(s, d):
    rows = _times(s, d).withColumn("t", scalar.timestamp_seconds(F.col("v"))).where("session_id is not null and (t is null or t between 0 and 4000000000)")
    at = lambda c: F.coalesce(canonical(c), F.lit(""))
    return rows.groupBy("session_id").agg(at(F.min("t")).alias("started_at"), at(F.max("t")).alias("ended_at"))


# The whole job: the two above hold only the counts that DuckDB formats alike, as their SQL does.
@query("ts_normalize_all")
def ts_normalize_all(s, d):
    return _times(s, d).select("row_id", scalar.normalize_timestamp(F.col("v")).alias("utc"))


@query("ts_bounds_all")
def ts_bounds_all(s, d):
    rows = _times(s, d).where("session_id is not null").withColumn("t", scalar.timestamp_seconds(F.col("v")))
    at = lambda c: F.coalesce(scalar.utc_text(c), F.lit(""))
    return rows.groupBy("session_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("session_id", at(F.col("a")).alias("started_at"), at(F.col("b")).alias("ended_at"))


# Tool calls of sessions with their last result.
@query("tool_call_result", """with r as (select distinct row_id, session_id, file, line_no, json_extract_string(payload, '$.type') as type, json_extract_string(payload, '$.call_id') as call_id, json_extract_string(payload, '$.output') as output
   from codex_session where type = 'response_item' and session_id is not null and json_valid(payload)),
 o as (select session_id, file, call_id, arg_max(output, (line_no, row_id)) as output from r where type in ('function_call_output', 'custom_tool_call_output') and call_id is not null group by 1, 2, 3)
 select r.row_id, r.call_id, o.output is not null as answered, case when o.output is null then '' when contains(lower(o.output), 'error') then 'error' else 'success' end as status
 from r left join o using (session_id, file, call_id) where r.type in ('function_call', 'custom_tool_call')""")
def tool_call_result(s, d):
    p = F.from_json("payload", "struct<type:string,call_id:string,output:string>")
    rows = table(s, d, "codex_session").where("type = 'response_item' and session_id is not null").select("row_id", "session_id", "file", "line_no", p.alias("p")).select("row_id", "session_id", "file", "line_no", "p.*").dropDuplicates(["row_id"])
    outs = rows.where("type in ('function_call_output', 'custom_tool_call_output') and call_id is not null").groupBy("session_id", "file", "call_id").agg(F.max_by("output", F.struct("line_no", "row_id")).alias("output"))
    calls = rows.where("type in ('function_call', 'custom_tool_call')").drop("output")
    joined = calls.join(outs, ["session_id", "file", "call_id"], "left")
    status = F.when(F.col("output").isNull(), "").when(F.contains(F.lower("output"), F.lit("error")), "error").otherwise("success")
    return joined.select("row_id", "call_id", F.col("output").isNotNull().alias("answered"), status.alias("status"))


_U = "coalesce(try_cast(json_extract_string(payload, '$.info.total_token_usage.{}') as bigint), 0)"


@query("codex_usage", f"""select session_id, max({_U.format('input_tokens')} + {_U.format('cached_input_tokens')})::bigint as input_tokens, max({_U.format('output_tokens')})::bigint as output_tokens
 from (select session_id, payload from codex_session where type = 'event_msg' and session_id is not null and json_valid(payload)) where json_extract_string(payload, '$.type') = 'token_count' group by 1""")
def codex_usage(s, d):
    p = F.from_json("payload", "struct<type:string,info:struct<total_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>>>")
    rows = table(s, d, "codex_session").where("type = 'event_msg' and session_id is not null").select("session_id", p.alias("p")).where("p.type = 'token_count'")
    u = "p.info.total_token_usage"
    n = lambda c: F.coalesce(F.col(f"{u}.{c}"), F.lit(0))
    return rows.groupBy("session_id").agg(F.max(n("input_tokens") + n("cached_input_tokens")).alias("input_tokens"), F.max(n("output_tokens")).alias("output_tokens"))


@query("exclusion_anti", f"select record_id from {ONE} where grouping is null or grouping not in (select grouping from records where grouping is not null group by 1 having count(*) < 5)")
def exclusion_anti(s, d):
    r = table(s, d, "records")
    excluded = r.where("grouping is not null").groupBy("grouping").agg(F.count(F.lit(1)).alias("n")).where("n < 5").select("grouping")
    return _records(s, d).join(excluded, "grouping", "left_anti").select("record_id")


@query("grouping_discovery", f"""select coalesce(nullif(grouping, ''), origin || ':unknown') as id, count(*) as records, sum(coalesce(octet_length(encode(extensions)), 0) + coalesce(octet_length(encode(title)), 0))::bigint as bytes from {ONE} group by 1""")
def grouping_discovery(s, d):
    size = F.coalesce(F.octet_length("extensions"), F.lit(0)) + F.coalesce(F.octet_length("title"), F.lit(0))
    key = F.coalesce(F.nullif("grouping", F.lit("")), F.concat("origin", F.lit(":unknown")))
    return _records(s, d).groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("records"), F.sum(size).cast("long").alias("bytes"))


@query("byte_estimate", "select coalesce(source, '') as source, (123456789 // sum(count(*)) over () * count(*))::bigint as bytes from documents group by 1")
def byte_estimate(s, d):
    groups = table(s, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return groups.select("source", F.expr("123456789 div sum(n) over (partition by 1) * n").cast("long").alias("bytes"))


@query("repository_sessions", "select r_name as repository, n_name as workspace, count(*) as sessions from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1, 2")
def repository_sessions(s, d):
    region, nation, customer = (table(s, d, n) for n in ("region", "nation", "customer"))
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.groupBy(F.col("r_name").alias("repository"), F.col("n_name").alias("workspace")).agg(F.count(F.lit(1)).alias("sessions"))


_ENTRIES = "(select distinct on (entry_id) * from manifest_entries)"


def _entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "manifest_entries").dropDuplicates(["entry_id"])


@query("redaction_key_mix", rf"""select coalesce(redaction_key, '') as redaction_key, case when regexp_matches(redaction_key, '^v1:[^:]+:sha256:.*:keep-images$') then 'keep' when regexp_matches(redaction_key, '^v1:[^:]+:sha256:.*:strip-images$') then 'strip' else 'unknown' end as images, count(*) as sessions
 from {_ENTRIES} group by 1, 2""")
def redaction_key_mix(s, d):
    return manifest.key_mix(_entries(s, d))


@query("sessions_by_format", f"select format, count(*) as sessions, coalesce(sum(lines), 0)::bigint as lines from {_ENTRIES} group by 1")
def sessions_by_format(s, d):
    return manifest.by_format(_entries(s, d))


@query("manifest_preflight", rf"select count(distinct redaction_key) as keys, count(*) filter (where not coalesce(regexp_matches(redaction_key, '^v1:[^:]+:sha256:.*:(keep|strip)-images$'), false)) as malformed, count(distinct redaction_key) = 1 and count(*) filter (where not coalesce(regexp_matches(redaction_key, '^v1:[^:]+:sha256:.*:(keep|strip)-images$'), false)) = 0 as ok from {_ENTRIES}")
def manifest_preflight(s, d):
    return manifest.preflight(_entries(s, d))


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Local: the last entry of each session; remote: its first. Both with unique sessions and files."""
    e = _entries(s, d).where("coalesce(session_id, '') != ''").withColumn("file", F.concat("file", F.lit("#"), "entry_id"))
    pick = lambda f: e.groupBy("session_id").agg(f(F.struct("entry_id", *[c for c in e.columns if c not in ("entry_id", "session_id")])).alias("x")).select("session_id", "x.*")
    return pick(F.max), pick(F.min).where("entry_id % 3 != 0")


_SIDES = f"""with e as (select * replace (file || '#' || entry_id as file) from {_ENTRIES} where coalesce(session_id, '') <> ''),
 l as (select e.* from e join (select session_id, max(entry_id) as m from e group by 1) x on e.session_id = x.session_id and e.entry_id = x.m),
 r as (select e.* from e join (select session_id, min(entry_id) as m from e group by 1) x on e.session_id = x.session_id and e.entry_id = x.m where e.entry_id % 3 <> 0),
 lk as (select *, coalesce(source_hash, '') || '|' || coalesce(redaction_key, '') || '|' || coalesce(redacted_hash, '') as c, format || '|' || session_id as k from l),
 rk as (select *, coalesce(source_hash, '') || '|' || coalesce(redaction_key, '') || '|' || coalesce(redacted_hash, '') as c, format || '|' || session_id as k from r)"""


@query("manifest_diff", f"""{_SIDES}, j as (select lk.file, lk.c, s.file as s_file, s.c as s_c, f.c as f_c, t.file as c_file from lk left join rk s on s.k = lk.k left join rk f on f.file = lk.file left join (select c, max(file) as file from rk where c <> '||' group by 1) t on t.c = lk.c),
 q as (select *, case when s_file is not null then 1 when f_c = c then 2 when c_file is not null and c_file <> file then 3 else 4 end as rule from j)
 select file, case rule when 1 then s_file when 3 then c_file else file end as aligned_file, case when rule = 4 or (rule = 1 and s_c <> c) then 'upload' else 'keep' end as action, rule::bigint as rule from q""")
def manifest_diff(s, d):
    local, remote = _sides(s, d)
    return manifest.diff_unique(local, remote).withColumn("rule", F.col("rule").cast("long"))


@query("manifest_merge", f"{_SIDES} select file, entry_id from l union all select file, entry_id from r where file not in (select file from l)")
def manifest_merge(s, d):
    return manifest.merge(*_sides(s, d)).select("file", "entry_id")


def _all_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Local: the entries of the last batch; remote: all before it. On each side a session's last entry stands for it, and entries without session for themselves.

    A file named again on one side gets its entry_id, but for the last, so files are unique too.
    """
    e = _entries(s, d).withColumn("batch_no", F.coalesce("batch_no", F.lit(-1)))
    e = e.join(F.broadcast(e.agg(F.max("batch_no").alias("newest")))).withColumn("is_local", F.col("batch_no") == F.col("newest"))
    key = F.when(F.coalesce("session_id", F.lit("")) != "", F.struct(F.coalesce("format", F.lit("")).alias("format"), "session_id", F.lit(-1).cast("long").alias("entry_id"))).otherwise(F.struct(F.lit("").alias("format"), F.lit("").alias("session_id"), "entry_id"))
    names = [c for c in e.columns if c not in ("batch_no", "entry_id", "newest", "is_local")]
    last = e.groupBy("is_local", key.alias("key")).agg(F.max_by(F.struct("entry_id", *names), F.struct("batch_no", "entry_id")).alias("x")).select("is_local", "x.*")
    holder = last.where("file is not null").groupBy("is_local", "file").agg(F.max("entry_id").alias("holder"))
    last = last.join(holder, ["is_local", "file"], "left").withColumn("file", F.when(F.col("entry_id") == F.col("holder"), F.col("file")).otherwise(F.concat("file", F.lit("#"), "entry_id"))).drop("holder")
    return last.where("is_local").drop("is_local"), last.where("not is_local").drop("is_local")


# The whole job: the two above hold two thirds of the remote sessions, as their SQL does.
@query("manifest_diff_all")
def manifest_diff_all(s, d):
    local, remote = _all_sides(s, d)
    return manifest.diff_unique(local, remote).withColumn("rule", F.col("rule").cast("long"))


@query("manifest_merge_all")
def manifest_merge_all(s, d):
    return manifest.merge(*_all_sides(s, d)).select("file", "entry_id")


@query("display_label", f"""select record_id, case when len(p) > 0 then array_to_string(p, '/') when len(q) > 0 then q[-1] when starts_with(w, '/') then '/' else '.' end as label from (select record_id, w, list_filter(q0, lambda x: x not in ('', '.', 'Documents', 'Downloads', 'Desktop')) as p, list_filter(q0, lambda x: x <> '') as q
 from (select record_id, w, string_split(regexp_replace(w, '/+', '/', 'g'), '/') as q0 from (select record_id, coalesce(working_dir, '') as w from {ONE})))""")
def display_label(s, d):
    return _records(s, d).select("record_id", scalar.display_label(F.coalesce("working_dir", F.lit(""))).alias("label"))


@query("repository_name", r"select doc_id, string_split_regex(regexp_replace(regexp_replace(trim(repo), '/+$', ''), '\.git$', ''), '[/:]')[-1] as name from documents where repo is not null")
def repository_name(s, d):
    return table(s, d, "documents").where("repo is not null").select("doc_id", scalar.repository_name(F.col("repo")).alias("name"))


@query("attachment_types", f"""select record_id, media_type, case when starts_with(lower(trim(split_part(media_type, ';', 1))), 'image/') then 'image' else 'document' end as kind from (select distinct record_id, a.media_type as media_type
 from (select record_id, unnest(x.attachments) as a from (select record_id, unnest(turns) as x from {ONE}) where x is not null) where a is not null and a.media_type is not null)""")
def attachment_types(s, d):
    rows = _records(s, d).select("record_id", F.explode("turns").alias("x")).select("record_id", F.explode("x.attachments").alias("a")).where("a.media_type is not null").select("record_id", "a.media_type").distinct()
    return rows.select("record_id", "media_type", scalar.attachment_type(F.col("media_type")).alias("kind"))


@query("json_types", """select file_id, line_no, case json_type(raw) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as type
 from (select distinct file_id, line_no, raw from raw_lines where raw is not null and json_valid(raw))""")
def json_types(s, d):
    lines = table(s, d, "raw_lines").select("file_id", "line_no", "raw").distinct()
    return lines.select("file_id", "line_no", scalar.json_type(F.col("raw")).alias("type")).where("type is not null")


@query("first_non_empty", "select doc_id, case when trim(coalesce(lang, '')) <> '' then lang when trim(coalesce(repo, '')) <> '' then repo when trim(coalesce(source, '')) <> '' then source else '' end as value from documents")
def first_non_empty(s, d):
    return table(s, d, "documents").select("doc_id", scalar.first_non_empty(F.col("lang"), F.col("repo"), F.col("source")).alias("value"))


@query("suppress_reasoning", f"select record_id, coalesce(len(turns), 0)::bigint as turns, 0::bigint as with_reasoning from {ONE}")
def suppress_reasoning(s, d):
    blank = F.transform("turns", lambda x: x.withField("reasoning", F.lit("")))
    rows = _records(s, d).withColumn("turns", blank)
    left = F.size(F.filter(F.coalesce("turns", F.array().cast("array<void>")), lambda x: x["reasoning"] != ""))
    return rows.select("record_id", F.greatest(F.size(F.coalesce("turns", F.array().cast("array<void>"))), F.lit(0)).cast("long").alias("turns"), left.cast("long").alias("with_reasoning"))


@query("point_lookup", f"select record_id, origin, model from {ONE} where record_id = (select min(record_id) from records)")
def point_lookup(s, d):
    least = table(s, d, "records").agg(F.min("record_id")).first()[0]
    return records.first_wins(table(s, d, "records").where(F.col("record_id") == F.lit(least))).select("record_id", "origin", "model")


# The session folds over the line tables, a file being what one session wrote to one file.
@query("codex_records")
def codex_records(s, d):
    rows = table(s, d, "codex_session").where("session_id is not null").dropDuplicates(["row_id"])
    raw = F.concat(F.lit('{"type":'), _quoted("type"), F.lit(',"timestamp":'), F.coalesce(_quoted("timestamp"), F.lit("null")), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    lines = rows.select(F.concat_ws("/", "session_id", "file").alias("path"), F.struct("line_no", "row_id").alias("ord"), raw.alias("raw"), F.col("session_id").alias("record_id"))
    return codex.assemble(lines.select("path", F.col("ord.line_no").alias("ord"), "raw", "record_id"))


def _quoted(c: str):  # noqa: ANN202
    return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1) if c == "type" else F.when(F.col(c).isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1))


@query("claudecode_records")
def claudecode_records(s, d):
    rows = table(s, d, "raw_lines").where("store = 'claudecode'").dropDuplicates(["file_id", "line_no"])
    return claudecode.assemble(rows.select(F.col("file_id").cast("string").alias("path"), F.col("line_no").alias("ord"), "raw", F.col("file").alias("record_id"), F.lit("claudecode").alias("grouping")).where("raw is not null"))


@query("amp_records")
def amp_records(s, d):
    rows = table(s, d, "raw_lines").where("store = 'amp'").dropDuplicates(["file_id", "line_no"])
    return traces.amp_traces(rows.select(F.col("file_id").cast("string").alias("path"), F.lit("default").alias("grouping"), "raw").where("raw is not null"))


@query("canonical_lines", f"select count(*) as lines, count(*) as with_id from {ONE}")
def canonical_lines(s, d):
    lines = sinks.json_lines(_records(s, d))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.get_json_object("value", "$.record_id").isNotNull()).alias("with_id"))


#: A small function-calling layout, as a template file would hold it.
CALLING_TEMPLATE = """{{- bos_token }}{% for m in messages %}{% if m.tool_calls is defined %}<|{{ m.role }}|>
{{ m.content }}{% for c in m.tool_calls %}
<call>{{ c.name }} {{ c.arguments|tojson }}</call>{% endfor %}{{ eos_token }}
{% else %}<|{{ m.role }}|>
{{ m.content|trim }}{{ eos_token }}
{% endif %}{% endfor %}"""


@query("template_file")
def template_file(s, d):
    return templates.render_records(_records(s, d), CALLING_TEMPLATE, eos_token="</s>")


@query("inspect_groupings", f"""select coalesce(grouping, '') as label, count(*) as records, coalesce(grouping, '') in (select grouping from records where grouping is not null group by 1 having count(*) < 5) as excluded from {ONE} group by 1 order by 1""")
def inspect_groupings(s, d):
    r = table(s, d, "records")
    excluded = r.where("grouping is not null").groupBy("grouping").agg(F.count(F.lit(1)).alias("n")).where("n < 5").select(F.col("grouping").alias("label"), F.lit(True).alias("hit"))
    groups = _records(s, d).groupBy(F.coalesce("grouping", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("records"))
    return groups.join(excluded, "label", "left").select("label", "records", F.col("hit").isNotNull().alias("excluded")).orderBy("label")


_CALLS = f"""(select record_id, turn_no, generate_subscripts(calls, 1) - 1 as call_no, unnest(calls) as call from (select record_id, i - 1 as turn_no, x.tool_calls as calls
 from (select record_id, unnest(turns) as x, generate_subscripts(turns, 1) as i from {ONE}) where x is not null and x.tool_calls is not null))"""
_JOINED = "coalesce(array_to_string(list_filter(list_transform(coalesce(call.output.content, []), lambda b: coalesce(b.text, '')), lambda t: t <> ''), chr(10)), '')"


@query("tool_output_text", f"""select record_id, 'call_' || turn_no || '_' || call_no || '_' || coalesce(call.tool, '') as call_id, case when coalesce(call.output.text, '') <> '' then call.output.text when {_JOINED} <> '' then {_JOINED}
 when ltrim(call.output.raw)[1] = '"' then json_extract_string(call.output.raw, '$') else coalesce(call.output.raw, '') end as text from {_CALLS} where call is not null and call.output is not null""")
def tool_output_text(s, d):
    calls = records.calls(_records(s, d)).where("call.output is not null")
    return calls.select("record_id", scalar.call_id(F.col("turn_no"), F.col("call_no"), F.col("call.tool")).alias("call_id"), scalar.output_text(F.col("call.output")).alias("text"))


_SCANNED = f"""(select record_id, coalesce(grouping, '') || chr(10) || coalesce(working_dir, '') || chr(10) || coalesce({_BODY}, '') as text from {ONE})"""


@query("scan_record", f"""select record_id, len({_EMAILS})::bigint as emails, len(list_distinct(flatten([{', '.join(f"regexp_extract_all(text, {_lit(p)}, {g})" for _, p, g in secretscan.PATTERNS)}])))::bigint as tokens from {_SCANNED}""")
def scan_record(s, d):
    body = F.array_join(F.transform(F.filter("turns", lambda x: x.isNotNull()), lambda x: F.concat(scalar.text(x["text"]), F.lit("\n"), scalar.text(x["reasoning"]))), "\n")
    full = _records(s, d).select("record_id", F.concat(scalar.text(F.col("grouping")), F.lit("\n"), scalar.text(F.col("working_dir")), F.lit("\n"), F.coalesce(body, F.lit(""))).alias("text"))
    return full.select("record_id", F.size(secretscan.emails(F.col("text"))).cast("long").alias("emails"), F.size(secretscan.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("finding_summary")
def finding_summary(s, d):
    n = attest.counts(table(s, d, "documents"), "doc_id", "text")
    line = F.format_string("%d emails, %d public IPs, %d token-like matches, %d entropy matches", *[F.col(c) for c in ("emails", "public_ips", "tokens", "high_entropys")])
    return n.select(F.when(F.col("emails") + F.col("public_ips") + F.col("tokens") + F.col("high_entropys") == 0, "no findings").otherwise(line).alias("summary"))
