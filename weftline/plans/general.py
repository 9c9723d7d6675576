"""Queries of the general training-data operators (P3, P6, P7)."""

from __future__ import annotations

from ..operators import drift, nested, timestamps
from ..session import table

QUERIES = {
    "p3_found": lambda s, d: timestamps.times_found(table(s, d, "records"), table(s, d, "codex_session")),
    "p3_normalised": lambda s, d: timestamps.times_normalised(table(s, d, "records"), table(s, d, "codex_session")),
    "p3_settled": lambda s, d: timestamps.times_settled(table(s, d, "records"), table(s, d, "codex_session")),
    "p6_found": lambda s, d: nested.items_found(table(s, d, "records")),
    "p6_turns": lambda s, d: nested.turns_table(table(s, d, "records")),
    "p6_tool_calls": lambda s, d: nested.calls_table(table(s, d, "records")),
    "p6_blocks": lambda s, d: nested.blocks_table(table(s, d, "records")),
    "p6_variants": lambda s, d: nested.variant_counts(table(s, d, "records")),
    "p7_found": lambda s, d: drift.changes(table(s, d, "raw_lines"), table(s, d, "store_fields")),
    "p7_types": lambda s, d: drift.promoted_types(table(s, d, "raw_lines"), table(s, d, "store_fields")),
    "p7_log": lambda s, d: drift.change_log(table(s, d, "raw_lines"), table(s, d, "store_fields")),
    "p7_lines": lambda s, d: drift.consistent(table(s, d, "raw_lines")),
}

_TURNS = "(select record_id, i - 1 as turn_no, x from (select record_id, unnest(turns) as x, generate_subscripts(turns, 1) as i from records) where x is not null)"
_CALLS = f"(select record_id, turn_no, i - 1 as call_no, c from (select record_id, turn_no, unnest(x.tool_calls) as c, generate_subscripts(x.tool_calls, 1) as i from {_TURNS}) where c is not null)"
SQL: dict[str, str] = {
    "p6_found": f"""select distinct record_id, turn_no::bigint as turn_no, 'tool_call' as item, -1::bigint as call_no, call_no::bigint as item_no from {_CALLS}
 union select record_id, turn_no, 'output_block', call_no, i - 1 from (select record_id, turn_no, call_no, unnest(c.output.content) as b, generate_subscripts(c.output.content, 1) as i from {_CALLS}) where b is not null
 union select record_id, turn_no, 'attachment', -1, i - 1 from (select record_id, turn_no, unnest(x.attachments) as b, generate_subscripts(x.attachments, 1) as i from {_TURNS}) where b is not null""",
    "p6_turns": f"""select distinct record_id, turn_no::bigint as turn_no, x.role as role, x.timestamp as timestamp, x.text as text, x.reasoning as reasoning, x.extensions as extensions,
 coalesce(len(list_filter(x.tool_calls, lambda c: c is not null)), -1)::bigint as n_calls, coalesce(len(list_filter(x.attachments, lambda c: c is not null)), -1)::bigint as n_attachments from {_TURNS}""",
}

_BLOCK = "coalesce(nullif(concat(" + ", ".join(f"case when b.{f} is not null then '{c}' else '' end" for f, c in zip(nested.BLOCK_FIELDS, "txmdun")) + "), ''), '0')"
_BLOCKS = f"""(select distinct record_id, turn_no::bigint as turn_no, item, call_no::bigint as call_no, item_no::bigint as item_no, {_BLOCK} as variant, {", ".join(f"b.{f} as {f}" for f in nested.BLOCK_FIELDS)} from (
 select record_id, turn_no, 'output_block' as item, call_no, unnest(c.output.content) as b, generate_subscripts(c.output.content, 1) - 1 as item_no from {_CALLS}
 union all select record_id, turn_no, 'attachment', -1, unnest(x.attachments), generate_subscripts(x.attachments, 1) - 1 from {_TURNS}) where b is not null)"""
_INSIDE = "list_filter(c.output.content, lambda b: b is not null)"
_TEXTS, _MEDIA = (f"len(list_filter({_INSIDE}, lambda b: {t})) > 0" for t in ("b.text is not null", "b.data is not null or b.url is not null"))
_OUTPUT = f"""case when c.output is null then '-' else concat(case when c.output.text is not null then 't' else '' end, case when c.output.content is null then '' when {_TEXTS} and {_MEDIA} then 'c[b]' when {_TEXTS} then 'c[t]'
 when {_MEDIA} then 'c[m]' else 'c[]' end, case when c.output.raw is not null then 'r' else '' end) end"""
_VARIANT = f"""concat(case when c.tool is not null then 'n' else '' end, 'i', case when c.input is null then '0' when left(ltrim(c.input), 1) = '{{' then 'o' when left(ltrim(c.input), 1) = '[' then 'a' when left(ltrim(c.input), 1) = '"' then 's' else 'p' end,
 '(', {_OUTPUT}, ')', case when c.status is not null then 's' else '' end)"""
SQL["p6_blocks"] = f"select * from {_BLOCKS}"
SQL["p6_tool_calls"] = f"""select distinct record_id, turn_no::bigint as turn_no, call_no::bigint as call_no, {_VARIANT} as variant, c.tool as tool, c.input as input, c.status as status, c.output is not null as has_output,
 c.output.text as output_text, c.output.raw as output_raw from {_CALLS}"""
SQL["p6_variants"] = f"""select item, variant, count(*)::bigint as n from (select distinct record_id, turn_no, item, call_no, item_no, variant from {_BLOCKS}
 union all select distinct record_id, turn_no, 'tool_call', -1, call_no, {_VARIANT} from {_CALLS}) group by 1, 2"""

_PATH = "replace(regexp_replace(substr(t.fullkey, 3), '[[][0-9]+[]]', '[]', 'g'), '\"', '')"
_KIND = "case t.type when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'BOOLEAN' then 'boolean' else 'number' end"
SQL["p7_types"] = f"""with f as (select r.file_id, r.store, {_PATH} as field_path, {_KIND} as kind from raw_lines r, json_tree(r.raw) t where json_valid(r.raw) and left(ltrim(r.raw), 1) = '{{' and t.type <> 'NULL' and t.fullkey <> '$')
 select store, field_path, case when count(distinct kind) = 1 then min(kind) when count(*) filter (where kind in ('object', 'array')) = 0 then 'string' else 'json' end as cast_to, count(distinct file_id)::bigint as files from f group by 1, 2"""
