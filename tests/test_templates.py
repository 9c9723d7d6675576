import json

import pytest

from weftline.plans.templates import Template, TemplateError, render_records, template_messages


@pytest.mark.parametrize("text,context,want", [
    ("a {{ x }} b", {"x": 1}, "a 1 b"), ("a {{- x -}} b", {"x": 1}, "a1b"), ("{# c #}x\n", {}, "x"), ("{{ missing }}|{{ m.a.b }}", {"m": {}}, "|"), ("{{ '{\"a\": {\"b\": 1}}' }}{% if '%}' in x %}y{% endif %}", {"x": "a %} b"}, '{"a": {"b": 1}}y'),
    ("{% if a and not b %}y{% elif b %}z{% else %}n{% endif %}", {"a": 1, "b": 0}, "y"), ("{% for k, v in d|items %}{{ k }}={{ v }}{% if not loop.last %},{% endif %}{% endfor %}", {"d": {"a": 1, "b": 2}}, "a=1,b=2"),
    ("{% set ns = namespace(n=0) %}{% for i in range(4) %}{% set ns.n = ns.n + i %}{% endfor %}{{ ns.n }}", {}, "6"), ("{% set x = 1 %}{% for i in [1] %}{% set x = 2 %}{% endfor %}{{ x }}", {}, "1"),
    ("{% macro f(t, s='!') %}<{{ t }}{{ s }}>{% endmacro %}{{ f('a') + f('b', s='?') }}", {}, "<a!><b?>"), ("{{ 'a' 'b' ~ 3 }}{{ m[1:]|length }}{{ m[0]['k'] }}{{ m[-1].k }}", {"m": [{"k": "x"}, {"k": "y"}]}, "ab31xy"),
    ("{{ v|tojson }} {{ v|tojson(indent=2) }}", {"v": {"b": [1], "a": "é"}}, '{"a":"é","b":[1]} {\n  "a": "é",\n  "b": [\n    1\n  ]\n}'), ("{{ x is defined }}{{ y is not defined }}{{ z is none }}{{ q is iterable }}", {"x": 1, "z": None, "q": []}, "TrueTrueTrueTrue"),
    ("{{ 'a</t>b</t>c'.split('</t>')[-1] }}{{ 'yes' if 'b' in 'abc' else 'no' }}", {}, "cyes"), ("{% for m in ms if m.r == 'u' %}{{ loop.index }}{{ m.c|trim }}{% else %}none{% endfor %}", {"ms": [{"r": "u", "c": " q "}, {"r": "a"}]}, "1q"),
])
def test_language(text, context, want):
    assert Template(text).render(**context) == want


@pytest.mark.parametrize("text", ["{% if x %}", "{{ x | nope }}", "{% endif %}", "{% nope %}", "{{ ( }}", "{{ raise_exception('no') }}"])
def test_errors(text):
    with pytest.raises(TemplateError):
        Template(text).render(x=1)


RECORD = {"turns": [
    {"role": "user", "text": "weather?"}, None,
    {"role": "assistant", "text": "", "tool_calls": [{"tool": "get", "input": '{"city": "Paris"}', "output": {"text": "18C, sunny"}}, {"tool": "raw", "input": "[1]", "output": {"text": "", "content": None, "raw": '{"a": 1}'}}, {"tool": "none", "input": None, "output": None}]},
    {"role": "assistant", "text": "sunny"},
]}


def test_messages_have_tool_outputs_and_neighbours():
    m = template_messages(RECORD)
    assert [x["role"] for x in m] == ["user", "assistant", "tool", "tool", "assistant"] and [x["content"] for x in m[2:4]] == ["18C, sunny", '{"a":1}']
    assert [c["arguments"] for c in m[1]["tool_calls"]] == [{"city": "Paris"}, {"value": [1]}, {}] and m[1]["tool_calls"][0]["id"] == "call_2_0_get"
    assert (m[2]["prev_role"], m[2]["next_role"], m[4]["is_last"], "prev_role" in m[0], "next_role" in m[4], "tool_calls" in m[4]) == ("assistant", "tool", True, False, False, False)


CALLING = """{{- bos_token }}{% for message in messages %}
{%- if message.tool_calls is defined %}<|im_start|>{{ message.role }}{% for c in message.tool_calls %}
<tool_call>
{{ '{"name": "' + c.name + '", "arguments": ' }}{{ c.arguments|tojson }}}
</tool_call>{% endfor %}<|im_end|>
{% elif message.role == 'tool' %}{% if message.prev_role != 'tool' %}<|im_start|>tool
{% endif %}<tool_response>
{{ message.content }}
</tool_response>
{% else %}<|im_start|>{{ message.role }}
{{ message.content }}<|im_end|>
{% endif %}{% endfor %}"""


def test_function_calling_layout(spark):
    schema = "record_id string, model string, turns array<struct<role:string,text:string,reasoning:string,timestamp:string,tool_calls:array<struct<tool:string,input:string,output:struct<text:string,content:array<struct<text:string>>,raw:string>,status:string>>,attachments:array<struct<type:string>>>>"
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps({"record_id": "r", "model": "m"} | RECORD), json.dumps({"record_id": "e", "model": None, "turns": None})]))
    got = {r.record_id: r for r in render_records(df, CALLING, bos_token="<s>").collect()}
    assert '"arguments": {"city":"Paris"}' in got["r"].content and got["r"].content.count("<|im_start|>tool") == 1 and "18C, sunny" in got["r"].content and got["e"].content == "<s>"
    bad = render_records(df, "{% if messages[0].role == 'user' %}{{ raise_exception('one call only') }}{% endif %}ok").collect()
    assert {(r.record_id, r.content, r.error) for r in bad} == {("r", None, "one call only"), ("e", "ok", None)}
