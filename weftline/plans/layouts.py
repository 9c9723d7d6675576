"""The function-calling chat layouts of public model families, as functions from messages to text.

A layout gets the messages of ``templates.template_messages`` (turns and tool
outputs), the tools as {type, function} or None, the start-of-text token and
whether an assistant's turn is to be opened. What a layout prints is fixed by
the model it serves, white space included; the fixed texts stand together.
One Arrow pass renders the records.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import TemplateError, template_messages, to_json

# What the models were trained to read.
NO_TOOL_PROMPT = "You are a helpful assistant with tool calling capabilities. Only reply with a tool call if the function exists in the library provided by the user. If it doesn't exist, just reply directly in natural language. When you receive a tool call response, use the output to format an answer to the original user question."
DATE = "26 Jul 2024"
JSON_FORMAT = 'Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.\n\n'
PYTHON_FORMAT = "Respond in the format [func_name1(params_name1=params_value1, params_name2=params_value2...), func_name2(params)] Do not use variables.\n\n"
JSON_IN_USER = "Given the following functions, please respond with a JSON for a function call with its proper arguments that best answers the given prompt.\n\n"
JSON_IN_SYSTEM = "You have access to the following functions. To call a function, please respond with JSON for a function call. "
PYTHON_IN_SYSTEM = "You have access to the following functions. To call functions, please respond with a python list of the calls. "
LIBRARY = 'Tools: You have access to the following tools. You might need to use one or more function/tool calls to fulfill the task. \nIf none are needed, then proceed to the response.\n\nTool Call Syntax: You can call tools using the following syntax:\n{"name": function name, "parameters": dictionary of argument name and its value}.\nSeparate multiple function calls by "; ". Do not use variables.\nDo not include anything else when calling the tools with the syntax above.\n\nHere is a list of functions in JSON format that you can invoke.\n'
COMPOSER = (
    "You are a helpful assistant and an expert in function composition. You can answer general questions using your internal knowledge OR invoke functions when necessary. Follow these strict guidelines:\n\n"
    "1. FUNCTION CALLS:\n- ONLY use functions that are EXPLICITLY listed in the function list below\n- If NO functions are listed (empty function list []), respond ONLY with internal knowledge or \"I don't have access to [Unavailable service] information\"\n"
    "- If a function is not in the list, respond ONLY with internal knowledge or \"I don't have access to [Unavailable service] information\"\n- If ALL required parameters are present AND the query EXACTLY matches a listed function's purpose: output ONLY the function call(s)\n"
    "- Use exact format: [func_name1(param1=value1, param2=value2), func_name2(...)]\nExamples:\nCORRECT: [get_weather(location=\"Vancouver\"), calculate_route(start=\"Boston\", end=\"New York\")] <- Only if get_weather and calculate_route are in function list\n"
    "INCORRECT: get_weather(location=\"New York\")\nINCORRECT: Let me check the weather: [get_weather(location=\"New York\")]\nINCORRECT: [get_events(location=\"Singapore\")] <- If function not in list\n\n"
    "2. RESPONSE RULES:\n- For pure function requests matching a listed function: ONLY output the function call(s)\n- For knowledge questions: ONLY output text\n- For missing parameters: ONLY request the specific missing parameters\n"
    "- For unavailable services (not in function list): output ONLY with internal knowledge or \"I don't have access to [Unavailable service] information\". Do NOT execute a function call.\n"
    "- If the query asks for information beyond what a listed function provides: output ONLY with internal knowledge about your limitations\n- NEVER combine text and function calls in the same response\n"
    "- NEVER suggest alternative functions when the requested service is unavailable\n- NEVER create or invent new functions not listed below\n\n"
    "3. STRICT BOUNDARIES:\n- ONLY use functions from the list below - no exceptions\n- NEVER use a function as an alternative to unavailable information\n- NEVER call functions not present in the function list\n- NEVER add explanatory text to function calls\n"
    "- NEVER respond with empty brackets\n- Use proper Python/JSON syntax for function calls\n- Check the function list carefully before responding\n\n"
    "4. TOOL RESPONSE HANDLING:\n- When receiving tool responses: provide concise, natural language responses\n- Don't repeat tool response verbatim\n- Don't add supplementary information\n\nHere is a list of functions in JSON format that you can invoke:\n"
)
LISTED = "\nHere is a list of functions in JSON format that you can invoke. Use exact format: [func_name1(param1=value1, param2=value2), func_name2(...)]\n"
XLAM = "You are a helpful assistant. You are developed by Salesforce xLAM team."
XLAM_FORMAT = 'You have access to a set of tools. When using tools, make calls in a single JSON array: \n\n[{"name": "tool_call_name", "arguments": {"arg1": "value1", "arg2": "value2"}}, ... (additional parallel tool calls as needed)]\n\nIf no tool is suitable, state that explicitly. If the user\'s input lacks required parameters, ask for clarification. Do not interpret or respond until tool results are returned. Once they are available, process them or make additional calls if needed. For tasks that don\'t require tools, such as casual conversation or general advice, respond directly in plain text. The available tools are:'
HERMES_HEAD = "You are a function calling AI model. You are provided with function signatures within <tools></tools> XML tags. You may call one or more functions to assist with the user query. Don't make assumptions about what values to plug into functions. Here are the available tools: <tools> "
HERMES_TAIL = (
    ' </tools>Use the following pydantic model json schema for each tool call you will make: {"properties": {"name": {"title": "Name", "type": "string"}, "arguments": {"title": "Arguments", "type": "object"}}, "required": ["name", "arguments"], "title": "FunctionCall", "type": "object"}}\n'
    'For each function call return a json object with function name and arguments within <tool_call></tool_call> XML tags as follows:\n<tool_call>\n{"name": <function-name>, "arguments": <args-dict>}\n</tool_call><|im_end|>'
)
PYTHON_TYPES = {"string": "str", "number": "float", "integer": "int", "boolean": "bool"}
USER, ASSISTANT, END = "<｜User｜>", "<｜Assistant｜>", "<｜end▁of▁sentence｜>"
CALLS, CALLS_END, CALL, CALL_END, SEP = "<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>", "<｜tool▁call▁begin｜>", "<｜tool▁call▁end｜>", "<｜tool▁sep｜>"
OUTPUTS, OUTPUTS_END, OUTPUT, OUTPUT_END = "<｜tool▁outputs▁begin｜>", "<｜tool▁outputs▁end｜>", "<｜tool▁output▁begin｜>", "<｜tool▁output▁end｜>"
R1_TOOLS = (
    "You are a helpful assistant with tool calling capabilities. When a tool call is needed, you MUST use the following format to issue the call:\n"
    '<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>function<｜tool▁sep｜>FUNCTION_NAME\n```json\n{"param1": "value1", "param2": "value2"}\n```<｜tool▁call▁end｜><｜tool▁calls▁end｜>\n\n'
    "Make sure the JSON is valid.## Tools\n\n### Function\n\nYou have the following functions available:\n\n"
)
V3_TOOLS = "\n\n# Tools\n\nYou may call one or more functions to assist with the user query."
V3_FORMAT = (
    "\n    \n</tools>\n\n\n\n    For function call returns, you should first print <｜tool▁calls▁begin｜>\n\n    For each function call, you should return object like:\n\n    "
    "<｜tool▁call▁begin｜>function<｜tool▁sep｜><function_name>\n```json\n<function_arguments_in_json_format>\n```<｜tool▁call▁end｜>\n\n    At the end of function call returns, you should print <｜tool▁calls▁end｜><｜end▁of▁sentence｜>"
)
V31_FORMAT = (
    "\nIMPORTANT: ALWAYS adhere to this exact format for tool use:\n<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>tool_call_name<｜tool▁sep｜>tool_call_arguments<｜tool▁call▁end｜>{{additional_tool_calls}}<｜tool▁calls▁end｜>\n\nWhere:\n\n"
    "- `tool_call_name` must be an exact match to one of the available tools\n- `tool_call_arguments` must be valid JSON that strictly follows the tool's Parameters Schema\n- For multiple tool calls, chain them directly without separators or spaces\n"
)

Messages, Tools = list[dict], list[dict] | None


def _line(spaces: int) -> str:
    """A line break and the indent that some layouts leave before a piece."""
    return "\n" + " " * spaces


def _calls(m: dict) -> list[tuple[str, str, dict]]:
    return [(c["type"], c["function"]["name"], c["function"]["arguments"]) for c in m.get("tool_calls") or []]


def _shown(m: dict, images: bool, trim: bool = True) -> str:
    """Attachments behind a message's text: images as a sign where the model reads them, and texts."""
    out = []
    for a in m.get("attachments") or []:
        if a["type"] == "image" and images:
            out.append("<|image|>")
        elif a["type"] == "text" and a.get("text"):
            out.append(a["text"].strip() if trim else a["text"])
    return "".join(out)


def _listed(tools: Tools) -> str:
    return "".join(to_json(t, 4) + "\n\n" for t in tools or [])


def _value(v: object) -> str:
    return v if isinstance(v, str) else to_json(v)


def _python_calls(m: dict, quote: str) -> str:
    return ", ".join(f"{name}({', '.join(f'{k}={quote}{_value(v)}{quote}' for k, v in sorted(args.items()))})" for _, name, args in _calls(m))


def _system(messages: Messages, otherwise: str) -> tuple[str, Messages]:
    """The leading system message, trimmed, and the rest."""
    if messages and messages[0]["role"] == "system":
        return messages[0]["content"].strip(), messages[1:]
    return otherwise, messages


def _llama3(messages: Messages, tools: Tools, bos: str, generation: bool, *, in_user: bool, images: bool, python: bool, always: bool) -> str:
    head = lambda role: f"<|start_header_id|>{role}<|end_header_id|>\n\n"
    pictured = images and any(a["type"] == "image" for m in messages for a in m.get("attachments") or [])
    system, rest = _system(messages, NO_TOOL_PROMPT if always or tools is not None else "")
    out = [bos]
    if system or not pictured:
        out += [head("system"), "Environment: ipython\n" if tools is not None else "", f"Cutting Knowledge Date: December 2023\nToday Date: {DATE}\n\n"]
        if tools is not None and not in_user:
            out += [PYTHON_IN_SYSTEM + PYTHON_FORMAT if python else JSON_IN_SYSTEM + JSON_FORMAT, _listed(tools)]
        out += [system, "<|eot_id|>"]
    if in_user and tools is not None:
        if not rest:
            raise TemplateError("Cannot put tools in the first user message when there's no first user message!")
        out += [head("user"), JSON_IN_USER, JSON_FORMAT, _listed(tools), rest[0]["content"].strip(), "<|eot_id|>"]
        rest = rest[1:]
    for m in rest:
        if m.get("tool_calls"):
            calls = _calls(m)
            if python:
                body = f"[{_python_calls(m, '')}]"
            elif len(calls) != 1:
                raise TemplateError("This model only supports single tool-calls at once!")
            else:
                body = f'{{"name": "{calls[0][1]}", "parameters": {to_json(calls[0][2])}}}'
            out += [head("assistant"), body, "<|eot_id|>"]
        elif m["role"] in ("tool", "ipython"):
            out += [head("ipython"), to_json({"output": m["content"]}), "<|eot_id|>"]
        else:
            out += [head(m["role"]), m["content"].strip(), "" if python else _shown(m, images), "<|eot_id|>"]
    return "".join([*out, head("assistant") if generation else ""])


def llama31_json(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    return _llama3(messages, tools, bos, generation, in_user=True, images=False, python=False, always=False)


def llama32_json(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    return _llama3(messages, tools, bos, generation, in_user=False, images=True, python=False, always=False)


def llama32_pythonic(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    return _llama3(messages, tools, bos, generation, in_user=False, images=False, python=True, always=True)


def llama4_json(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    head = lambda role: f"<|header_start|>{role}<|header_end|>\n\n"
    body = lambda m: m["content"].strip() + _shown(m, True)
    first, rest = (messages[0], messages[1:]) if messages and messages[0]["role"] == "system" else ({"content": NO_TOOL_PROMPT}, messages)
    out = [bos, head("system"), body(first), "\n<|eot|>\n"]
    if tools is not None:
        if not rest:
            raise TemplateError("Cannot put tools in the first user message when there's no first user message!")
        out += [head("user"), LIBRARY, _listed(tools), body(rest[0]), "\n<|eot|>"]
        rest = rest[1:]
    for m in rest:
        if m.get("tool_calls"):
            out += ["\n", head("assistant"), body(m), *(f'{{"name": "{name}", "parameters": {to_json(args)}}}' for _, name, args in _calls(m)), "\n<|eot|>"]
        elif m["role"] in ("tool", "ipython"):
            out += ["\n", head("ipython"), body(m), "\n<|eom|>"]
        else:
            out += [head(m["role"]), body(m), "\n<|eot|>"]
    return "".join([*out, "\n" + head("assistant") if generation else ""])


def llama4_pythonic(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    head = lambda role: f"<|header_start|>{role}<|header_end|>\n\n"
    tools = tools or None
    own = bool(messages) and messages[0]["role"] == "system"
    system, rest = _system(messages, COMPOSER if tools else "")
    out = [bos]
    if system:
        out += [head("system"), system, LISTED if own and tools else "", to_json(tools, 4) if tools else "", "<|eot|>"]
    for m in rest:
        if m.get("tool_calls"):
            if m["role"] == "assistant":
                out += [head("assistant"), m["content"], _shown(m, True, trim=False), "[", _python_calls(m, '"'), "]<|eot|>"]
        elif m["role"] in ("tool", "ipython"):
            out += [head("ipython"), to_json(m["content"]), "<|eot|>"]
        else:
            out += [head(m["role"]), m["content"], _shown(m, True), "<|eot|>"]
    return "".join([*out, head("assistant") if generation else ""])


def xlam_llama(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    head = lambda role: f"<|start_header_id|>{role}<|end_header_id|>\n\n"
    own = bool(messages) and messages[0]["role"] == "system"
    system, rest = _system(messages, XLAM)
    out = [bos, head("system"), system, "\n", XLAM_FORMAT + "\n\n" if tools is not None and not own else "", _listed(tools), "<|eot_id|>"]
    for m in rest:
        if "tool_calls" in m:
            calls = ", ".join(f'{{"name": "{name}", "arguments": {to_json(args)}}}' for _, name, args in _calls(m))
            out += [head("assistant"), f"[{calls}]" if calls else m["content"].strip() or "[]\n", "<|eot_id|>"]
        elif m["role"] in ("tool", "ipython"):
            out += [head("ipython"), m["content"], "<|eot_id|>"]
        else:
            out += [head(m["role"]), m["content"].strip(), "<|eot_id|>"]
    return "".join([*out, head("assistant") if generation else ""])


def _python_type(spec: dict) -> str:
    kind = spec.get("type")
    if isinstance(kind, list):
        return f"Union[{','.join(_python_type({'type': k}) for k in kind)}]"
    if kind == "object":
        more = spec.get("additionalProperties")
        return f"dict[str, {_python_type(more)}]" if isinstance(more, dict) else "dict"
    # What a list holds is not looked at.
    return "list[Any]" if kind == "array" else PYTHON_TYPES.get(kind, "Any")


def _signature(tool: dict) -> str:
    f = tool["function"]
    name, schema, gives = f["name"], f.get("parameters") or {}, f.get("return")
    params = sorted((schema.get("properties") or {}).items())
    told = f"{name}({', '.join(f'{k}: {_python_type(v)}' for k, v in params)})" + (f" -> {_python_type(gives)}" if gives else "") + f" - {f.get('description') or ''}\n\n"
    args = "".join(f"        {k}({_python_type(v)}): {(v.get('description') or '').strip()}" for k, v in params)
    returns = f"\n    Returns:\n        {gives['description']}" if gives and gives.get("description") else ""
    return f'{{"type": "function", "function": {{"name": "{name}", "description": "{told}' + ("    Args:\n" + args if params else "") + returns + f'", "parameters": {to_json(schema) if params else "{}"}}}'


def hermes(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    out = [bos, "<|im_start|>system\n", HERMES_HEAD, "\n".join(_signature(t) for t in tools or []), HERMES_TAIL]
    for i, m in enumerate(messages):
        last = i == len(messages) - 1
        if m["role"] == "assistant" and m.get("tool_calls"):
            calls = "".join(f'\n<tool_call>\n{{"name": "{name}", "arguments": {to_json(args)}}}\n</tool_call>' for _, name, args in _calls(m))
            out.append(f"<|im_start|>assistant{calls}<|im_end|>\n")
        elif m["role"] in ("user", "system", "assistant"):
            out.append(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n")
        elif m["role"] == "tool":
            # A run of tool messages shares one frame.
            out += ["<|im_start|>tool\n" if m.get("prev_role", "tool") != "tool" else "", "<tool_response>\n", m["content"], "\n</tool_response>" + ("" if last else "\n")]
            out.append("<|im_end|>" if last or m.get("next_role") != "tool" else "")
    return "".join([*out, "<|im_start|>assistant\n" if generation else ""])


def _system_prompt(messages: Messages) -> str:
    return "\n\n".join(m["content"] for m in messages if m["role"] == "system")


def _deepseek(messages: Messages, indent: dict[str, str], spell: Callable[[str, str, dict], str], between: str) -> tuple[list[str], bool, bool]:
    """The turns of the first two layouts: pieces, and whether the last message was a tool's or a user's.

    ``indent`` has what stands before a piece; the calls of a message are one
    block, the first with its content; tool outputs are opened once a call.
    """
    out: list[str] = []
    tool = user = False
    first_output = True
    for m in messages:
        content = m["content"]
        out.append(indent.get("message", ""))
        if m["role"] == "user":
            tool, user = False, True
            out.append(f"{USER}{content}{ASSISTANT}")
        elif m["role"] == "assistant":
            user = False
            if "think" in indent:
                out.append(indent["think"])
                if "</think>" in content:
                    content = content.rpartition("</think>")[2]
                    out.append(indent["cut"])
                out.append(indent["message"])
            if m.get("tool_calls"):
                out += [indent["piece"] + OUTPUTS_END if tool else ""]
                for k, (kind, name, args) in enumerate(_calls(m)):
                    call = CALL + spell(kind, name, args) + CALL_END
                    out.append(indent["call"] + content + CALLS + call if k == 0 else indent["more"] + between + call)
                out.append(indent["end"] + CALLS_END + END)
                tool, first_output = False, True
            else:
                out += [indent["piece"] + OUTPUTS_END if tool else indent["plain"], content, END]
                tool = False
        elif m["role"] == "tool":
            tool, user = True, False
            out += [indent["piece"], OUTPUTS if first_output else "\n", OUTPUT, content, OUTPUT_END]
            first_output = False
    return out, tool, user


def _fenced(kind: str, name: str, args: dict) -> str:
    return f"{kind}{SEP}{name}\n```json\n{to_json(args)}\n```"


def deepseekr1(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    system, space = _system_prompt(messages), "\n" + _line(12) * sum(2 if k == 0 else 1 for k, _ in enumerate([m for m in messages if m["role"] == "system"])) + "\n"
    if tools is not None:
        system += "\n\n" + R1_TOOLS + "".join(f"\n```json\n{to_json(t)}\n```\n" for t in tools)
        space += _line(4) * 2 + (_line(8) + _line(4)) * len(tools) + _line(4) + "\n"
    indent = {"message": _line(4), "think": _line(8), "cut": _line(12) + _line(8), "piece": "", "call": "", "more": "", "end": "", "plain": ""}
    out, tool, user = _deepseek(messages, indent, _fenced, "\n")
    return "".join([space, bos, system, *out, OUTPUTS_END if tool else "", "\n", ASSISTANT if generation and not user and not tool else ""])


def deepseekv3(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    space = "\n\n" + _line(12) * sum(2 if k == 0 else 1 for k, _ in enumerate([m for m in messages if m["role"] == "system"])) + "\n\n"
    listed = _line(4) + V3_TOOLS + "".join("\n" + to_json(t) for t in tools) + V3_FORMAT if tools else ""
    indent = {"piece": _line(12), "call": _line(20), "more": _line(16), "end": _line(8), "plain": _line(12) * 2}
    out, tool, user = _deepseek(messages, indent, _fenced, "\n")
    ends = [_line(4) + OUTPUTS_END + "\n" if tool else "", "\n\n", _line(4) + ASSISTANT + "\n" if generation and not user and not tool else ""]
    return "".join([space, bos, "\n", _system_prompt(messages), listed, *out, *ends])


def deepseekv31(messages: Messages, tools: Tools, bos: str, generation: bool) -> str:
    system, space = _system_prompt(messages), "\n" + _line(2) + "\n\n" + _line(6) * sum(2 if k == 0 else 1 for k, _ in enumerate([m for m in messages if m["role"] == "system"])) + "\n\n"
    if tools is not None:
        each = [t["function"] for t in tools]
        system += "\n\n## Tools\nYou have access to the following tools:\n" + "".join(f"\n### {f['name']}\nDescription: {f.get('description') or ''}\n\nParameters: {to_json(f.get('parameters'))}\n" for f in each) + V31_FORMAT
        space += _line(2) * 2 + (_line(4) + _line(2)) * len(tools) + _line(2) * 2 + "\n"
    out, tool, user = [space, "\n\n", bos, system], False, False
    for m in messages:
        content = m["content"]
        if m["role"] == "user":
            tool, user = False, True
            out.append(USER + content)
        elif m["role"] == "assistant":
            calls = [CALL + name + SEP + to_json(args) + CALL_END for _, name, args in _calls(m)]
            if user:
                out.append(_line(6) + ASSISTANT + ("</think>" if calls else _line(8) + "</think>"))
            if calls:
                out += [_line(10) + content + CALLS + calls[0], *(_line(8) + c for c in calls[1:]), _line(4) + CALLS_END + END]
            else:
                # Without thinking only what follows the first end of thought is kept, except right after a tool.
                out.append(_line(6) + (content if tool or "</think>" not in content else content.split("</think>", 1)[1]) + END)
            tool = user = False
        elif m["role"] == "tool":
            tool, user = True, False
            out.append(OUTPUT + content + OUTPUT_END)
    return "".join([*out, _line(2) + ASSISTANT + _line(4) + "</think>\n" if generation and user and not tool else ""])


#: Layouts by name, in the order in which they are listed, with what they are for.
LAYOUTS: dict[str, tuple[Callable[[Messages, Tools, str, bool], str], str]] = {
    "deepseekr1": (deepseekr1, "calls in fenced JSON, thoughts cut off"), "deepseekv3": (deepseekv3, "calls in fenced JSON"), "deepseekv31": (deepseekv31, "calls in one line, thinking off"),
    "hermes": (hermes, "calls in tool_call tags, tools as Python signatures"), "llama3.1_json": (llama31_json, "one JSON call a turn, tools with the first user message"), "llama3.2_json": (llama32_json, "one JSON call a turn, tools in the system message, images"),
    "llama3.2_pythonic": (llama32_pythonic, "calls as a Python list"), "llama4_json": (llama4_json, "text and JSON calls, images"), "llama4_pythonic": (llama4_pythonic, "text and a Python list of calls, images"), "xlam_llama": (xlam_llama, "a JSON array of calls"),
}


def listing() -> list[tuple[str, str]]:
    """(name, description) of all layouts by name."""
    return [(name, told) for name, (_, told) in sorted(LAYOUTS.items())]


def render_layout(records: DataFrame, name: str, tools: list[dict] | None = None, bos_token: str = "", add_generation_prompt: bool = False) -> DataFrame:
    """(record_id, model, content, error): each record in the layout ``name``; a record that the layout rejects has its error instead.

    ``tools`` is a small configuration list of {name, description, parameters}.
    """
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name!r}; there are {', '.join(sorted(LAYOUTS))}")
    wrapped = [{"type": t.get("type") or "function", "function": {k: v for k, v in t.items() if k != "type"}} for t in tools] if tools else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = LAYOUTS[name][0]
        for b in batches:
            rows = []
            for rid, model, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    rows.append((rid, model, layout(template_messages(json.loads(body)), wrapped, bos_token, add_generation_prompt), None))
                except TemplateError as e:
                    rows.append((rid, model, None, str(e)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["record_id", "model", "content", "error"])

    return records.select("record_id", "model", F.to_json(F.struct("record_id", "model", "turns")).alias("j")).mapInArrow(run, "record_id string, model string, content string, error string")


def choose(template: str = "", template_file: str = "", serializer: str = "", persisted: str = "") -> tuple[str, str]:
    """(kind, name) of what renders the records: a template named or given as a file, else a serializer, else the persisted template, else canonical."""
    if template and template_file:
        raise ValueError("a template is either named or given as a file")
    if template_file:
        return "file", template_file
    if template:
        return "template", template
    if serializer:
        return "serializer", serializer
    return ("template", persisted) if persisted else ("serializer", "canonical")
