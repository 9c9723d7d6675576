import pytest

from weftline.plans import layouts as L
from weftline.plans.templates import TemplateError, template_messages

CALL = {"tool": "f", "input": '{"b": 1, "a": "x"}', "output": {"text": "out", "content": None, "raw": None}, "status": "success"}
TURNS = [{"role": "user", "text": " hi "}, {"role": "assistant", "text": "so", "tool_calls": [CALL]}, {"role": "assistant", "text": "<think>t</think>bye"}]
MESSAGES = template_messages({"turns": TURNS})
TWO = template_messages({"turns": [TURNS[0], {"role": "assistant", "text": "", "tool_calls": [CALL, CALL]}]})
TOOLS = [{"type": "function", "function": {"name": "f", "description": "does f", "parameters": {"type": "object", "properties": {"a": {"type": "string", "description": " first "}, "b": {"type": ["number", "array"]}}}}}]
ARGS = '{"a":"x","b":1}'


def render(name, messages=MESSAGES, tools=None, generation=False):
    return L.LAYOUTS[name][0](messages, tools, "<s>", generation)


def test_hermes():
    text = render("hermes", tools=TOOLS, generation=True)
    assert '{"name": "f", "description": "f(a: str, b: Union[float,list[Any]]) - does f\n\n    Args:\n        a(str): first        b(Union[float,list[Any]]): "' in text
    assert text.endswith(
        "</tool_call><|im_end|><|im_start|>user\n hi <|im_end|>\n" f'<|im_start|>assistant\n<tool_call>\n{{"name": "f", "arguments": {ARGS}}}\n</tool_call><|im_end|>\n'
        "<|im_start|>tool\n<tool_response>\nout\n</tool_response>\n<|im_end|><|im_start|>assistant\n<think>t</think>bye<|im_end|>\n<|im_start|>assistant\n"
    )
    assert render("hermes", TWO).endswith("<|im_start|>tool\n<tool_response>\nout\n</tool_response>\n<tool_response>\nout\n</tool_response><|im_end|>")


def test_deepseek():
    call = f"<｜tool▁call▁begin｜>function<｜tool▁sep｜>f\n```json\n{ARGS}\n```<｜tool▁call▁end｜>"
    packed = lambda t: t.replace("\n", "").replace(" ", "")
    r1 = render("deepseekr1")
    assert r1.lstrip().startswith("<s>") and f"so<｜tool▁calls▁begin｜>{call}<｜tool▁calls▁end｜><｜end▁of▁sentence｜>" in r1 and "<think>" not in r1
    assert "<｜tool▁outputs▁begin｜><｜tool▁output▁begin｜>out<｜tool▁output▁end｜>" in r1 and r1.rstrip().endswith("<｜tool▁outputs▁end｜>bye<｜end▁of▁sentence｜>")
    v3 = render("deepseekv3", TWO)
    assert packed(v3) == packed(f"<s><｜User｜>hi<｜Assistant｜><｜tool▁calls▁begin｜>{call}{call}<｜tool▁calls▁end｜><｜end▁of▁sentence｜><｜tool▁outputs▁begin｜><｜tool▁output▁begin｜>out<｜tool▁output▁end｜><｜tool▁output▁begin｜>out<｜tool▁output▁end｜><｜tool▁outputs▁end｜>")
    assert "# Tools" in render("deepseekv3", tools=TOOLS) and "# Tools" not in v3
    v31 = render("deepseekv31")
    assert packed(v31) == packed(f"<s><｜User｜>hi<｜Assistant｜></think>so<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>f<｜tool▁sep｜>{ARGS}<｜tool▁call▁end｜><｜tool▁calls▁end｜><｜end▁of▁sentence｜><｜tool▁output▁begin｜>out<｜tool▁output▁end｜><think>t</think>bye<｜end▁of▁sentence｜>")
    assert render("deepseekv31", MESSAGES[:1], generation=True).rstrip().endswith("</think>")


def test_llama3():
    one = render("llama3.1_json", tools=TOOLS)
    assert one.startswith("<s><|start_header_id|>system<|end_header_id|>\n\nEnvironment: ipython\nCutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\nYou are a helpful assistant with tool calling")
    assert f'assistant<|end_header_id|>\n\n{{"name": "f", "parameters": {ARGS}}}<|eot_id|><|start_header_id|>ipython<|end_header_id|>\n\n{{"output":"out"}}<|eot_id|>' in one
    assert "that best answers the given prompt" in one and "that best answers" not in render("llama3.2_json", tools=TOOLS)
    with pytest.raises(TemplateError, match="single tool-calls"):
        render("llama3.1_json", TWO)
    with pytest.raises(TemplateError, match="no first user message"):
        render("llama3.1_json", [], TOOLS)
    picture = template_messages({"turns": [{"role": "user", "text": "see", "attachments": [{"type": "image"}, {"type": "text", "text": " t "}]}]})
    assert render("llama3.2_json", picture) == "<s><|start_header_id|>user<|end_header_id|>\n\nsee<|image|>t<|eot_id|>" and "<|image|>" not in render("llama3.1_json", picture)
    assert "[f(a=x, b=1), f(a=x, b=1)]<|eot_id|>" in render("llama3.2_pythonic", TWO)


def test_llama4_and_xlam():
    four = render("llama4_json")
    assert f'\n<|header_start|>assistant<|header_end|>\n\nso{{"name": "f", "parameters": {ARGS}}}\n<|eot|>\n<|header_start|>ipython<|header_end|>\n\nout\n<|eom|>' in four
    assert 'so[f(a="x", b="1")]<|eot|><|header_start|>ipython<|header_end|>\n\n"out"<|eot|>' in render("llama4_pythonic")
    assert render("llama4_pythonic").startswith("<s><|header_start|>user<|header_end|>\n\n hi <|eot|>") and "expert in function composition" in render("llama4_pythonic", tools=TOOLS)
    assert f'assistant<|end_header_id|>\n\n[{{"name": "f", "arguments": {ARGS}}}, {{"name": "f", "arguments": {ARGS}}}]<|eot_id|><|start_header_id|>ipython<|end_header_id|>\n\nout<|eot_id|>' in render("xlam_llama", TWO)


def test_choice_and_listing(spark):
    assert [L.choose("t", "", "s", "p"), L.choose("", "f", "s", "p"), L.choose("", "", "s", "p"), L.choose(persisted="p"), L.choose()] == [("template", "t"), ("file", "f"), ("serializer", "s"), ("template", "p"), ("serializer", "canonical")]
    with pytest.raises(ValueError, match="either"):
        L.choose("t", "f")
    assert len(L.listing()) == 10 and L.listing()[0][0] == "deepseekr1"
    with pytest.raises(ValueError, match="unknown layout 'x'"):
        L.render_layout(None, "x")
