"""Records to training text: serializers and the chat templates that need no tools.

All are column expressions over the turns of a record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import text as t


def _turns(f: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(F.coalesce("turns", F.array().cast("array<void>")), lambda x: x.isNotNull()), f)


def _lines(f: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_join(F.transform(F.filter("turns", lambda x: x.isNotNull()), f), "\n"), F.lit(""))


def chatml() -> Column:
    return _lines(lambda x: F.concat(F.lit("<|im_start|>"), t(x["role"]), F.lit("\n"), t(x["text"]), F.lit("\n<|im_end|>")))


def zephyr() -> Column:
    return _lines(lambda x: F.concat(F.lit("<|"), t(x["role"]), F.lit("|>\n"), t(x["text"])))


def flat() -> Column:
    return _lines(lambda x: F.concat(F.lit("["), t(x["role"]), F.lit("] "), t(x["text"])))


def _messages(content: Callable[[Column], Column]) -> Column:
    """Array of (role, content); null for a record without turns."""
    made = F.transform(F.filter("turns", lambda x: x.isNotNull()), lambda x: F.struct(t(x["role"]).alias("role"), content(x).alias("content")))
    return F.when(F.size("turns") > 0, made)


def openai() -> Column:
    """An assistant's reasoning follows its text after a blank line."""

    def content(x: Column) -> Column:
        text, why = t(x["text"]), t(x["reasoning"])
        return F.when((why != "") & (x["role"] == "assistant"), F.concat(text, F.when(text != "", "\n\n").otherwise(""), why)).otherwise(text)

    return _messages(content)


def anthropic() -> Column:
    """Reasoning is left out; a turn of attachments alone says so."""
    return _messages(lambda x: F.when((t(x["text"]) == "") & (F.size(x["attachments"]) > 0), "[attachments omitted]").otherwise(t(x["text"])))


#: Serializers by name, in the order they are listed.
SERIALIZERS: dict[str, Callable[[], Column]] = {"anthropic": anthropic, "openai": openai, "chatml": chatml, "zephyr": zephyr, "flat": flat}


def serializer(name: str) -> Callable[[], Column]:
    if name == "canonical":
        return lambda: F.to_json(F.struct("*"))
    if name not in SERIALIZERS:
        raise ValueError(f"unknown serializer {name!r}; there are canonical, {', '.join(SERIALIZERS)}")
    return SERIALIZERS[name]


def template_chatml(messages: Column, generation: bool = False) -> Column:
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n" if generation else ""))


def template_zephyr(messages: Column, eos: str = "</s>", generation: bool = False) -> Column:
    known = F.filter(messages, lambda m: m["role"].isin("user", "system", "assistant"))
    body = F.array_join(F.transform(known, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit(f"{eos}\n"))), "")
    return F.concat(body, F.when(F.size(messages) > 0, "<|assistant|>\n").otherwise("") if generation else F.lit(""))


def template_vicuna(messages: Column, bos: str = "<s>", eos: str = "</s>", generation: bool = False) -> Column:
    """USER and ASSISTANT lines after an optional system text; null where roles don't alternate from the user on."""
    has_system = F.coalesce(F.try_element_at(messages, F.lit(1))["role"] == "system", F.lit(False))
    system = F.when(has_system, F.concat(F.trim(F.try_element_at(messages, F.lit(1))["content"]), F.lit("\n\n"))).otherwise("")
    rest = F.when(has_system, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    wrong = F.exists(F.transform(rest, lambda m, i: (m["role"] == "user") != (i % 2 == 0)), lambda b: b)
    strip = lambda c: F.regexp_replace(c, r"^[\s\x85\xa0]+|[\s\x85\xa0]+$", "")
    line = lambda m: F.when(m["role"] == "user", F.concat(F.lit("USER: "), strip(m["content"]), F.lit("\n"))).when(m["role"] == "assistant", F.concat(F.lit("ASSISTANT: "), strip(m["content"]), F.lit(f"{eos}\n"))).otherwise("")
    body = F.array_join(F.transform(rest, line), "")
    return F.when(~wrong, F.concat(F.lit(bos), system, body, F.lit("ASSISTANT:" if generation else "")))
