"""Personal information inside free text.

Bootstrapped contextual extraction. Generic shapes propose mentions (runs of
digits, pairs of names, addresses, mail addresses). Seeds label some of them:
people of the directory, their mail addresses, strict formats, numbers after a
word that names them. Every mention, of whatever kind, is tied to lexical
patterns (words before and after, shape, domain, name parts). Spark scores the
graph of patterns and instances in rounds until the sure instances no longer
change: a pattern takes the label mix of its instances, an instance that of
its patterns and its own seed. So patterns that seeds induce discover
identifiers that no format or directory knows, and every row found has a score
of the graph. The graph holds counts of distinct (patterns, seed label)
combinations, combined map-side, not mentions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage

#: Rounds after which the graph has to be stable.
MOST_ROUNDS = 40
#: What a seed label says by itself.
SEED = 0.97
#: An instance labels its patterns in the next round only if it is this sure.
SURE = 0.75
THRESHOLD = 0.5
#: The scan's filter of given names has FILTER_BITS for each of so many; of more names, more words pass that meet none in the join.
GIVEN_NAMES, FILTER_BITS = 20_000, 512
#: At most this many patterns can each make up more than 1/HOT of all edges: the size bound of a broadcast.
HOT = 10_000

# Domains reserved for documentation and tests; street words; titles before names.
RESERVED = re.compile(r"(?:^|\.)(?:example|test|invalid|localhost)$|(?:^|\.)example\.(?:com|org|net|edu)$", re.I)
STREET = r"(?:[Ss]treet|[Ss]t\.|[Aa]venue|[Aa]ve\.?|[Rr]oad|[Rr]d\.|[Ll]ane|[Dd]rive|[Yy]ard|[Rr]ow|[Cc]lose|[Cc]rescent|[Ww]alk|[Cc]ourt|[Pp]lace|[Ss]quare|[Tt]errace|[Hh]ill|[Ww]ay|[Bb]oulevard|[Gg]ardens|[Mm]ews|[Qq]uay)"
TITLES = "Mr|Ms|Mrs|Miss|Dr|Prof|Herr|Frau|Mme|Sr|Sra"

_M = r"\w\u0300-\u036f'’\-"
_W = rf"[^\W\d_][{_M}]*"
_UP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĹĽŁŃŇŐŒŔŘŚŠŤŪŮŰŹŻŽ]"
# In addresses a town's second word is not followed by a capitalised one: that begins a name or a sentence.
EMAIL = re.compile(r"(?<![\w.+\-@/])([\w.+\-]*\w)\s?@\s?((?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})(?![\w@])")
SPELT = re.compile(r"(?<![\w.+\-])([\w.+\-]*\w)\s?[(\[{<]\s?at\s?[)\]}>]\s?([A-Za-z0-9\-]+(?:(?:\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s|\.)[A-Za-z0-9\-]+)+)|(?<![\w.+\-])([\w.+\-]*\w)\sat\s([A-Za-z0-9\-]+(?:\sdot\s[A-Za-z0-9\-]+)+)", re.I)
ADDRESS = re.compile(
    rf"(?:(?:[Ff]lat|[Aa]pt\.?|[Uu]nit|[Ss]uite)\s?\d+[A-Za-z]?\s*[,\n]\s*)?(?<![\w.\-/])\d{{1,5}}[A-Za-z]?,?\s(?:{_UP}[{_M}]+\s){{1,3}}{STREET}(?!\w)(?:,?\s*(?:[Ff]lat|[Aa]pt\.?|[Uu]nit|[Ss]uite|#)\s?\d+[A-Za-z]?)?(?:[,\n]\s*{_UP}[{_M}]+(?:\s{_UP}[{_M}]+(?![{_M}]|\s+{_UP}))?(?:[,\s]\s*(?:[A-Z]{{2}}\s)?\d{{4,6}})?)?"
    rf"|\b[Ff]lat\s?\d+\s*,\s*\d{{1,5}}[a-z]?\s(?:[a-zà-þ'’\-]+\s){{1,3}}{STREET}(?!\w)(?:,\s*[a-zà-þ'’\-]+(?:\s[a-zà-þ]+)?)?"
    rf"|\b[Pp]\.?\s?[Oo]\.?\s?[Bb]ox\s\d+(?:,\s*{_UP}[{_M}]+(?:\s{_UP}[{_M}]+(?![{_M}]|\s+{_UP}))?(?:\s\d{{4,6}})?)?"
    rf"|(?<!\w)(?:{_UP}[{_M}]{{1,40}}\s){{1,4}}\d{{1,4}}\s?[a-z]?,\s\d{{4,5}}\s{_UP}[{_M}]+",
)
NUMBER = re.compile(r"(?<![\w.\-/+#:])(?:\+|00)?\(?\d(?:[ .()/\-]{0,2}\d){6,16}(?![\w\-]|\.\d)")
IDENTIFIER = re.compile(r"(?<![\w\-])(?:[A-Z]{1,3}-[A-Z]{2}-\d{3,5}-\d{3,5}|[A-Z]{1,3}\d{6,9}[A-Z]?|[A-Z]{2}(?:\s\d\d){3}\s?[A-Z]|\d{2}(?:\s\d{3}){3}|\d{6}-\d{4}|\d{3}[\- ]\d{2}[\- ]\d{4})(?![\w\-])")
QUAD = re.compile(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
ID_WORDS = re.compile(r"(?:ssn|social security|passport|national id|identity|steuer|tax id|ni number|insurance|licen[cs]e|driver|id card|personal number)[^\n]{0,12}$", re.I)
PHONE_WORDS = re.compile(r"(?:phone|tel|mobile|cell|fax|sms\w*|whatsapp|call|ring|dial|nummer|appelle\w*|pager|voicemail\w*)[^\n]{0,14}$", re.I)
STRICT_PHONE = re.compile(r"^(?:\+\d{1,3}[ \-]?\(?\d|00\d{2}\s|\(\d{3}\)\s?\d{3}[ \-]\d{4}$)")
STRICT_ID = re.compile(r"^(?:\d{3}-\d{2}-\d{4}|[A-Z]{2}\d{6}[A-D]|[A-Z]{2}(?:\s\d\d){3}\s?[A-D])$")
NAME = re.compile(
    rf"(?<![{_M}.@/])(?!(?:{TITLES})\b)({_UP}[{_M}]+)[ \t ]{{1,3}}(?!(?:{TITLES})\b)({_UP}[{_M}]+)"
    rf"|(?<![\w.@/])({_UP})\.\s?({_UP}[{_M}]{{2,}})"
    rf"|(?<![{_M}.@/])({_UP}[{_M}]+),\s({_UP}[{_M}]+)"
    rf"|\|\s*({_UP}[{_M}]+)\s*\|\s*({_UP}[{_M}]+)\s*\|"
    rf"|\"first\w*\":\s*\"({_UP}[{_M}]+)\",\s*\"last\w*\":\s*\"({_UP}[{_M}]+)\"",
)
WORD = re.compile(r"\S+")


#: Street or box, town and post code: as strict as an address gets.
FULL_ADDRESS = re.compile(rf"(?:{STREET}(?!\w)|^[Pp]\.?\s?[Oo]\.?\s?[Bb]ox).*\d{{4,6}}$", re.S)


@dataclass(frozen=True)
class Mention:
    """A possible item: its span, group (email, address, number, name), seed label ('' unknown), pattern nodes, and who it may name.

    ``who`` are two name parts in lower case, sorted, joined by ``|`` (an
    initial counts as ''); the directory's people have it as their key.
    """

    start: int
    end: int
    group: str
    label: str
    nodes: tuple[str, ...]
    who: str = ""


def who_is(a: str, b: str) -> str:
    x, y = sorted(("" if len(a) == 1 else a.lower(), "" if len(b) == 1 else b.lower()))
    return f"{x}|{y}" if y else ""


class NameFilter:
    """Whether a word may be a given name: a bit for each hash of one, none for a filter that lets all pass. It never misses a name.

    It holds the names and the first word of each; ``words`` is the greatest
    number of words of a name.
    """

    def __init__(self, bits: int, chunks: dict[int, bytes], words: int) -> None:
        self.bits, self.chunks, self.words, self.others = bits, chunks, words, set()

    def __contains__(self, name: str) -> bool:
        if not self.bits:
            return True
        chunk, bit = divmod(zlib.crc32(name.encode("utf-8", "replace")) % self.bits, CHUNK)
        return chunk in self.chunks and bool(self.chunks[chunk][bit >> 3] >> (bit & 7) & 1)

    def among(self, words: set[str]) -> set[str]:
        """Those of ``words`` that may be names; the others are remembered."""
        found = {w for w in words - self.others if w in self}
        self.others |= words - found
        if len(self.others) > MEMO:
            self.others.clear()
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"others": set()}


#: Bits in a row of the filter, as Spark builds it; words a worker remembers.
CHUNK, MEMO = 32_768, 200_000
_FIRST = re.compile(rf"(?<![{_M}.@+])[^\W\d_A-Z][{_M}.]*+(?=\s)")
_NEXT = re.compile(rf"\s+[^\W\d_A-Z][{_M}.]*+(?=\s)")
_FAMILY = re.compile(rf"\s+([^\W\d_A-Z][{_M}]{{3,}})(?![@.\w])")


def _lower_names(text: str, given: NameFilter | frozenset[str] | None) -> Iterator[tuple[tuple[int, int], list[str], bool]]:
    """Every word in lower case that may be a given name (any if ``given`` is None), with the word after it.

    Pairs may overlap: the directory, not what else passed, says which hold a name.
    """
    if given is not None and not isinstance(given, NameFilter) and not given:
        return
    words, first = 1, None
    if isinstance(given, NameFilter):
        words, first = given.words, given.among(set(_FIRST.findall(text)))
        if not first:
            return
    elif given:
        words = max(len(n.split()) for n in given)
    for m in _FIRST.finditer(text):
        if first is not None and m[0] not in first:
            continue
        end = m.end()
        for k in range(words):
            if k:
                more = _NEXT.match(text, end)
                if more is None:
                    break
                end = more.end()
            name = text[m.start() : end]
            if (given is None or name in given) and name == name.lower():
                family = _FAMILY.match(text, end)
                if family:
                    yield (m.start(), family.end()), [name, family[1]], True


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans blanked; they don't overlap."""
    parts, at = [], 0
    for s, e in sorted(spans):
        parts += [text[at:s], "\x00" * (e - s)]
        at = e
    return "".join([*parts, text[at:]])


def _around(text: str, start: int, end: int, group: str) -> tuple[str, ...]:
    """Pattern nodes of the words before and after, digits as 9."""
    norm = lambda w: re.sub(r"\d+", "9", w.lower())
    left = [norm(w) for w in WORD.findall(text[max(0, start - 40) : start])]
    right = [norm(w) for w in WORD.findall(text[end : end + 30])]
    # The edge of a text is no pattern.
    nodes = (("L2", left[-2:], 2), ("L1", left[-1:], 1), ("R2", right[:2], 2), ("R1", right[:1], 1))
    return tuple(f"{group}|{side}|{' '.join(words)}" for side, words, size in nodes if len(words) == size)


def _mail_nodes(text: str, start: int, end: int, local: str, domain: str, form: str) -> tuple[str, ...]:
    # Whole domain, its end, and the way it is written.
    return (*_around(text, start, end, "email"), f"email|D|{domain.lower()}", f"email|T|{domain.lower().rpartition('.')[2]}", f"email|S|{form}", f"email|A|{re.sub('[^a-z]+', '.', re.sub('[a-z]+', 'a', local.lower()))}")


def _mail_owner(local: str) -> str:
    parts = [p for p in re.split(r"[._+\-\d]+", local) if p]
    return who_is(parts[0], parts[1]) if len(parts) == 2 else ""


def mentions(text: str, given: NameFilter | frozenset[str] | None = frozenset()) -> list[Mention]:
    """All mentions of a text; what one kind covers is not offered to the next."""
    out: list[Mention] = []
    spans: list[tuple[int, int]] = []

    def take(start: int, end: int, group: str, label: str, nodes: tuple[str, ...], who: str = "") -> None:
        spans.append((start, end))
        out.append(Mention(start, end, group, label, nodes, who))

    if "@" in text:
        for m in EMAIL.finditer(text):
            remote = m[1].lower() == "git" or m[2].lower().startswith(("git.", "github.", "gitlab.")) or text[m.end() : m.end() + 1] == ":" and text[m.end() + 1 : m.end() + 2].strip() != "" or text[max(0, m.start() - 3) : m.start()] == "://"
            if remote or RESERVED.search(m[2]):
                take(m.start(), m.end(), "email", "none", ())
                continue
            framed = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1] == "<>"
            form = "framed" if framed else "spaced" if " " in m[0] else "plain"
            take(m.start(), m.end(), "email", "email" if framed else "", _mail_nodes(text, m.start(), m.end(), m[1], m[2], form), _mail_owner(m[1]))
    text, done = _mask(text, spans), len(spans)
    if " at " in text or "at)" in text or "at]" in text or "at}" in text or "at>" in text or "AT" in text:
        for m in SPELT.finditer(text):
            domain = re.sub(r"\s?[(\[{<]?\s?\bdot\b\s?[)\]}>]?\s?", ".", m[2] or m[4], flags=re.I)
            if re.search(r"\.[A-Za-z]{2,}$", domain):
                local = m[1] or m[3]
                none = RESERVED.search(domain)
                take(m.start(), m.end(), "email", "none" if none else "", () if none else _mail_nodes(text, m.start(), m.end(), local, domain, "spelt"), _mail_owner(local))
    text = _mask(text, spans[done:])
    done = len(spans)
    if any(ch.isdigit() for ch in text):
        for m in ADDRESS.finditer(text):
            street = re.search(rf"{STREET}(?!\w)", m[0])
            form = "box" if re.match(r"[Pp]\.?\s?[Oo]", m[0]) else "street" if street else "trailing"
            shape = re.sub(r"[a-zà-þ]+", "a", re.sub(rf"{_UP}[{_M}]*", "A", re.sub(r"\d+", "9", m[0])))
            take(m.start(), m.end(), "address", "address" if FULL_ADDRESS.search(m[0]) else "", (*_around(text, m.start(), m.end(), "address"), f"address|F|{form}", f"address|S|{shape}", *([f"address|W|{street[0].lower()}"] if street else [])))
        text = _mask(text, spans[done:])
        done = len(spans)
        for pattern in (IDENTIFIER, NUMBER):
            for m in pattern.finditer(text):
                v, before = m[0], text[max(0, m.start() - 40) : m.start()]
                digits = sum(c.isdigit() for c in v)
                if digits < 6 or digits > 16:
                    continue
                # A word that may name a phone is a pattern as others are; only formats and words for papers are seeds.
                hint = bool(PHONE_WORDS.search(before)) and digits >= 7
                if ID_WORDS.search(before) or STRICT_ID.match(v):
                    label = "id_number"
                elif QUAD.match(v) or v.isdigit() and not hint:
                    label = "none"
                else:
                    label = "phone" if STRICT_PHONE.match(v) else ""
                shape = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", v))
                call = PHONE_WORDS.search(before)
                take(m.start(), m.end(), "number", label, (*_around(text, m.start(), m.end(), "number"), f"number|S|{shape}", *([f"number|K|{re.match('[a-z]+', call[0].lower())[0]}"] if call and hint else [])))
            text = _mask(text, spans[done:])
            done = len(spans)
    found = [(m.span(), [g for g in m.groups() if g], False) for m in NAME.finditer(text)]
    found += _lower_names(text, given)
    for (start, end), (a, b), small in found:
        nodes = (*_around(text, start, end, "name"), f"name|N|{a.lower()}", f"name|N|{b.lower()}")
        take(start, end, "lower" if small else "name", "", nodes, who_is(a, b))
    return out


KEYS = ("record_id", "turn_no", "field")
MENTIONS = "record_id string, turn_no long, field string, `start` int, `end` int, `group` string, label string, nodes array<string>, who string"
KINDS = ("email", "phone", "id_number", "address", "person")


def people_of(accounts: DataFrame) -> DataFrame:
    """(given, family) in lower case of the directory's people."""
    return accounts.where("kind = 'person' and given_name is not null and family_name is not null").select(F.lower("given_name").alias("given"), F.lower("family_name").alias("family")).distinct()


def given_names(people: DataFrame, most: int = GIVEN_NAMES) -> NameFilter | frozenset[str]:
    """A filter of the directory's given names, as large for few as for many; ``most`` sets its size (0: none), which changes no result.

    Spark builds it in rows of CHUNK bits, so only the filter comes to the driver.
    """
    words = people.agg(F.max(F.size(F.split(F.trim("given"), r"\s+")))).first()[0]
    if words is None:
        return frozenset()
    bits = most * FILTER_BITS
    if not bits:
        return NameFilter(0, {}, words)
    at = F.pmod(F.crc32(F.col("given").cast("binary")), F.lit(bits))
    names = people.select(F.explode(F.array("given", F.split(F.trim("given"), r"\s+")[0])).alias("given"))
    rows = names.select(F.floor(at / CHUNK).cast("int").alias("chunk"), (at % CHUNK).alias("bit")).distinct()
    built = rows.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect()
    return NameFilter(bits, {r.chunk: bytes(r.bitmap) for r in built}, words)


def fields_of(records: DataFrame) -> DataFrame:
    """(record_id, turn_no, field, text) of all turn texts and reasoning."""
    turns = records.select("record_id", F.posexplode("turns").alias("turn_no", "t"))
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"t.{n}").alias("text")) for n in ("text", "reasoning")])
    rows = turns.select("record_id", F.col("turn_no").cast("long").alias("turn_no"), F.explode(fields).alias("f"))
    return rows.select("record_id", "turn_no", "f.field", "f.text").where("text is not null and text != ''")


def scan(fields: DataFrame, given: NameFilter | frozenset[str] | None) -> DataFrame:
    """The mentions of all fields, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        names = (*KEYS, "start", "end", "group", "label", "nodes", "who")
        for batch in batches:
            out = []
            for *key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out += [(*key, m.start, m.end, m.group, m.label, list(m.nodes), m.who) for m in mentions(text, given)]
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=list(names))

    return fields.select(*KEYS, "text").mapInArrow(run, MENTIONS)


def seeded(found: DataFrame, people: DataFrame) -> DataFrame:
    """Mentions with the directory's labels: names of its people, and mail addresses that spell one; pairs in lower case need a given name of it."""
    x, y = F.least("given", "family"), F.greatest("given", "family")
    keys = people.select(F.explode(F.array(F.concat_ws("|", x, y), F.concat(F.lit("|"), F.col("family")))).alias("who")).distinct().withColumn("known", F.lit(True))
    out = found.join(keys, "who", "left")
    given = people.select(F.col("given").alias("first")).distinct().withColumn("is_given", F.lit(True))
    first = F.substring_index(F.element_at("nodes", F.size("nodes") - 1), "|", -1)
    lower = out.where("`group` = 'lower'").withColumn("first", first).join(given, "first").drop("first", "is_given")
    out = out.where("`group` != 'lower'").unionByName(lower)
    label = F.when((F.col("label") == "") & F.col("known"), F.when(F.col("group") == "email", "email").otherwise("person")).otherwise(F.col("label"))
    return out.withColumn("label", label).drop("who", "known")


LABELS = (*KINDS, "none")


def _by_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with the scores of their node (unknown nodes drop out); frequent nodes come by broadcast, so no key of the shuffle is hot."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(total / HOT)
    scores = nodes.withColumn("hot", hot)
    often = F.broadcast(scores.where("hot").drop("hot", "n").withColumn("is_hot", F.lit(True)))
    marked = edges.join(often, "node", "left")
    known = marked.where("is_hot").drop("is_hot")
    rest = marked.where("is_hot is null").select(*edges.columns).join(scores.where("not hot").drop("hot", "n"), "node")
    return known.unionByName(rest)


def pattern_scores(found: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, kind, p): what the graph says of each distinct combination of nodes and seed label.

    Every round a node takes the label mix of its instances, thinned by those
    it does not know, and an instance the chance that at least one of its
    nodes, or its own seed, is right (noisy or). Only seeds and instances sure
    of their kind label nodes in the next round. It ends when no instance
    becomes or ceases to be sure.
    """
    combos = stage(found.groupBy("id", "label").agg(F.first("nodes").alias("nodes"), F.count(F.lit(1)).cast("double").alias("n")))
    edges = stage(combos.select("id", "label", "n", F.explode("nodes").alias("node")))
    own = F.when(F.col("label") == "", F.lit(None).cast("string")).otherwise(F.col("label"))
    told_as = stage(combos.select("id", own.alias("kind")).where("kind is not null"))
    mark, state = None, None
    for _ in range(most_rounds):
        said = edges.join(told_as, "id", "left")
        nodes = said.groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0.0)).alias(k) for k in LABELS])
        # Unknown instances weigh against a pattern a little: one that rarely meets seeds proves little.
        told = sum((F.col(k) for k in LABELS[1:]), F.col(LABELS[0]))
        weight = F.least(told, F.lit(20.0)) / (F.least(told, F.lit(20.0)) + 2.0)
        trust = (told + 0.2) / (0.3 * F.col("n") + 0.7 * told + 0.2)
        # What follows a name is often the next sentence.
        weight = weight * F.when(F.col("node").startswith("name|R"), 0.5).otherwise(1.0)
        nodes = stage(nodes.where(told > 0).select("node", "n", *[F.log(1 - F.least(weight * F.col(k) / told * trust, F.lit(0.999))).alias(k) for k in LABELS]))
        part = _by_node(edges.where("label = ''").select("id", "node"), nodes)
        scores = part.groupBy("id").agg(*[(1 - F.exp(F.sum(k))).alias(k) for k in LABELS])
        best = F.greatest(*[F.struct(F.col(k).alias("p"), F.lit(k).alias("kind")) for k in LABELS])
        new = stage(scores.select("id", best.alias("b")).select("id", "b.kind", "b.p"))
        sure = new.where(F.col("p") >= SURE)
        now = tuple(sure.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "kind").cast("decimal(38,0)"))).first())
        unstage(nodes, *([state] if state is not None else []))
        state = new
        if now == mark:
            break
        mark = now
        told_as = combos.where("label != ''").select("id", F.col("label").alias("kind")).unionByName(sure.select("id", "kind"))
        told_as = stage(told_as)
    seeds = combos.where("label != ''").select("id", F.col("label").alias("kind"), F.lit(SEED).alias("p"))
    return seeds.unionByName(state.select("id", "kind", "p"))


def resolved(records: DataFrame, accounts: DataFrame, threshold: float = THRESHOLD, most_names: int = GIVEN_NAMES) -> DataFrame:
    """(record_id, turn_no, field, start, end, kind, by_graph): every mention that is an item, and whether the graph alone says so."""
    people = people_of(accounts)
    found = seeded(stage(scan(fields_of(records), given_names(people))), people)
    # Mentions with nodes differ by them and their label; the few kinds of mention without nodes are settled by format.
    found = found.where(F.size("nodes") > 0).withColumn("id", F.unhex(F.md5(F.concat_ws("\x01", "label", "nodes"))))
    # A record delivered twice counts once in the graph too.
    found = stage(found.dropDuplicates([*KEYS, "start", "end", "id"]))
    scores = pattern_scores(found).where((F.col("p") >= threshold) & F.col("kind").isin(*KINDS)).select("id", "kind")
    return found.select(*KEYS, "start", "end", "label", "id").join(scores, "id").select(*KEYS, "start", "end", "kind", (F.col("label") == "").alias("by_graph"))


def home_owner(path: str) -> Column:
    """Owner of the home folder a path lies in, or ''."""
    p = F.regexp_replace(F.col(path), r"\\", "/")
    named = F.regexp_extract(p, r"(?i)(?:^|[/:])(?:home|users|documents and settings)/+([^/]+)", 1)
    return F.when(named != "", named).when(p.rlike(r"^(?:file://)?/root(?:/|$)"), "root").otherwise("")


def accounts_in_paths(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """(record_id, turn_no, field, pii_kind): working directories in the home of someone who is no service account."""
    services = accounts.where("kind = 'service' and handle is not null").select(F.lower("handle").alias("owner")).distinct()
    owners = records.select("record_id", F.lower(home_owner("working_dir")).alias("owner")).where("owner != ''")
    people = owners.join(services, "owner", "left_anti")
    return people.select("record_id", F.lit(-1).cast("long").alias("turn_no"), F.lit("working_dir").alias("field"), F.lit("account").alias("pii_kind"))


def personal_found(records: DataFrame, accounts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(record_id, turn_no, field, pii_kind): each field value and kind of data found in it, once.

    Null and empty fields hold nothing; records delivered twice count once.
    """
    texts = resolved(records, accounts, threshold).select(*KEYS, F.col("kind").alias("pii_kind"))
    return texts.unionByName(accounts_in_paths(records, accounts)).distinct()


def redacted(records: DataFrame, accounts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(record_id, turn_no, field, text): the changed fields with typed placeholders, the rest unchanged."""
    spans = resolved(records, accounts, threshold).distinct().groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, marks in zip(b["text"], b["spans"]):
                parts, at = [], 0
                for m in marks:
                    if m["start"] >= at:
                        parts += [text[at : m["start"]], f"[{m['kind'].upper()}]"]
                        at = m["end"]
                out.append("".join([*parts, text[at:]]))
            yield b[list(KEYS)].assign(text=out)

    texts = fields_of(records).dropDuplicates(list(KEYS)).join(spans, list(KEYS))
    turns = texts.mapInPandas(run, "record_id string, turn_no long, field string, text string")
    owners = accounts_in_paths(records, accounts).select(*KEYS).distinct()
    path = F.regexp_replace("working_dir", r"(?i)((?:^|[/\\:])(?:home|users|documents and settings)[/\\]+)[^/\\]+", "$1[ACCOUNT]")
    dirs = records.select("record_id", path.alias("text")).dropDuplicates(["record_id"]).join(owners, "record_id").select(*KEYS, "text")
    return turns.unionByName(dirs)
