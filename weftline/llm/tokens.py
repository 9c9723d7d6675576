"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

The distinct words of a batch of texts form a trie that is walked depth-first.
Each node carries the last token of the encoding of the prefix that ends
there, so a prefix that many words share is encoded once; following the last
tokens back spells out any word's encoding. The last token at a node is the
one vocabulary suffix that is *compatible* with the last token of what
precedes it, that is, BPE run over the two tokens' bytes leaves exactly these
two. In sorted order the walk needs only the states of the path it stands on,
so the trie is as deep as the longest word and no wider: words of any length
and number go through it.

Texts are cut before white space first. No token of the pattern joins a
non-space with a following space, so such segments encode independently, and a
worker keeps the ids of segments it has met.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# Unicode white space, and the public pre-tokenization pattern of the vocabulary with it spelled out.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SEGMENTS = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Bounds of what a worker remembers of earlier batches; beyond them it is forgotten and computed again, with the same result.
MAX_SEGMENTS, MAX_PAIRS, LONG = 300_000, 1_000_000, 400


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Depth-first walk over a trie of words with the last token of every prefix, for a vocabulary (file or its bytes)."""

    def __init__(self, vocabulary: str | bytes) -> None:
        if isinstance(vocabulary, str):
            with open(vocabulary, "rb") as f:
                vocabulary = f.read()
        model = json.loads(vocabulary)["model"]
        letter = byte_letters()
        spell = lambda token: bytes(letter[c] for c in token)
        self.ids: dict[bytes, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        vocab = model["vocab"]
        for token, i in vocab.items():
            if all(c in letter for c in token):
                self.ids[spell(token)] = i
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            i, ab = vocab[a + b], (vocab[a], vocab[b])
            self.pair.setdefault(ab, i)
            self.parts.setdefault(i, ab)
        self.reach: dict[bytes, int] = {}  # longest token by its last two bytes
        for token in self.ids:
            if (n := len(token)) > self.reach.get(token[-2:], 0):
                self.reach[token[-2:]] = n
        self.checked: dict[tuple[int, int], bool] = {}
        self.segments: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the neighbours ``a`` and ``b`` unmerged.

        The two are taken apart in reverse order of their making; if at some
        point the pieces that touch could merge earlier than the next step
        that made either of them, the boundary would not have survived.
        """
        known = self.checked.get((a, b))
        if known is not None:
            return known
        x, y, limit, ok = a, b, 1 << 60, True
        while True:
            made = self.pair.get((x, y))
            if made is not None and made < limit:
                ok = False
                break
            if x > y and x in self.parts:
                limit, x = x, self.parts[x][1]
            elif y in self.parts:  # of equal merges the left one is made first
                limit, y = y + 1, self.parts[y][0]
            elif x in self.parts:
                limit, x = x, self.parts[x][1]
            else:
                break
        if len(self.checked) > MAX_PAIRS:
            self.checked.clear()
        self.checked[a, b] = ok
        return ok

    def _state(self, word: bytes, depth: int, last: list[int]) -> tuple[int, int]:
        """Last token of ``word[:depth]`` and the depth it starts from; ``last`` has the tokens of all shorter prefixes."""
        ids = self.ids
        for n in range(min(depth, self.reach.get(word[max(0, depth - 2) : depth], 1)), 0, -1):
            token = ids.get(word[depth - n : depth])
            if token is not None and (n == depth or self.compatible(last[depth - n], token)):
                return token, depth - n
        raise ValueError("no token ends here")

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) of distinct words, in the order of the trie's depth-first walk; ids as little-endian 32-bit integers."""
        last, start, before = [-1], [0], b""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]  # back up to the node where the words part
            for depth in range(shared + 1, len(word) + 1):
                token, begins = self._state(word, depth, last)
                last.append(token)
                start.append(begins)
            out, at = [], len(word)
            while at:
                out.append(last[at].to_bytes(4, "little"))
                at = start[at]
            yield word, b"".join(reversed(out))
            before = word

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; none for null and empty texts."""
        known = self.segments
        cut = [SEGMENTS.findall(t) if t else () for t in texts]
        new = {s for parts in cut for s in parts if s not in known}
        if new:
            spelt = {s: WORDS.findall(s) for s in new}
            words = {w: w.encode("utf-8", "surrogatepass") for parts in spelt.values() for w in parts}
            ids = dict(self.walk(set(words.values())))
            fresh = {s: b"".join([ids[words[w]] for w in parts]) for s, parts in spelt.items()}
            known.update(fresh)
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        if len(known) > MAX_SEGMENTS:
            known.clear()
        for s in new:
            if len(s) > LONG:
                known.pop(s, None)
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]


_ENCODERS: dict[str, TrieEncoder] = {}
_SENT: dict[tuple[str, str], tuple[str, Broadcast]] = {}


def encoder(digest: str, vocabulary: Broadcast) -> TrieEncoder:
    """This process's encoder for a vocabulary that was sent to it."""
    if digest not in _ENCODERS:
        _ENCODERS[digest] = TrieEncoder(vocabulary.value)
    return _ENCODERS[digest]


def send_vocabulary(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """(digest, broadcast) of a vocabulary file (some MB), read on the driver; workers need no path."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT:
        with open(path, "rb") as f:
            data = f.read()
        _SENT[key] = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)
    return _SENT[key]


def vocabulary_path(tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> str:
    return f"{tokenizers}/{vocabulary}"


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens.

    Null and empty texts give an empty list; every row is kept, in its own
    partition (no shuffle), repeated doc_ids included. Strings that look like
    special tokens are ordinary text.
    """
    sent = send_vocabulary(documents.sparkSession, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*sent)
        for batch in batches:
            encoded = coder.encode_batch(batch.column(1).to_pylist())
            ends = [0]
            for e in encoded:
                ends.append(ends[-1] + len(e) // 4)
            data = pa.py_buffer(b"".join(encoded))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, data])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return documents.select(documents["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(texts: DataFrame, path: str | None = None) -> DataFrame:
    """``texts`` with its last column, the text, replaced by ``n_tokens`` (0 for null and empty)."""
    sent = send_vocabulary(texts.sparkSession, path or vocabulary_path())
    *keep, text = texts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*sent)
        for batch in batches:
            counts = [len(ids) // 4 for ids in coder.encode_batch(batch.column(len(keep)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return texts.mapInArrow(run, schema)
