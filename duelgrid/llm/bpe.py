"""Byte-level BPE encoding and decoding over a rank array.

The vocabulary file (a `tokenizers` JSON with a byte-level pre-tokenizer) is read on the driver and
broadcast; its size is checked.  Inside a task the text is cut at special tokens, split by the
pre-tokenizer's pattern, and each word is merged on two contiguous arrays: the part boundaries (as the
parts' ids) and the ranks of adjacent parts.  The smallest rank is looked up by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed.  Words beyond `LONG` parts keep their candidate
merges in a heap with lazy deletion instead, which gives the same merges in n log n.

Null text counts as empty: no ids, empty decoded text.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import sys
from array import array
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from duelgrid.llm.common import map_slices, pick

#: Fixed value: how the byte-level pre-tokenizer splits text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLITTER = regex.compile(SPLIT)
#: The same for Latin-1 text, but for the characters of which the standard module has another notion.
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_QUICK = "\x1c\x1d\x1e\x1f\xb2\xb3\xb9\xbc\xbd\xbe".encode("latin-1")
#: Parts from which a word's merges are kept in a heap.
LONG = 256
#: Words remembered per generation and task; two generations are held.
CACHE = 200_000
#: A vocabulary file above this size is refused, as it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
NONE = sys.maxsize
CODECS: dict[str, Codec] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, inverted."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(kept))
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def odd_characters() -> dict[int, str]:
    """Characters that the installed tokenizer library's Unicode tables put into another class than the
    `regex` module's do, each with a stand-in of the right class (a letter, a digit, a sign, a space)."""
    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    points = "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
    theirs, ours = ["!"] * len(points), ["!"] * len(points)
    for kind, pattern in (("x", r"\p{L}"), ("0", r"\p{N}"), (" ", r"\s")):
        marked = Replace(Regex(pattern), "\0")
        for start in range(0, len(points), 4096):
            for i, c in enumerate(marked.normalize_str(points[start:start + 4096])):
                if c == "\0":
                    theirs[start + i] = kind
        for m in regex.finditer(pattern, points):
            ours[m.start()] = kind
    return {ord(c): t for c, t, o in zip(points, theirs, ours) if t != o}


class Codec(dict):
    """Encoder and decoder of one vocabulary; as a dict, it remembers the ids of words, as packed integers."""

    def __init__(self, spec: dict, odd: dict[int, str], cache: int = CACHE):
        super().__init__()
        model, letters = spec["model"], byte_letters()
        vocabulary = model["vocab"]
        self.limit, self.old, self.odd = cache, {}, odd
        size = max([-1, *vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.ids = list(range(size))  # one object per id, shared by all words
        self.of_byte = [vocabulary.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank, self.made = [{} for _ in self.ids], []  # by the left part: right part -> rank
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocabulary[a]].setdefault(vocabulary[b], len(self.made))
            self.made.append(vocabulary[a + b])
        self.bytes = [b""] * size
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take their surroundings in are not supported")
            self.special[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.text = list(map(str, self.ids))

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            parts = [self.of_byte[b] for b in word.encode()]
            if None in parts:
                parts = [i for i in parts if i is not None]
            merged = self.merge(parts) if len(parts) <= LONG else self.merge_long(parts)
            found = array("i", merged).tobytes()
        if len(word) <= LONG:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def merge(self, parts: list[int]) -> list[int]:
        rank, made = self.rank, self.made
        ranks = [rank[a].get(b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            del parts[i], ranks[i]
            new = parts[i] = made[least]
            if i:
                ranks[i - 1] = rank[parts[i - 1]].get(new, NONE)
            if i < len(ranks):
                ranks[i] = rank[new].get(parts[i + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        rank, made, n = self.rank, self.made, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank[parts[i]].get(parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if parts[i] < 0 or after[i] != j or parts[j] < 0 or rank[parts[i]].get(parts[j]) != r:
                continue
            parts[i], parts[j], after[i] = made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank[parts[i]].get(parts[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, after[i]))
            if (k := before[i]) >= 0 and (x := rank[parts[k]].get(parts[i])) is not None:
                heapq.heappush(heap, (x, k, i))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            if not self.odd.keys().isdisjoint(map(ord, set(text))):
                return [text[m.start():m.end()] for m in SPLITTER.finditer(text.translate(self.odd))]
            return SPLITTER.findall(text)
        return (QUICK if len(plain) == len(plain.translate(None, NOT_QUICK)) else SPLITTER).findall(text)

    def encode(self, text: str) -> list[int]:
        out, start = [], 0
        for m in (self.cut.finditer(text) if self.cut else ()):
            out.extend(map(self.__getitem__, self.words(text[start:m.start()])))
            out.append(array("i", [self.special[m.group()]]).tobytes())
            start = m.end()
        out.extend(map(self.__getitem__, self.words(text[start:] if start else text)))
        return array("i", b"".join(out)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def codec_maker(spark, path: str):
    """Broadcasts the vocabulary; returns the function that tasks build their codec with."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast((json.load(f), odd_characters()))

    def codec() -> Codec:
        if path not in CODECS:  # one per worker process, so that its words stay remembered from task to task
            CODECS.clear()
            CODECS[path] = Codec(*sent.value)
        return CODECS[path]

    return codec


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: the whole text of each row as token ids (null text: no ids)."""
    maker = codec_maker(docs.sparkSession, path)

    def work():
        codec = maker()
        return lambda part: {"doc_id": part.column(0),
                             "ids": [codec.encode(t or "") for t in part.column(1).to_pylist()]}

    return map_slices(pick(docs, "doc_id", "text"), work, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the text that the ids spell (null ids: empty text)."""
    maker = codec_maker(encoded.sparkSession, path)

    def work():
        codec = maker()
        return lambda part: {"doc_id": part.column(0),
                             "text": [codec.decode(i or []) for i in part.column(1).to_pylist()]}

    return map_slices(pick(encoded, "doc_id", "ids"), work, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again, and both
    digested where they are made, so that neither ids nor texts are shuffled or written."""
    maker = codec_maker(docs.sparkSession, path)

    def work():
        codec = maker()
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

        def each(part):
            counts, ids_sha, text_sha = [], [], []
            for text in part.column(1).to_pylist():
                ids = codec.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(codec.text.__getitem__, ids))))
                text_sha.append(sha(codec.decode(ids)))
            return {"doc_id": part.column(0), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return each

    return map_slices(pick(docs, "doc_id", "text"), work,
                      "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
