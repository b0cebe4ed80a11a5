import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duelgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(json.load(f), bpe.odd_characters()), Tokenizer.from_file(PATH)


TEXTS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" '\nst　\x1c\x85²éß")))) | st.sampled_from(
    ["<|endoftext|>", "a<|endoftext|> b", "don't", "  two  spaces ", "\x1f1²½", "a" * 700])


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_same_ids_as_the_library_and_back(both, text):
    codec, library = both
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.integers(0, 50256) | st.integers(94, 255), max_size=12))
def test_broken_utf8_decodes_like_the_library(both, ids):
    codec, library = both
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_is_split_like_the_library(both):
    codec, library = both
    text = "".join(f"a{chr(c)}1 " for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_words_merge_alike_by_scan_and_by_heap(both):
    codec, _ = both
    rnd = random.Random(5)
    for n in (2, 17, 300, 1500):
        parts = [codec.of_byte[b] for b in "".join(rnd.choices("theandio", k=n)).encode()]
        assert codec.merge(list(parts)) == codec.merge_long(list(parts))


def test_a_small_word_memory_changes_nothing(both):
    with open(PATH, encoding="utf-8") as f:
        small = bpe.Codec(json.load(f), {}, cache=3)
    text = "one two three one four five one two " * 5
    assert small.encode(text) == both[0].encode(text)


def test_round_trip_of_odd_rows(odd, clashing, none, rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, *_ in odd.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert rows(bpe.round_trip(odd, PATH)) == rows(bpe.round_trip(clashing, PATH)) == sorted(want, key=repr)
    assert bpe.round_trip(none, PATH).collect() == []


def test_encode_then_decode_gives_the_text(odd, rows):
    assert rows(bpe.decode(bpe.encode(odd, PATH), PATH)) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)


def test_a_large_vocabulary_is_refused(odd, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.round_trip(odd, PATH)
