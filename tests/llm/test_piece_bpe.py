import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from duelgrid.llm import piece_bpe
from duelgrid.llm.catalog import op11_piece_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    ranks = piece_bpe.read_ranks(PATH)
    return piece_bpe.PieceCodec(piece_bpe.serialise(ranks), sorted(ranks.values()), P.PATTERN, piece_bpe.other_classes())


def texts():
    rng = random.Random(7)
    points = [*range(0, 0x250), *range(0x370, 0x600), 0x2581, 0xFEFF, 0x3000, 0x85, 0x2028, *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640), 0x10FFFF, 0xE000]
    yield from ("", " ", "\x00\x01 \x7f", "<unk> <s> ▁ ▁▁a", "it's we'll I'D  'S", "a" * 5000, "ab" * 9000 + "  \n\n x", " " * 3000, "́" * 50, "naïve  café\t\r\n12³ ½x")
    for n in (3, 30, 300):
        for _ in range(200):
            yield "".join(map(chr, rng.choices(points, k=n)))


def test_equals_the_library(codec, library):
    for text in texts():
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_character_of_another_class(codec, library):
    for c in piece_bpe.other_classes():
        text = f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b"
        assert codec.encode(text) == library.encode_ordinary(text)


def test_every_token_is_itself(codec, library):
    for rank, token in codec.bytes.items():
        assert library.encode_single_token(token) == rank
        assert codec.decode([rank]) == token


def test_forgetting_pre_tokens_changes_nothing(library):
    ranks = piece_bpe.read_ranks(PATH)
    small = piece_bpe.PieceCodec(piece_bpe.serialise(ranks), sorted(ranks.values()), P.PATTERN, {}, limit=3)
    for text in ("one two three four five six one two", "six five four"):
        assert small.encode(text) == library.encode_ordinary(text)


def test_query_on_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        want[d.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_piece_bpe(spark, sf).collect()}
    assert got == want


def test_odd_rows(odd, clashing, none, rows, library):
    got = rows(piece_bpe.round_trip(odd, PATH, P.PATTERN))
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 8 and (1, 0, nothing, nothing) in got and (None, 0, nothing, nothing) in got
    assert rows(piece_bpe.round_trip(clashing, PATH, P.PATTERN)) == got
    assert rows(piece_bpe.round_trip(none, PATH, P.PATTERN)) == []
    back = piece_bpe.decode(piece_bpe.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted((r.doc_id or 0, bytes(r.raw).decode()) for r in back.collect()) == sorted((d or 0, t or "") for d, t in ((r.doc_id, r.text) for r in odd.collect()))


def test_refused_vocabularies(tmp_path):
    path = tmp_path / "bad.tiktoken"
    path.write_text("IQ== 0\n")
    with pytest.raises(ValueError):
        piece_bpe.read_ranks(str(path))
