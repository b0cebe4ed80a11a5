"""Byte-level BPE by a sentencepiece model that is made from a rank vocabulary.

The driver reads the rank file (one base64 token and its rank a line), checks its size, and writes a
sentencepiece BPE model from it: every token becomes a piece of one letter per byte (`LETTERS`), scored by its
negative rank, so that the merge of the lowest rank has the highest score; normalisation is the identity, and
white space has no meaning in it.  The model (some MB, refused above `MAX_MODEL_BYTES`) is broadcast.  A task
cuts the text into pre-tokens by the vocabulary's pattern, lets sentencepiece encode the ones it has not seen
lately, and decodes by the inverse mapping from piece to bytes.  The library sees one pre-token at a time: no
merge crosses a pre-token, as in the vocabulary's own encoder.  A pre-token that is a token is that token.

Ids are ranks.  Null text counts as empty: no ids, empty decoded bytes, the digests of nothing.  Repeated rows
(and a null doc_id) give their rows again; of extra columns none is read.  A very long text costs one list of
its pre-tokens and ids.  Equal ranks and holes below the vocabulary's 256 single bytes are refused.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from duelgrid.llm.common import map_slices, pick

#: One letter per byte; none of them is a space or a control character.
LETTERS = [chr(0x100 + b) for b in range(256)]
TO_LETTERS = dict(enumerate(LETTERS))
#: A rank file or model above this size is refused, as it is broadcast.
MAX_MODEL_BYTES = 64 << 20
#: Pre-tokens remembered per generation and worker; two generations are held, and longer ones are not.
CACHE, LONGEST_REMEMBERED = 200_000, 64
UNKNOWN = "<unk>"
ENCODERS: dict[bytes, PieceCodec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file, by rank; complete in its single bytes and without equal ranks."""
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if len(set(ranks.values())) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} repeats a rank or lacks a single byte")
    return ranks


def spelled(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_LETTERS)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model file: pieces in the order of their ids, then the unknown piece it must have."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    for i, token in enumerate(by_rank):
        model.pieces.add(piece=spelled(token), score=-float(i))
    model.pieces.add(piece=UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(by_rank) + 1
    model.trainer_spec.unk_id = len(by_rank)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    for spec in (model.normalizer_spec, model.denormalizer_spec):
        spec.name = "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    return model.SerializeToString()


@lru_cache(maxsize=4)
def other_classes() -> dict[int, str]:
    """Characters that the Unicode tables of the vocabulary's own library put into another class (letter, number,
    space, else) than those of the `regex` module do, with a character of the class that is meant."""
    import tiktoken

    points = "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    theirs, ours = dict.fromkeys(points, "!"), dict.fromkeys(points, "!")
    for stand_in, kind in (("x", r"\p{L}"), ("0", r"\p{N}"), (" ", r"\s")):
        kept = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs |= dict.fromkeys(bytes(kept.encode_ordinary(points)).decode(), stand_in)
        ours |= dict.fromkeys(regex.findall(kind, points), stand_in)
    return {ord(c): theirs[c] for c in points if theirs[c] != ours[c]}


class PieceCodec(dict):
    """Encoder and decoder of one model; as a dict, the packed ids of the pre-tokens seen lately."""

    def __init__(self, model: bytes, by_id: list[int], pattern: str, odd: dict[int, str], limit: int = CACHE):
        import sentencepiece

        super().__init__()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_id, self.limit, self.old = by_id, limit, {}
        self.odd, self.find = odd, regex.compile(pattern)
        byte_of = {ord(letter): chr(b) for b, letter in enumerate(LETTERS)}
        names = self.pieces.id_to_piece(list(range(len(by_id))))
        self.bytes = {rank: name.translate(byte_of).encode("latin-1") for rank, name in zip(by_id, names)}
        self.whole = {token: array("i", [rank]).tobytes() for rank, token in self.bytes.items()}
        self.text = {rank: str(rank) for rank in by_id}

    def __missing__(self, word: str) -> bytes:
        """The ids of a pre-token of the text, packed."""
        found = self.old.get(word)
        if found is None:
            raw = word.encode()
            found = self.whole.get(raw)
            if found is None:
                ids = self.pieces.encode(raw.decode("latin-1").translate(TO_LETTERS))
                found = array("i", map(self.by_id.__getitem__, ids)).tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def pre_tokens(self, text: str) -> list[str]:
        if self.odd and not text.isascii() and not self.odd.keys().isdisjoint(map(ord, set(text))):
            return [text[m.start():m.end()] for m in self.find.finditer(text.translate(self.odd))]
        return [m.group() for m in self.find.finditer(text)] if self.find.groups else self.find.findall(text)

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join(map(self.__getitem__, self.pre_tokens(text)))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def codec_of(spark: SparkSession, path: str, pattern: str):
    """Serialises the model on the driver and broadcasts it; returns what tasks get their codec from."""
    ranks = read_ranks(path)
    model = serialise(ranks)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the model of {path} is larger than {MAX_MODEL_BYTES} bytes")
    name = hashlib.sha256(model + pattern.encode()).digest()
    sent = spark.sparkContext.broadcast((model, sorted(ranks.values()), pattern, other_classes()))

    def codec() -> PieceCodec:
        if name not in ENCODERS:  # one per worker process, so that pre-tokens stay remembered over its tasks
            ENCODERS.clear()
            ENCODERS[name] = PieceCodec(*sent.value)
        return ENCODERS[name]

    return codec


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: every whole text as token ids."""
    maker = codec_of(docs.sparkSession, path, pattern)

    def work():
        codec = maker()
        return lambda part: {"doc_id": part.column(0), "ids": [codec.encode(t or "") for t in part.column(1).to_pylist()]}

    return map_slices(pick(docs, "doc_id", "text"), work, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw binary: the bytes that the ids spell (null ids: none)."""
    maker = codec_of(encoded.sparkSession, path, pattern)

    def work():
        codec = maker()
        return lambda part: {"doc_id": part.column(0), "raw": [codec.decode(i or []) for i in part.column(1).to_pylist()]}

    return map_slices(pick(encoded, "doc_id", "ids"), work, "doc_id bigint, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again, and both digested
    in the task that made them, so that nothing is shuffled and neither ids nor texts are written."""
    maker = codec_of(docs.sparkSession, path, pattern)

    def work():
        codec = maker()

        def each(part):
            made = {"doc_id": part.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in part.column(1).to_pylist():
                ids = codec.encode(text or "")
                made["n_tokens"].append(len(ids))
                made["ids_sha256"].append(hashlib.sha256(",".join(map(codec.text.__getitem__, ids)).encode()).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return made

        return each

    return map_slices(pick(docs, "doc_id", "text"), work,
                      "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
