"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

The model. A rank file lists byte strings with their ranks. Each byte becomes one letter (the printable ones stand for
themselves, the others for letters from U+0100 on), so a token becomes a piece of letters. The model is a BPE model
with one normal piece for each token, its score the negative rank, plus the unknown piece that the library asks for,
under a name that no token can have; its normalisation is the identity: no prefix, no white space removed or escaped.
Both libraries merge the neighbours whose joined piece has the best rank, leftmost first, so ids agree; a pre-token
that is a token itself is that token, as the rank library has it. ``model_bytes`` writes the messages of the model file.

Encoding. A text is cut by the pattern and every pre-token encoded alone, each distinct one of a run of texts once. The
usual pattern (``PATTERN``) is cut with numpy from the classes of the characters: a change of class starts a pre-token, a
blank goes with what follows it, the last of several white-space characters stands apart from those before it, and an
apostrophe that starts a pre-token takes the ending of a contraction. Any other pattern is left to the pattern library.

Letters and numbers. The pattern library may know a newer Unicode than the rank library: letters that only the former
knows would be cut otherwise. Characters that Python's own tables lack are probed with the rank library, and those
that it takes for neither letter nor number count as symbols.

Decoding. A token's bytes come from its piece by the inverse of the letters; a document's are joined and returned as
bytes, so cut characters survive.

Null and empty texts have no ids and decode to nothing. Repeated rows and null document ids give one row each; other
columns, whatever their names, are not read. An empty table gives no rows. There is no shuffle: each row is encoded
and decoded where it is read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.runs import Runs, gathered
from tapeloom.llm.tables import documents, prepare
from tapeloom.llm.text import chunks
from tapeloom.llm.vocab import byte_letters

#: Bytes of ids that a worker keeps, and bytes of text cut at once.
KEPT, CHUNK = 24 << 20, 1 << 19
# The pattern, and the endings of contractions in it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Classes of characters.
SYMBOL, SPACE, LETTER, NUMBER = 0, 1, 2, 3
#: Name of the unknown piece: U+2581 stands for no byte.
UNKNOWN = "▁unknown"

LETTERS = byte_letters()
BYTES = {ord(c): b for b, c in LETTERS.items()}

# Fixed values of the model file's format: kinds of pieces and of models.
NORMAL_KIND, UNKNOWN_KIND, BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | str | bytes | bool) -> bytes:
    """One field of a message: integers as varints, floats in four bytes, anything else with its length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def piece_of(token: bytes) -> str:
    return token.decode("latin-1").translate(LETTERS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The model file of a rank table; piece k is the token of the k-th smallest rank, the unknown piece comes last."""
    order = sorted(ranks.items(), key=lambda x: x[1])
    if order and order[-1][1] > 1 << 24:
        raise ValueError("ranks beyond 2**24 are no exact scores")
    piece = lambda text, score, kind: _field(1, _field(1, text) + _field(2, score) + _field(3, kind))
    pieces = [piece(piece_of(token), -float(rank), NORMAL_KIND) for token, rank in order]
    pieces.append(piece(UNKNOWN, -float(1 << 24), UNKNOWN_KIND))
    n = len(order)
    none = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, BPE) + _field(4, n + 1) + _field(35, False) + _field(40, n) + b"".join(_field(k, none) for k in (41, 42, 43)) + _field(45, UNKNOWN)
    normalizer = _field(1, "identity") + b"".join(_field(k, False) for k in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


@functools.cache
def character_classes() -> np.ndarray:
    """The class of every code point, as the rank library has it."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    code = np.frombuffer(every.encode("utf-32-le"), "<u4")
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(name, every):
            out[code[m.start() : m.end()]] = kind
    # with ranks that join a letter or digit and any byte, a pre-token of two characters has no more ids than the second has bytes
    ranks = {bytes([b]): b for b in range(256)} | {bytes([a, b]): 256 + k * 256 + b for k, a in enumerate(b"a1") for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={})
    for c in np.flatnonzero(out > SPACE).tolist():
        if unicodedata.category(chr(c)) == "Cn" and not any(len(probe.encode_ordinary(x + chr(c))) <= len(chr(c).encode()) for x in "a1"):
            out[c] = SYMBOL
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text, and the byte at which each begins, with the end."""
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return code, np.concatenate([[0], np.cumsum(size)])


def usual_starts(code: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of ``PATTERN`` begin in texts laid end to end; ``first`` marks the first character of each text."""
    n = len(code)
    kind = classes[code]
    opens = first.copy()
    opens[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], n)
    inside = np.append(~first[end[:-1]], False)  # another run of the same text follows
    blank = end[(kind[begin] == SPACE) & inside] - 1
    opens[blank] = True
    opens[blank[code[blank] == 0x20] + 1] = False
    mark = begin[(kind[begin] == SYMBOL) & (end - begin == 1) & inside]
    mark = mark[(code[mark] == 0x27) & opens[mark]]
    for ending in ENDINGS:
        size = len(ending)
        at = mark[mark + size < n]
        for k, c in enumerate(ending, 1):
            at = at[(code[at + k] == ord(c)) & ~first[at + k]]
        opens[at + 1] = False
        rest = at[at + size + 1 < n] + size + 1
        # letters that go on after the ending start a pre-token; what else follows has its own start already
        opens[rest[(kind[rest] == LETTER) & ~first[rest]]] = True
    return np.flatnonzero(opens)


class Codec:
    """Encodes and decodes with one serialised model."""

    def __init__(self, model: bytes, ranks: np.ndarray, classes: np.ndarray, pattern: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks, self.classes = ranks, classes
        self.pattern = None if pattern == PATTERN else regex.compile(pattern)
        self.unknown = len(ranks)
        tokens = [self.model.id_to_piece(k).translate(BYTES).encode("latin-1") for k in range(len(ranks))]
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)
        self.runs = Runs(self._pieces, np.dtype("<u4"), KEPT)

    def _pieces(self, pre_tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of pre-tokens: of those that are tokens the token, of others what the model merges."""
        pieces = list(map(piece_of, pre_tokens))
        found = self.model.piece_to_id(pieces)
        rest = [p for p, i in zip(pieces, found, strict=True) if i == self.unknown]
        merged = iter(self.model.encode(rest, out_type=int, num_threads=1))
        ids = [next(merged) if i == self.unknown else [i] for i in found]
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
        if (flat == self.unknown).any():
            raise ValueError("the rank file lacks a byte of the text")
        ranks = self.ranks[flat]
        ends = [0, *itertools.accumulate(map(len, ids))]
        return [ranks[a:b] for a, b in itertools.pairwise(ends)]

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.pattern is None:
            code, place = code_points(data)
            first = np.zeros(len(code), bool)
            first[np.searchsorted(place, at[:-1][np.diff(at) > 0])] = True
            begin = place[usual_starts(code, first, self.classes)]
            return begin, np.append(begin[1:], len(data))
        begin, end = [], []
        for a, b in itertools.pairwise(at.tolist()):
            text = data[a:b].tobytes().decode()
            place = code_points(data[a:b])[1] + a
            spans = np.array([m.span() for m in self.pattern.finditer(text)], np.int64).reshape(-1, 2)
            begin.append(place[spans[:, 0]])
            end.append(place[spans[:, 1]])
        return np.concatenate(begin), np.concatenate(end)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's begin, with the end."""
        flat, ends = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for _, data, at in chunks(texts, CHUNK):
            if not len(data):
                ends.append(np.full(len(at) - 1, ends[-1][-1]))
                continue
            begin, end = self._cut(data, at)
            ids, size = self.runs(data, begin, end)
            total = np.concatenate([[0], np.cumsum(size)])
            ends.append(ends[-1][-1] + total[np.searchsorted(begin, at[1:])])
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(ends)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin, with the end."""
        at = np.minimum(np.searchsorted(self.ranks, ids), len(self.ranks) - 1)
        if (self.ranks[at] != ids).any():
            raise ValueError("an id is not in the vocabulary")
        size = self.size[at]
        return gathered(self.bytes, self.start[at], size), np.concatenate([[0], np.cumsum(size)])


@functools.lru_cache(maxsize=2)
def _codec(key: str, model: bytes, ranks: bytes, classes: bytes, pattern: str) -> Codec:
    return Codec(zlib.decompress(model), np.frombuffer(ranks, "<u4"), np.frombuffer(zlib.decompress(classes), np.uint8), pattern)


class Vocabulary:
    """What the tasks need: the serialised model, the ranks by piece and the classes of the code points (about 1 MB)."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.model, self.ranks = zlib.compress(model_bytes(ranks)), np.array(sorted(ranks.values()), "<u4").tobytes()
        self.classes, self.pattern = zlib.compress(character_classes().tobytes()), pattern
        self.key = hashlib.sha256(self.model + self.ranks + pattern.encode()).hexdigest()

    def codec(self) -> Codec:
        """One for each Python worker and vocabulary."""
        return _codec(self.key, self.model, self.ranks, self.classes, self.pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers)."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(Vocabulary(path, pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value.codec()
        for batch in batches:
            ids, at = codec.encode(batch.column(1))
            parts = pa.array([ids[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(np.diff(at)), parts], names=["doc_id", "n_tokens", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``encoded`` and ``decoded`` (binary): the bytes of its ids."""
    sent = prepare(encoded.sparkSession).sparkContext.broadcast(Vocabulary(path, pattern))
    spot = encoded.columns.index("ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value.codec()
        for batch in batches:
            out = []
            for _, data, at in chunks(batch.column(spot), CHUNK):
                flat, place = codec.decode(np.frombuffer(data, "<u4"))
                out += [flat[a:b].tobytes() for a, b in itertools.pairwise(place[at // 4].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decode, f"{kinds}, decoded binary")


def bpe_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of what they decode to."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    made = decode_documents(encode_documents(docs, path, pattern), path, pattern)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
