"""Token ids by the tokenizers library: each distinct word of a batch is encoded once, in a memory of bounded bytes.

Text is cut at ASCII white space and each piece is encoded alone. This gives the ids of the whole text because the
vocabulary drops white space, its pre-tokeniser never joins characters across it, no special token contains it, and
canonical composition does not reach over it. ``can_split`` checks these properties of a tokenizer file; a
vocabulary without them is applied to whole texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from tapeloom.llm.runs import Runs
from tapeloom.llm.text import chunks, spans

#: Bytes of ids that a worker keeps, and runs of marks whose ids it keeps.
KEPT, TAILS = 24 << 20, 10_000
#: How the vocabulary cuts normalised text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of one run of letters, with marks behind it that no contraction and no special token begins with.
_SIMPLE = re.compile(rb"([A-Za-z]+)([!-&(-/:;=?@\[-`{}~]*)")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def can_split(spec: dict) -> bool:
    """White space is dropped and splits words, as in the files with lower-cased words."""
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": _SPLIT}
        and cut[0]["behavior"] == "Removed"
        and cut[0]["invert"]
        and not any(c.isspace() for x in spec["added_tokens"] for c in x["content"])
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    )


class Encoder:
    """Ids of whole texts, as ``numpy`` arrays of the smallest type that holds the vocabulary."""

    def __init__(self, path: str, end_id: int | None = 1) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.splits = can_split(spec)
        self.tails: dict[bytes, list[int]] = {}
        self.runs = Runs(self._words, self.dtype, KEPT)

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _ids(self, piece: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.decode())]

    def _tail(self, marks: bytes) -> list[int]:
        if marks not in self.tails:
            if len(self.tails) >= TAILS:
                self.tails.clear()
            self.tails[marks] = self._ids(marks)
        return self.tails[marks]

    def _words(self, words: list[bytes]) -> list[np.ndarray]:
        """Simple words by the merges alone, all others in one call of the whole tokenizer."""
        out, rest = [], []
        for k, word in enumerate(words):
            if m := _SIMPLE.fullmatch(word):
                ids = self._ids(m[1].lower())
                out.append(ids + self._tail(m[2]) if m[2] else ids)
            else:
                out.append(None)
                rest.append(k)
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False), strict=True):
            out[k] = found.ids
        ids = np.fromiter(itertools.chain.from_iterable(out), self.dtype)
        ends = [0, *itertools.accumulate(map(len, out))]
        return [ids[a:b] for a, b in itertools.pairwise(ends)]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, with the end id, as bytes."""
        out: list[bytes] = []
        for _, data, at in chunks(texts):
            if not self.splits:
                out += [self._whole(data[a:b].tobytes()) + self.end for a, b in itertools.pairwise(at.tolist())]
                continue
            begin, end = spans(data, at) if len(data) else (at[:0], at[:0])
            ids, size = self.runs(data, begin, end)
            place = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, at)]
            out += [ids[a:b].tobytes() + self.end for a, b in itertools.pairwise(place.tolist())]
        return out

    def encode(self, text: bytes) -> bytes:
        """The ids of one text."""
        return self.encode_all(pa.array([text], pa.binary()))[0]

    def ends_sentence(self) -> np.ndarray:
        """For each id, whether its text ends a sentence."""
        out = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = token.removesuffix("</w>").rstrip("\"')]").endswith((".", "!", "?"))
        return out


@functools.cache
def encoder(path: str, end_id: int | None = 1) -> Encoder:
    """One encoder for each Python worker: what it has encoded lasts over the worker's tasks."""
    return Encoder(path, end_id)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
