"""Byte-level BPE against the rank library, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest_rows import hard_rows, passage
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tapeloom.llm import bytebpe
from tapeloom.llm.runs import Runs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bytebpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bytebpe.Vocabulary(PATH, public_tokenizers.PATTERN).codec()
OTHER_PATTERN = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+"
OTHER = bytebpe.Vocabulary(PATH, OTHER_PATTERN).codec()
OTHER_LIBRARY = tiktoken.Encoding("other", pat_str=OTHER_PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(codec, texts):
    ids, at = codec.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_the_pattern_is_the_public_one():
    assert bytebpe.PATTERN == public_tokenizers.PATTERN


chars = st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(max_codepoint=0x250), st.sampled_from(list("'''stremvl d  \t\n\x1c\x85 aZ09!é日ा՘\U0003134f")))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet=chars, max_size=30), max_size=4))
@example(["'s", "''s", " 's", "a'sa", "'rea 'll", "'LL've'd", "x 'm"])
@example(["  a", "\t a", " \ta", "a  ", "\n\n\nb", "", "'", "'r", "'v"])
def test_ids_are_those_of_the_rank_library(texts):
    got = encoded(CODEC, texts)
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]
    for ids, text in zip(got, texts, strict=True):
        data, place = CODEC.decode(np.array(ids, "<u4"))
        assert data.tobytes() == text.encode() and place[-1] == len(data) and len(place) == len(ids) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=chars, max_size=30), max_size=3))
def test_other_patterns_are_left_to_the_library(texts):
    texts = [t.replace("՘", "").replace("\U0003134f", "") for t in texts]
    if all(not bytebpe.regex.search(r"\p{Cn}", t) for t in texts):
        assert encoded(OTHER, texts) == [OTHER_LIBRARY.encode_ordinary(t) for t in texts]


def test_small_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(bytebpe, "CHUNK", 500)
    texts = [passage(k, 60) + " 'll \t\n日本" for k in range(40)] + [passage(3, 60), "", None, "y" * 3000]
    codec = bytebpe.Vocabulary(PATH, public_tokenizers.PATTERN).codec()
    codec.runs = Runs(codec._pieces, np.dtype("<u4"), 2_000)
    assert encoded(codec, texts) == [LIBRARY.encode_ordinary(t or "") for t in texts]
    assert codec.runs.bytes() < 20_000


def test_pieces_that_share_a_hash_stay_apart(monkeypatch):
    from tapeloom.llm import runs

    def weak(data, begin, end):
        first = (end - begin).astype(np.uint64)
        return first, np.array([hash(data[a:b].tobytes()) & (1 << 63) - 1 for a, b in zip(begin, end, strict=True)], np.uint64)

    monkeypatch.setattr(runs, "piece_hashes", weak)
    codec = bytebpe.Vocabulary(PATH, public_tokenizers.PATTERN).codec()
    codec.runs = Runs(codec._pieces, np.dtype("<u4"), 1 << 20)
    texts = [passage(5, 40), passage(6, 40)]
    assert encoded(codec, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_query_columns(hard, none):
    got = bytebpe.bpe_digest(hard).collect()
    want = []
    for doc_id, text, *_ in hard_rows():
        ids = LIBRARY.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert bytebpe.bpe_digest(none).collect() == []
    assert bytebpe.bpe_digest(hard).dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


def test_a_rank_file_without_all_bytes(tmp_path):
    import base64

    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (b * 3) for b in range(97, 100)))
    codec = bytebpe.Vocabulary(str(path), public_tokenizers.PATTERN).codec()
    assert encoded(codec, ["abcc"]) == [[291, 294, 297, 297]]
    with pytest.raises(ValueError, match="lacks a byte"):
        encoded(codec, ["abz"])
