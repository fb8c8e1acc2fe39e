"""Encoding, packing and token files against the tokenizers library and exact round trips."""

import struct
import zlib

import numpy as np
import pytest
from conftest_rows import hard_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import packing, tokenfiles
from tapeloom.llm.tables import shared_folder
from tapeloom.llm.vocab import default_path, encoder


def ids_of(text):
    return encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, (row[1] or "").encode())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x180), st.sampled_from(list("ıİΣςé́日😀'  \t\n"))), max_size=40))
def test_words_give_the_ids_of_the_text(text):
    code = encoder(default_path(), None)
    assert np.frombuffer(code.encode(text.encode()), code.dtype).tolist() == ids_of(text)[:-1]


def test_packing_places_every_id_once(hard):
    rows = packing.pack_documents(hard, seq_len=256).collect()
    want = sorted(hard_rows(), key=key)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t, *_ in want)
    for doc_id, text in {(k, t) for k, t, *_ in want if k is not None and [x[0] for x in want].count(k) == 1}:
        ids, at = ids_of(text), 0
        for p in sorted(got[doc_id], key=lambda r: r.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in (sum(p.length for p in own) for own in sequences.values()))
    assert padding < 0.05 * sum(r.length for r in rows)


def test_packing_is_the_cheapest():
    draw = np.random.default_rng(5)
    for _ in range(40):
        n = int(draw.integers(1, 90))
        docs = np.unique(np.append(draw.integers(1, n + 1, 3), n))
        at, price = packing.cut_points(n, docs, draw.integers(1, n + 1, 6))
        cuts = packing.best_cuts(at, price, 40, last=True)
        cost = dict(zip(at.tolist(), price.tolist(), strict=True))
        best = {0: 0}
        for p in at[1:].tolist():
            rest = packing.rest_cost if p == n else lambda r, s: s - r
            best[p] = min(best[q] + rest(p - q, 40) + cost[p] for q in best if p - q <= 40)
        paid, q = 0, 0
        for p in cuts:
            paid += (packing.rest_cost(p - q, 40) if p == n else 40 - (p - q)) + cost[p]
            q = p
        assert cuts[-1] == n and paid == best[n]


def test_packing_in_blocks_equals_a_stream(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 300)
    code = encoder(default_path())
    packer = packing.Packer(64, code.ends_sentence(), code.dtype, 0)
    draw = np.random.default_rng(2)
    docs = [draw.integers(2, 40_000, int(draw.integers(1, 400))).astype(code.dtype) for _ in range(40)]
    out = [b for k, d in enumerate(docs) if (b := packer.add(k, d.tobytes())) is not None]
    out += [b] if (b := packer.pack(last=True)) is not None else []
    at = [0] * len(docs)
    for batch in out:
        for r in batch.to_pylist():
            assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == crc(docs[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist())
            at[r["doc_id"]] += r["length"]
    assert at == [len(d) for d in docs]


def test_token_files_round_trip(spark, hard):
    folder = shared_folder(spark)
    manifest = tokenfiles.write_token_files(hard, folder, default_path(), seq_len=64)
    got = sorted(tokenfiles.read_documents(manifest, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc_id, text, *_) in zip(got, sorted(hard_rows(), key=key), strict=True):
        ids = ids_of(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), crc(ids))
        at += len(ids)
    for row in manifest.collect():
        shard = tokenfiles.Shard(folder, row.tokens_file, row.index_file)
        flat = [i for batch, docs in shard.documents() for views in docs for v in views for i in v.tolist()]
        count = -(-row.n_ids // 64)
        seqs = [shard.sequence(k) for k in range(count)]
        assert [i for ids, mask in seqs for i, m in zip(ids.tolist(), mask.to_pylist(), strict=True) if m] == flat
        assert all(not ids.flags.owndata and len(ids) == 64 for ids, _ in seqs)


@pytest.mark.parametrize("rows", [0])
def test_empty_tables(none, rows):
    assert packing.pack_documents(none).count() == rows and tokenfiles.token_digest(none).count() == rows
