"""Packing, coding and token files: exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

pytest.importorskip("barline.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from barline.llm import best_fit_packing as bp  # noqa: E402
from barline.llm import simple8b, token_files  # noqa: E402
from barline.llm.common import scratch_path  # noqa: E402
from barline.llm.fast_tokens import CachedEncoder  # noqa: E402

TEXTS = [None, "", " ", "a", "The cat.  Sat\n\non", "x<|endoftext|>y", "don't WE'LL 12.5%", "é É İ! \u00a0z", "word " * 5000, "a", "a"]


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.one_of(hs.integers(0, 3), hs.integers(0, 50_000), hs.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    assert (simple8b.decode(simple8b.encode(v), len(v)) == v).all()


def test_simple8b_escapes_and_density():
    v = np.array([2**60, 1, 2**64 - 1, *[1] * 60], np.uint64)
    assert len(simple8b.encode(v)) == 6
    assert len(simple8b.encode(np.ones(600, np.uint64))) == 10
    with pytest.raises(ValueError):
        simple8b.decode(simple8b.encode(v), 5)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_is_exact(name):
    random.seed(5)
    texts = [t or "" for t in TEXTS] + ["".join(random.choice("ab .,\n'!ÉßİΣé9_ \t<|\u0301\x1c") for _ in range(random.randint(0, 25))) for _ in range(1500)]
    source = public_tokenizers.path(name)
    code, plain = CachedEncoder(source, cache=300), Tokenizer.from_file(source)
    got = [ids[a:b].tolist() for ids, o in code.encode(pa.array(texts)) for a, b in zip(o[:-1], o[1:])]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def docs(spark, texts):
    return spark.createDataFrame([(i * 3 - 5, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 2)], "doc_id bigint, text string, piece string, length int").repartition(3)


def test_token_files(spark):
    source = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch_path(spark, "test-files")
    manifest = token_files.write_token_files(docs(spark, TEXTS), folder, source, 1, file_ids=2000)
    rows = token_files.read_token_files(spark, folder, manifest).collect()
    plain = Tokenizer.from_file(source)
    order = [(None, "null id"), *[(i * 3 - 5, t) for i, t in enumerate(TEXTS)]]
    start, want = 0, []
    for d, t in order:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    got = {r.doc_id: r.ids for r in token_files.read_ids(spark, folder).collect()}
    assert got[-5] == [1] and len(got) == len(order)
    raw = token_files.build_file([1, None], [2, 1], np.array([5, 1, 1], "<u4"))
    assert token_files.open_file(raw)[0] == [1, None]
    with pytest.raises(ValueError):
        token_files.open_file(raw[:-8] + b"x" * 8)
    folder = scratch_path(spark, "test-files")
    none = token_files.write_token_files(docs(spark, TEXTS).where("false"), folder, source, 1)
    assert token_files.read_token_files(spark, folder, none).count() == 0


@settings(max_examples=100, deadline=None)
@given(hs.lists(hs.integers(1, 64), max_size=80))
def test_packing_keeps_every_piece(lengths):
    bins = bp.pack_lengths(np.bincount(lengths, minlength=65), 64)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 64 for b in bins)
    half = [b for b in bins if sum(b) <= 32]
    assert len(half) <= 1


def test_packing_replaces_the_smallest_by_two():
    assert sorted(map(sorted, bp.pack_lengths(np.bincount([60, 30, 25, 14], minlength=101), 100)))[0] != [14]
    assert [60, 15, 25] in bp.pack_lengths(np.bincount([60, 30, 25, 15], minlength=101), 100) or [60, 25, 15] in bp.pack_lengths(np.bincount([60, 30, 25, 15], minlength=101), 100)


def test_pack_query_shape(spark):
    source = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(source)
    packed = bp.pack(bp.token_pieces(docs(spark, TEXTS), source, 0, 256, keep_ids=True), 256)
    rows = packed.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    for i, t in enumerate(TEXTS):
        mine = sorted((r for r in rows if r.doc_id == i * 3 - 5), key=lambda r: r.piece)
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for r in mine for x in r.ids] == ids and [r.start for r in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
        assert all(r.length == 256 for r in mine[1:])
    assert len(by) <= -(-sum(r.length for r in rows) // 256) + 1
    assert {len(r.ids) for r in bp.sequences(packed).collect()} == {sum(n for _, n in p) for p in by.values()}
    assert bp.pack(bp.token_pieces(docs(spark, TEXTS).where("false"), source, 0, 256), 256).count() == 0
