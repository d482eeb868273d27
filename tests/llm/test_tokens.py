"""Token files and packing against the tokenizers library on every document."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postloom.llm.packing import best_fit, pack_documents, sequences
from postloom.llm.tokenfiles import read_token_files, token_offsets, write_token_files
from postloom.llm.tokens import TextEncoder, load_definition

DEFINITION = load_definition()
PLAIN = Tokenizer.from_str(DEFINITION)
ENCODER = TextEncoder(DEFINITION, 2)


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é日1.'s\n\t\x1c\x85　 <|_😀"), max_size=60), max_size=5))
def test_pieces_give_the_ids_of_the_text(texts):
    ids, bounds = ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == list(map(ids_of, texts))


def test_token_files_round_trip(spark, tmp_path):
    write_token_files(frame(spark), str(tmp_path / "ids"))
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    found = sorted(map(tuple, token_offsets(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    start = 0
    for row, (doc_id, at, n, check) in zip(data, found, strict=True):
        want = ids_of(row[1])
        assert (doc_id, at, n) == (row[0], start, len(want))
        start += n
    assert sorted(f[3] for f in found) == sorted(crc(ids_of(r[1])) for r in data)


def test_token_files_selective_read(spark, tmp_path):
    path = str(tmp_path / "ids")
    write_token_files(frame(spark), path, page_rows=2)
    some = read_token_files(spark, path, doc_ids=[4, 7]).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {4: ids_of("\n\n"), 7: ids_of("One")}
    plan = read_token_files(spark, path, with_ids=False)._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_token_files_of_nothing(spark, tmp_path):
    write_token_files(empty(spark), str(tmp_path / "none"))
    assert token_offsets(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_best_fit_places_every_rank_once(counts):
    moves = best_fit(counts, 64)
    used, ranks = {}, {k: [] for k in counts}
    for length, rank, n, sequence, offset in moves:
        for i in range(n):
            ranks[length].append(rank + i)
            assert used.get(sequence + i, 0) == offset
            used[sequence + i] = offset + length
    assert all(sorted(ranks[k]) == list(range(n)) for k, n in counts.items())
    assert all(u <= 64 for u in used.values())
    # As many sequences as best fit one document at a time.
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 64) - length)
    assert len(used) == len(gaps)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, capacity):
    packed = pack_documents(frame(spark), capacity=capacity, with_ids=True).cache()
    found = packed.collect()
    whole = {}
    for r in found:
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= capacity
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(ids_of(r[1])) for r in rows())
    assert sum(r["length"] for r in found) == total and len(whole) <= total / capacity * 1.1 + 2
    for doc_id, text in {r[0]: r[1] for r in rows() if r[0] not in (None, 500)}.items():
        pieces = sorted((r for r in found if r["id"] == doc_id), key=lambda r: r["piece"])
        assert [i for p in pieces for i in p["ids"]] == ids_of(text)
        assert all(p["length"] == capacity for p in pieces[1:]) and pieces[0]["start"] == 0
    assert sum(len(r["ids"]) for r in sequences(packed).collect()) == total


def test_packing_nothing(spark):
    assert pack_documents(empty(spark)).count() == 0
