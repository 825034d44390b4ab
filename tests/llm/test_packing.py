import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quorumtab.llm.bpe import vocabulary
from quorumtab.llm.packing import OpenBins, op12_packing, packed, pieces, sequences

SIZE = 4096


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def gapless(rows, size=SIZE):
    """Asserts that each sequence is filled from 0 without gaps, and gives the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def check(rows, docs, library):
    """rows against the tokenizers library: docs is a list of (doc_id, text)."""
    want = [(doc, i, at, len(ids[at : at + SIZE]), zlib.crc32(ids[at : at + SIZE].tobytes())) for doc, text in docs for ids in [ids_of(library, text)] for i, at in enumerate(range(0, len(ids), SIZE))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(key, want))
    return gapless([r.asDict() for r in rows])


def test_whole_table(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op12_packing(spark, sf_dir).collect()
    n = check(rows, docs, library)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // SIZE) + 1


def test_odd_rows(spark, library):
    docs = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 30000), (4, "x" * 20000), (5, "é" * 9000)]
    table = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, TEXT string, length int")
    check(packed(pieces(table, vocabulary())).collect(), docs, library)
    assert packed(pieces(table.limit(0), vocabulary())).collect() == []


def test_rounds_hold_all_pieces_and_fill_sequences(spark):
    rng = random.Random(3)
    lengths = [rng.choice([1, 7, 100, rng.randint(1, 4096), 4096, 3000]) for _ in range(6000)]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id int, length int").repartition(5)
    rows = packed(table, open_bins=16, pieces_a_task=100).collect()
    assert sorted((r.id, r.length) for r in rows) == list(enumerate(lengths))
    offline, closed = OpenBins(SIZE), []  # all at once, longest first
    for n in sorted(lengths, reverse=True):
        closed += offline.put(n, n)
    assert gapless([r.asDict() for r in rows]) <= 1.05 * (len(closed) + len(list(offline.rest())))


def test_equal_rows_are_spread(spark):
    rows = packed(spark.range(5000).selectExpr("7 AS doc_id", "1500 AS length"), pieces_a_task=100).collect()
    assert len(rows) == 5000
    assert gapless([r.asDict() for r in rows]) == 2500


@pytest.mark.parametrize("most", [1, 3, None])
def test_bins_take_the_best_fit_and_close_the_fullest(most):
    """Against a plain list of open bins."""
    rng = random.Random(most or 9)
    lengths = [rng.randint(1, 50) for _ in range(500)]
    fast, plain, closed, want = OpenBins(50, most), [], [], []
    for i, n in enumerate(lengths):
        closed += [[x for x, _ in b] for b in fast.put(i, n)]
        fits = [b for b in plain if b[0] >= n]
        if fits:
            own = min(fits, key=lambda b: b[0])
        else:
            if len(plain) == most:
                out = min(plain, key=lambda b: b[0])
                plain.remove(out)
                want.append(out)
            plain.append(own := [50, []])
        own[0] -= n
        own[1].append(i)
        if not own[0]:
            plain.remove(own)
            want.append(own)
    assert [sum(lengths[i] for i in b) for b in closed] == [50 - b[0] for b in want]
    assert sorted(sum(lengths[i] for i, _ in b) for b in fast.rest()) == sorted(50 - b[0] for b in plain)


def test_sequences_hold_the_ids(spark, library):
    docs = [(i, "some words and more " * (i * i)) for i in range(60)]
    placed = packed(pieces(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary(), ids=True))
    found = {}
    for r in sequences(placed).collect():
        assert len(r.ids) <= SIZE
        for d in r.docs:
            found[d.doc_id, d.piece] = r.ids[d.offset : d.offset + d.length]
    for doc, text in docs:
        assert sum((found[k] for k in sorted(found) if k[0] == doc), []) == ids_of(library, text).tolist()
