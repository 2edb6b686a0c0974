"""Vector codes against plain whole-number arithmetic, on awkward rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from kinloom.llm import codes

INF, NAN = math.inf, math.nan


def _vectors(n, width, seed):
    draw = random.Random(seed)
    return [[float(np.float32(draw.gauss(0, 0.3))) for _ in range(width)] for _ in range(n)]


def _plain(rows, entries, rounds):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 4)) * 4
    whole = [(i, [math.floor(1024 * x) for x in v] + [0] * (width - len(v)), label) for i, v, label in kept]
    w = width // 4
    piece = lambda v, k: v[k * w : (k + 1) * w]
    order = sorted(whole, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[piece(v, k) for _, v, _ in order] for k in range(4)]
    apart = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, k: min((apart(x, c), e) for e, c in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(4):
            groups = collections.defaultdict(list)
            for _, v, _ in whole:
                groups[near(piece(v, k), k)[1]].append(piece(v, k))
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[k])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    coded = [(i, [near(piece(v, k), k) for k in range(4)], label) for i, v, label in whole]
    sums = collections.Counter()
    for _, found, label in coded:
        sums[label] += sum(d for d, _ in found)
    return sorted(((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), sums[label], sha) for i, found, label in coded), key=repr)


def _rows():
    v = _vectors(60, 8, 1)
    rows = [(i, x, i % 3 if i % 7 else None) for i, x in enumerate(v)]
    rows += [(5, v[5], 2), (5, v[6], 2), (None, v[7], None), (100, v[0], 1), (101, v[0], 1), (102, [0.0] * 8, 1), (103, [-0.0001] * 8, 1)]
    rows += [(200, None, 1), (201, [*v[0][:7], None], 1), (202, [*v[0][:7], NAN], 1), (203, [*v[0][:7], INF], 0), (204, [*v[0][:7], -INF], 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def _table(spark, rows, schema=SCHEMA, parts=5):
    return spark.createDataFrame([(i, v, label, "clash", "x") for i, v, label in rows], schema).repartition(parts)


@pytest.mark.parametrize(("entries", "rounds"), [(16, 4), (256, 4), (1, 2), (16, 0)])
def test_against_plain_arithmetic(spark, entries, rounds):
    rows = _rows()
    got = sorted(map(tuple, codes.compress(_table(spark, rows), entries=entries, rounds=rounds).collect()), key=repr)
    assert got == _plain(rows, entries, rounds)


def test_label_sums_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    rows = _rows()
    assert sorted(map(tuple, codes.compress(_table(spark, rows), entries=16).collect()), key=repr) == _plain(rows, 16, 4)


def test_pieces_and_batches(spark, monkeypatch):
    """Vectors over several pieces and tasks."""
    monkeypatch.setattr(codes, "ROWS", 7)
    rows = [(i, v, 0) for i, v in enumerate(_vectors(150, 16, 2))]
    assert sorted(map(tuple, codes.compress(_table(spark, rows, parts=3), entries=20).collect()), key=repr) == _plain(rows, 20, 4)


def test_widths(spark):
    """Shorter vectors are followed by zeros; a width that four does not divide is filled up."""
    v = _vectors(20, 6, 3)
    rows = [(i, x[: 3 + i % 4], None) for i, x in enumerate(v)] + [(50, [], 1)]
    assert sorted(map(tuple, codes.compress(_table(spark, rows), entries=5).collect()), key=repr) == _plain(rows, 5, 4)
    assert len(codes.compress(_table(spark, [(1, [], None)])).collect()) == 1


def test_nothing_kept(spark):
    empty = codes.compress(_table(spark, [(1, None, 1), (2, [NAN] * 4, 1)]))
    assert empty.collect() == [] and empty.columns == codes.compress(_table(spark, _rows())).columns
    assert codes.compress(_table(spark, _rows()).where("false")).count() == 0


def test_huge_components(spark):
    """They count as the bound, and distances stay exact."""
    rows = [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [0.5] * 8, 0)]
    top = codes.bound(8)
    out = {r.vec_id: r for r in codes.compress(_table(spark, rows, SCHEMA.replace("float", "double")), entries=1, rounds=0).collect()}
    assert [out[i].error for i in (1, 2, 3)] == [0, 8 * (2 * top) ** 2, 8 * (top - 512) ** 2]
    assert out[1].label_error == out[2].error + out[3].error


def test_decode(spark):
    whole = codes.whole_vectors(_table(spark, _rows()), "vec_id", "embedding", "label")
    books = codes.train(whole, 256, 1)
    coded = codes.encode(whole, books)
    by = {r.vec_id: r.v for r in whole.collect()}
    seen = codes.decode(coded, books).collect()
    assert len(seen) == whole.count()
    assert all(sum((a - b) ** 2 for a, b in zip(r.v, by[r.vec_id])) == r.error for r in seen if r.vec_id not in (None, 5))
