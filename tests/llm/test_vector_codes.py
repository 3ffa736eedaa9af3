"""Vector codes against plain Lloyd over integers: ties, nulls, other lengths, few rows, and bounds that save work."""

import collections
import hashlib

import numpy as np
import pytest

from tallyloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, q string, own long, error string, low long, id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "", 1, "", 2, 3) for r in rows], SCHEMA).repartition(3)


def brute(rows, parts=16, k=64, rounds=2):
    """{(vec_id, label, code, error): count}, codebook digest."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(np.float32(x)) for x in r[1])]
    ints = lambda r: [int(np.clip(np.floor(np.float64(np.float32(x)) * 256), -vc.GREATEST, vc.GREATEST)) for x in r[1]]
    ok = sorted(((r[0] is None, r[0] or 0, ints(r), r) for r in ok), key=lambda x: x[:3])
    dim = len(ok[0][2])
    ok = [x for x in ok if len(x[2]) == dim]
    width = -(-dim // parts)
    x = np.zeros((len(ok), parts * width), np.int64)
    x[:, :dim] = np.array([o[2] for o in ok]).reshape(len(ok), dim)
    x = x.reshape(len(ok), parts, width)
    book = x[:k].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - book[None]) ** 2).sum(3)
        own = d.argmin(1)
        if turn < rounds:
            for p in range(parts):
                for e in range(len(book)):
                    of = x[own[:, p] == e, p]
                    if len(of):
                        book[e, p] = of.sum(0) // len(of)
    error = d.min(1).sum(1)
    rows = collections.Counter((o[3][0], o[3][2], "".join("%02x" % e for e in own[i]), int(error[i])) for i, o in enumerate(ok))
    return rows, hashlib.sha256(",".join(str(v) for p in range(parts) for e in range(len(book)) for v in book[e, p]).encode()).hexdigest()


def check(spark, rows, **options):
    codes, book = vc.quantize(frame(spark, rows), **options)
    got = collections.Counter((r["id"], r["label"], r["code"], r["error"]) for r in codes.collect())
    want, digest = brute(rows, **{{"entries": "k"}.get(a, a): v for a, v in options.items()})
    assert got == want and vc.book_digest(book) == digest


def vectors(seed, n, dim, step=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) if step is None else rng.integers(-2, 3, (n, dim)) * step
    return [(int(i * 3), [float(v) for v in x[i]], int(i % 4) if i % 5 else None) for i in rng.permutation(n)]


def test_against_plain_lloyd(spark):
    check(spark, vectors(1, 400, 64))


def test_ties(spark):
    """Few distinct components: most distances are equal to others."""
    check(spark, vectors(2, 300, 32, step=1 / 256))
    check(spark, vectors(3, 300, 16, step=0.5), rounds=4, entries=30)


def test_odd_rows(spark):
    rows = vectors(4, 120, 32)
    rows += [(1, None, 1), (2, [None] * 32, 1), (4, [float("nan")] * 32, 2), (5, [float("inf")] + [0.0] * 31, 2), (7, [0.0] * 31, 1), (8, [], 1), (10, [1e30] * 32, 1), (11, [-1e30] * 32, None)]
    rows += [(3, [0.5] * 32, 1), (3, [0.25] * 32, 1), (None, [0.1] * 32, None), (None, [0.1] * 32, None), rows[0], rows[0]]
    check(spark, rows)
    check(spark, vectors(5, 20, 32))  # fewer rows than entries
    check(spark, vectors(6, 90, 21))  # parts do not divide the length
    assert vc.quantize(frame(spark, []))[0].count() == 0
    assert vc.quantize(frame(spark, [(1, None, 1)]))[0].count() == 0


def test_label_errors(spark, tmp_path):
    rows = vectors(7, 200, 32) + [(9001, [0.5] * 32, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = vc.op12_vector_codes(spark, str(tmp_path)).collect()
    assert {r["vec_id"]: r["error"] for r in out}.keys() == {r[0] for r in rows} and len(out) == len(rows)
    label, total = {r[0]: r[2] for r in rows}, collections.Counter()
    for r in out:
        total[label[r["vec_id"]]] += r["error"]
    assert all(r["label_error"] == total[label[r["vec_id"]]] for r in out) and total[None] > 0


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(8)
    centres = rng.integers(-3000, 3000, (60, 4))
    x = centres[rng.integers(0, 60, 5000)] + rng.integers(-40, 40, (5000, 4))
    book = centres[None] + rng.integers(-20, 20, (1, 60, 4))
    groups = vc.group_entries(book)
    assert sorted(int(e) for g in groups[0] for e in g) == list(range(60))
    own, low = np.zeros(5000, np.int64), np.zeros((5000, len(groups[0])), np.int64)
    full = 5000 * 60
    for turn in range(4):
        own, d, low, work = vc.nearest(x, book[0], groups[0], own, low)
        every = ((x[:, None] - book[0][None]) ** 2).sum(2)
        assert (own == every.argmin(1)).all() and (d == every.min(1)).all()
        every[np.arange(5000), own] = vc.FAR**2
        for g, of in enumerate(groups[0]):
            assert (low[:, g].astype(float) ** 2 <= every[:, of].min(1)).all()
        if turn:
            assert work < full / 3
        after = book + rng.integers(-6, 7, book.shape)
        low, book = low - vc._drift(book, after, groups)[0], after


def test_roots():
    x = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 - 1, 2**52, (2**27) ** 2 * 16 - 1, 10**15 - 1])
    r = vc.root_down(x)
    assert (r * r <= x).all() and ((r + 1) ** 2 > x).all()
    with pytest.raises(ValueError):
        vc.quantize(None, entries=300)
