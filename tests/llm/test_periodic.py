"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from weft.llm import periodic

from .common import documents, none, odd, odd_rows, words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - (fail[-1] if w else 0)


def brute_runs(w, least=24, times=3):
    """Every stretch that repeats at distance q, for every q, if q is its smallest period."""
    x, out = np.array([hash(a) for a in w], np.int64), []
    for q in range(1, len(w) // times + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])))
        for a, b in zip(same[::2], same[1::2]):
            n = int(b - a) + q
            if n >= max(least, times * q) and smallest_period(w[a : a + n]) == q:
                out.append((int(a), n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(rows):
    out = []
    for i, text in rows:
        w = words(text)
        n, h = len(w), zlib.crc32(("" if i is None else str(i)).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w)
        kept = [True] * n
        for s, m, q in found:
            kept[s + q : s + m] = [False] * (m - q)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        out.append((
            i, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for x, k in zip(w, kept) if k).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def ran(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 10
    assert ran(periodic.op13_periodic_runs(spark, SF)) == want


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows() if len(r[1] or "") < 100_000]  # brute force tries every period
    more = [(None, "a b " * 40), (None, None), (2**53 + 1, "x " * 24), (2**53 + 3, "x " * 23), (5, "p q r " * 8 + "p"), (5, "p q r " * 8 + "p"), (21, "a " * 30 + "b " * 30), (20, "")]
    df = odd(spark).where("text is null or length(text) < 100000").select("doc_id", "text", "part")
    df = df.unionByName(spark.createDataFrame([(i, t, "r") for i, t in more], "doc_id long, text string, part string"))
    assert ran(periodic.periodic_runs(df, repeats=periodic.crc_repeats)) == brute(rows + more)
    assert ran(periodic.periodic_runs(none(spark))) == []


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
@pytest.mark.parametrize("least, times", [(24, 3), (1, 2), (7, 2), (10, 4)])
def test_all_runs_of_random_sequences(letters, least, times):
    rnd = random.Random(letters * 100 + least)
    for _ in range(60):
        w = []
        while len(w) < rnd.choice([1, 10, 60, 200]):
            part = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 9))]
            w += part * rnd.choice([1, 1, 2, 3, 9])
        x = np.array([letters, *w, letters + 1])
        s, n, p = periodic.find_runs(x, least, times)
        assert list(zip((s - 1).tolist(), n.tolist(), p.tolist())) == brute_runs(w, least, times)


def test_fibonacci_and_long_runs():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    w = [ord(c) for c in b]
    s, n, p = periodic.find_runs(np.array([0, *w, 1]), 1, 2)
    assert list(zip((s - 1).tolist(), n.tolist(), p.tolist())) == brute_runs(w, 1, 2)
    x = np.array([9, *[1, 2, 3] * 100_000, 8])
    assert [c.tolist() for c in periodic.find_runs(x)] == [[1], [300_000], [3]]


def test_suffix_array_and_lcp():
    rnd = np.random.default_rng(1)
    for letters in (1, 2, 4):
        x = np.append(rnd.integers(0, letters, 300), letters)
        order, rank, lcp = periodic.suffix_array(x)
        t = x.tolist()
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want and rank[order].tolist() == list(range(len(t)))
        for k in range(1, len(t)):
            i, j, n = want[k - 1], want[k], 0
            while max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            assert lcp[k] == n
