"""SimHash components against brute force, and the code's promises."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from weft.llm import simhash

from .common import SCHEMA, documents, none, odd, odd_rows, words

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component_id) of each row, sorted."""
    found = [(i, brute_fingerprint(t)) for i, t in rows]
    nodes = sorted({f for _, f in found})
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(nodes):
        for b in nodes[n + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for i, f in found:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in found), key=repr)


def ran(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert ran(simhash.op11_simhash(spark, SF)) == brute(rows)


def test_odd_rows(spark):
    assert ran(simhash.near_components(odd(spark))) == brute([r[:2] for r in odd_rows()])
    assert ran(simhash.near_components(none(spark))) == []


def test_null_and_repeated_ids(spark):
    rows = [(None, None), (None, "a b c"), (2**53 + 1, "a b c"), (2**53 + 3, "A  b\tc"), (7, "x y z"), (7, "x y z"), (7, "other words"), (None, "nobody has this")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    assert ran(simhash.near_components(df)) == brute(rows)


def test_spans_are_xxh64():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(3000)) + bytes(8)
    first, size = np.array([rnd.randrange(2900) for _ in range(2000)]), np.array([rnd.randrange(60) for _ in range(2000)])
    got = simhash.xxh64_spans(np.frombuffer(data, np.uint8).copy(), first, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(first, size)]


def test_long_texts_and_words():
    texts = ["w" * 5000 + " x y", "b " * 1000, " ".join(f"q{i % 700}" for i in range(300_000)), None, "", "Été A"]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]


def test_the_code_is_perfect():
    """Every word has exactly one codeword within three bits, and one or six keys."""
    code = simhash._CODE
    word = np.arange(1 << 23)
    assert np.bitwise_count(code.leader[code.syndrome(word)]).max() == 3
    assert len(np.unique(code.leader)) == 2048
    at, _ = code.indices(np.arange(1 << 16))
    assert set(np.bincount(at)) == {1, 6}


def near_fingerprints(count, seed):
    """Random fingerprints, and one up to two bits from each."""
    rnd = random.Random(seed)
    pairs = []
    for _ in range(count):
        x = y = rnd.getrandbits(64)
        for b in rnd.sample(range(64), rnd.randrange(3)):
            y ^= 1 << b
        pairs.append((x, y))
    return pairs


def test_near_fingerprints_share_a_key():
    pairs = np.array(near_fingerprints(4000, 2), np.uint64)
    at, keys = simhash.fuzzy_keys(pairs.ravel())
    held = [set() for _ in range(pairs.size)]
    for i, k in zip(at, keys.tolist()):
        held[i].add(k)
    assert max(map(len, held)) == 18
    assert all(held[2 * i] & held[2 * i + 1] for i in range(len(pairs)))


def grouped(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("bucket", [1, 3, 1024])
def test_crowded_keys_lose_no_link(spark, bucket):
    """Chains and clouds of fingerprints; keys above the limit take the other way."""
    rnd = random.Random(bucket)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = {x for pair in near_fingerprints(60, 5) for x in pair}
    for _ in range(4):
        x = rnd.getrandbits(64)
        nodes |= {x ^ 1 << a ^ 1 << b for a in range(0, 64, 5) for b in range(0, 64, 7)}
        for _ in range(100):
            x ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            nodes.add(x)
    nodes = sorted(nodes)
    df = spark.createDataFrame([(signed(x),) for x in nodes], "fp long").repartition(3)
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, bucket).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in got if bucket == 1)
    want = [(a, b) for n, a in enumerate(nodes) for b in nodes[n + 1 :] if (a ^ b).bit_count() <= 2]
    assert grouped(got, nodes) == grouped(want, nodes)


def test_clashing_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, "a b c", "n", 3)], "doc_id long, text string, fp string, least long")
    assert ran(simhash.near_components(df)) == brute([(1, "a b c")])
    assert SCHEMA.startswith("doc_id")
