"""Small tables with every odd case, and plain forms of what operators compute."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, part string, size string, root string, node string, hashes string, score string"


def words(text):
    return WORD.findall(text or "")


def odd_rows():
    """Nulls, empty and very long texts, ties, copies and near copies."""
    base = " ".join(f"wort{i % 97} und{i % 89}" for i in range(60))
    long = " ".join(f"lang{i}" for i in range(30_000))
    texts = [
        None, "", "   \n\t ", "one", "one two three", "One  two three", base, base, base, base.replace("wort5 ", "anders "), base.upper(), long, long + " end",
        "12345 --- !!!", "\u00e9t\u00e9 na\u00efve \u00a0 nbsp", "<|endoftext|> special's", base + " tail", " ".join(["same"] * 500), None,
    ]
    rows = [(i, t, "de" if i % 3 else None, [None, "", "b", "a"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [(*r, *["x"] * 7) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/documents.parquet")


def shingles(text, n=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, width=5, link=80):
    """doc_id -> smallest doc_id that links reach."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < link * max(len(x), len(y)):
                continue
            same = len(x & y)
            if 100 * same >= link * (len(x) + len(y) - same):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def brute_removed(rows, width=13):
    """doc_id -> kept words; windows that a smaller id also holds are removed."""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = [x for x, g in zip(w, gone) if not g]
    return out
