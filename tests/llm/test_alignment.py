"""Token alignment against brute force on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from weft.llm import alignment
from weft.llm._words import slices

from .common import documents, none, odd, odd_rows

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """Tokens with their byte ranges from the libraries, whole texts at once."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbol, hidden = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            symbol[chr(b)] = b
        else:
            symbol[chr(256 + hidden)] = b
            hidden += 1

    def spans(tokens):
        at, out = 0, []
        for i, own in tokens:
            out.append((i, at, at + len(own)))
            at += len(own)
        return out

    def piece(text):
        return bytes([int(text[3:5], 16)]) if len(text) == 6 and text.startswith("<0x") else text.replace("▁", " ").encode()

    def tokens(text):
        code = first.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(symbol[c] for c in t)) for i, t in zip(code.ids, code.tokens)]
        ids = second.encode(text)
        b = [(i, piece(second.id_to_piece(i))) for i in ids]
        want = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return None
        return spans(a), spans(b)

    return tokens


def brute(rows, tokens):
    per, held, out = [], Counter(), []
    for i, text in rows:
        found = tokens(text) if text else None
        if found is None:
            per.append((i, None))
            continue
        a, b = found
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in ends:
            groups.append(([t for t, s, e in a if low <= s and e <= high], [t for t, s, e in b if low <= s and e <= high]) if len(a) < 300 else None)
            low = high
        links, j = [], 0
        for t, s, e in a:  # all pairs of overlapping ranges
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((t, b[k][0]))
                k += 1
        if None in groups:
            groups, x, y = [], 0, 0
            for high in ends:
                p, q = [], []
                while x < len(a) and a[x][2] <= high:
                    p.append(a[x][0])
                    x += 1
                while y < len(b) and b[y][2] <= high:
                    q.append(b[y][0])
                    y += 1
                groups.append((p, q))
        held.update(set(links))
        per.append((i, (a, b, groups, links)))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    for i, found in per:
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = found
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def ran(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark, plain):
    assert ran(alignment.op12_token_alignment(spark, SF)) == brute([(r.doc_id, r.text) for r in documents(spark).collect()], plain)


def test_odd_rows(spark, plain):
    more = [(100, "▁ alone"), (101, " "), (102, "  x "), (103, "\x00a"), (None, "the the"), (2**53 + 1, "the the"), (2**53 + 3, None), (None, None), (7, "<s> <0x41> café  x")]
    df = odd(spark).select("doc_id", "text", "root").unionByName(spark.createDataFrame([(i, t, "r") for i, t in more], "doc_id long, text string, root string"))
    assert ran(alignment.align(df)) == brute([r[:2] for r in odd_rows()] + more, plain)
    assert ran(alignment.align(none(spark))) == []


def test_chunks_change_nothing(spark, plain, monkeypatch):
    """One chunk for each slice of a few bytes: sums by pair meet across chunks."""
    rows = [(i, f"the cat {i % 3} sat on the mat " * (1 + i % 4)) for i in range(60)]
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert ran(alignment.align(df)) == brute(rows, plain)


def test_units_equal_whole_texts(plain):
    """Blanks of every kind around letters, marks and special strings."""
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " ", "　", " ", "a", "b", "é", "à", "中", "\U0001f44d", "'s", "'", "12", "<|endoftext|>", "<s>", "<0x41>", ".", "\x00", "\x1c", "\u0085", "word"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    reader = alignment.aligner(*alignment.tokenizer_paths())
    for row, end, data, at in slices(pa.array(texts), 2000):
        numbers, digests, *_ = reader.read(data, at)
        want = {i: w for i, *w in brute(list(enumerate(texts[row:end])), plain)}
        for k in range(end - row):
            assert [*numbers[k][:4], digests[k]] == [*want[k][:4], want[k][6]], texts[row + k]


def test_transducer_closes_groups_on_empty_suffix():
    a, b = [b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc", b""]
    t = alignment.Transducer(a, b)
    assert t.align([0, 1], [0, 1]) == ([(0, 0), (0, 1), (1, 1)], [([0, 1], [0, 1])])
    assert t.align([2, 2], [2, 0, 1]) == ([(2, 2), (2, 0), (2, 1)], [([2], [2]), ([2], [0, 1])])
    assert t.align([0], [0]) is None and t.align([3], [0]) is None and t.align([2], [2, 0]) is None and t.align([2], [3]) is None
    assert t.align([], []) == ([], []) and t.align([], [0]) is None
    assert t.memo[0, b"ab", 0] == (0, b"b")
