"""Every operator's query against SQL or a brute-force form, on whole small tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from weft.llm import queries as llm

from .common import documents, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, same_rows, name):
    df = llm.queries()[name](spark, SF)
    same_rows(df, llm.oracle_sql()[name])


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in llm.queries()}) == list(range(1, 14))


def test_language_id_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in documents(spark, "/root/testdata/sf0.01").collect()}
    rows = llm.queries()["op2_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in docs[r.doc_id].text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and docs[r.doc_id].lang is not None:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert total > 50 and right / total >= 0.95


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in llm.queries()["op6_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        ids = tokenizer.encode(docs[i], add_special_tokens=False).ids + [0]
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(k, 2048 * k) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            part = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(part)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for own in pieces.values() for r in own) // 2048)
    assert len(bins) <= least * 1.05 + 1


def test_lm_scores(spark):
    """Base scores and counts are exact; the model is a bigram model of the same
    definition with exact words, up to the grid of its quantised shares."""
    from weft.llm import lmscore

    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    tokens = {i: [*words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in docs.items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    count = Counter(x for t in train for x in t)
    total, kinds = sum(count.values()), len(count)
    p = lambda w: (count[w] + 0.1) / (total + 0.1 * (kinds + 1))
    pair = Counter(x for t in train for x in zip([None, *t[:-1]], t))
    seen = Counter()
    for (a, _), n in pair.items():
        seen[a] += n
    q = {ab: 10 ** -(math.ceil(-math.log10((n - lmscore.DISCOUNT) / seen[ab[0]]) * lmscore.STEPS - 1e-9) / lmscore.STEPS) for ab, n in pair.items()}
    spent = Counter()
    for (a, _), x in q.items():
        spent[a] += x
    rows = llm.queries()["op10_lm_scoring"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(x in count for x in t), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10(p(x)) for x in t), rel_tol=1e-9)
        back = lambda a: 10 ** -(math.ceil(-math.log10(1 - spent[a]) * lmscore.BACKOFF_STEPS - 1e-9) / lmscore.BACKOFF_STEPS) if a in seen else 1
        model = sum(math.log10(q.get((a, b), 0) + back(a) * p(b)) for a, b in zip([None, *t[:-1]], t))
        assert math.isclose(r.score, model, rel_tol=1e-4), (r.doc_id, r.score, model)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than word counts


def test_exact_dedup_digest(spark):
    docs = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    for r in llm.queries()["op5_exact_dedup"](spark, SF).collect():
        assert r.text_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
