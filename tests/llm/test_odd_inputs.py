"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import json
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import alignment, eliasfano, exactdedup, jaccardjoin, langid, lmscore, mixing, packing, periodic, simhash, substrings, topk, urlfilter, warc
from weft.llm._spark import shared_dir

from .common import SCHEMA, brute_components, brute_removed, none, odd, odd_rows, words

TEXTS = {r[0]: r[1] for r in odd_rows()}


# --- top-k ---


def brute_topk(vectors, k=20):
    valid = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in valid if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(valid[q], v)), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("spread", [1, 40])  # ties and copies everywhere, or few
def test_topk(spark, spread):
    rnd = random.Random(spread)
    rows = [(i, [rnd.randint(-spread, spread) / 64 for _ in range(8)]) for i in range(300)]
    rows += [(400, None), (420, [None] * 8), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, []), (500, [1.0, 2.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {tuple(r) for r in topk.search(v, v.where("vec_id % 20 = 0")).collect()}
    assert got == brute_topk(rows)


def test_topk_bounds_drop_outsiders_only():
    rng = np.random.default_rng(3)
    vectors, ids = rng.normal(0, 40, (2000, 16)).astype(np.int64), np.arange(2000)
    lists = topk.SortedLists(ids, vectors, 5)
    floor = np.full(7, -np.inf)
    row, col, score = lists.search(vectors[:7], 5, floor)
    exact = vectors[:7] @ lists.vectors.T
    for q in range(7):
        best = np.sort(exact[q])[::-1][:5]
        assert set(best) <= set(score[row == q])


def test_topk_reads_no_further_than_it_must():
    """One component outweighs the rest: reading stops early, and cells are counted."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (4000, 12))
    vectors[:, 0] = rng.integers(-1000, 1001, 4000)
    lists = topk.SortedLists(np.arange(4000), vectors, 5)
    queries = np.tile(np.array([[50] + [1] * 11]), (3, 1))
    row, col, score = lists.search(queries, 5, np.full(3, -np.inf))
    assert lists.cells == 3 * len(lists.vectors) * 12 and lists.cells_read <= 0.15 * lists.cells
    assert sorted(score[row == 1])[-5:] == sorted(vectors @ queries[0])[-5:]


def test_topk_huge_components(spark):
    """Beyond the range of long a component counts as its end; scores are clamped."""
    rows = [(0, [1e30, 1.0]), (20, [-1e30, 1.0]), (3, [3e17, 0.0]), (4, [0.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in topk.search(v, v.where("vec_id = 0")).collect()}
    assert got == {(0, 20): -(2**63), (0, 3): 2**63 - 1, (0, 4): 4096}


def test_topk_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r.vec_id, r.score) for r in topk.search(v, v.where("vec_id = 0")).collect()) == [(1, 4096), (1, 4096)]


def test_topk_empty(spark):
    v = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(v, v).count() == 0


# --- language ID ---


def test_suffix_automaton_parses_greedily():
    text, labelled = "abracadabra", "cadabrab"
    auto = langid.SuffixAutomaton(labelled)
    count = at = 0
    while at < len(text):
        n = max((n for n in range(len(text) - at + 1) if text[at : at + n] in labelled), default=0)
        at, count = at + max(1, n), count + 1
    assert auto.phrases(text) == count


def test_vector_parse_equals_the_automaton():
    samples = {"x": "the cat sat on the mat ", "y": "le chat est sur le tapis "}
    parser = langid.CrossParser(samples)
    rnd = random.Random(2)
    long = "".join(rnd.choice("the cat sat onm lur") for _ in range(12_000))
    for text in (long, "x" * 3000, "the cat sat on the mat " * 100, "the mat sat", "sur le mat", "zzz the", "\u00e9t\u00e9 chat"):
        rates, size = parser.rates([text])
        plain = langid.normalise(text) + " "
        for k, name in enumerate(parser.languages):
            assert round(rates[k, 0] * size[0]) == langid.SuffixAutomaton(samples[name]).phrases(plain)


def test_parse_with_listed_transitions(monkeypatch):
    """More symbols than a table has columns: the rest is looked up, alike."""
    rnd = random.Random(3)
    chars = [chr(0x4E00 + k) for k in range(900)]
    text = lambda n: "".join(rnd.choice(chars) for _ in range(n))
    samples = {"zh": text(4000), "mix": text(2000) + "latin letters " * 20}
    parser = langid.CrossParser(samples)
    assert all(len(a.keys) for a in parser.automata)
    for t in (text(1500), samples["zh"][100:1700] + text(700), "latin " + text(3), samples["mix"] * 3):
        rates, size = parser.rates([t, t[::-1]])
        for k, name in enumerate(parser.languages):
            assert round(rates[k, 0] * size[0]) == langid.SuffixAutomaton(samples[name]).phrases(langid.normalise(t) + " ")


def test_large_alphabets_stay_in_bounds():
    rnd = random.Random(4)
    chars = [chr(0x4E00 + k) for k in range(6000)]
    samples = {f"l{k}": "".join(rnd.choice(chars) for _ in range(langid.SAMPLE_CHARS)) for k in range(3)}
    for a in langid.CrossParser(samples).automata:
        assert a.table.nbytes <= 2 * langid.SAMPLE_CHARS * 4 * (langid.COMMON + 1) and len(a.keys) <= 3 * langid.SAMPLE_CHARS


def test_contradicted_labels_go(spark):
    english, german = "the cat sat on the mat and the dog ran ", "der hund lief auf die katze und das haus "
    rows = [(i, (english if i % 2 else german) * (1 + i % 3) + f"w{i}", "en" if i % 2 else "de") for i in range(60)]
    wrong = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 5 == 0)  # not learned from
    rows += [(wrong, german * 3, "en"), (101, english, None), (102, "123", "en"), (103, None, None), (None, english, "en"), (104, "qqq zzz", None), (105, english, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    side = {r.doc_id: r.side for r in docs.select("doc_id", langid.half().alias("side")).collect()}
    halves = [langid.training_samples(docs.where(langid.half() != k)) for k in (0, 1)]
    plain = lambda t: langid.normalise(t) + " "
    want = set()
    for i, t, lang in rows:
        rate = {name: langid.SuffixAutomaton(s).phrases(plain(t or "")) for name, s in halves[side[i]].items()}
        best = min(rate.values())
        if not any(c.isalpha() for c in t or ""):
            continue
        others = (sum(rate.values()) - best) / (len(rate) - 1)
        if (1 - best / rate[lang] < langid.CONTRADICTED) if lang in rate else (1 - best / others >= langid.MIN_SCORE):
            want.add(i)
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == want
    assert {wrong, 102, 103, 104} & want == set() and {101, None, 1, 2} <= want


def test_language_id_odd(spark):
    docs = odd(spark)
    rows = langid.identify(docs, {"de": "wort und lang ", "en": "one two three same "}).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.g == "x" and 0 <= r.score <= 1
    assert {r.lang_pred for r in rows if r.text == "one two three"} == {"en"}
    assert langid.identify(none(spark), langid.training_samples(none(spark))).count() == 0
    assert langid.keep_identified(docs).columns == docs.columns
    assert langid.keep_identified(none(spark)).count() == 0


# --- mixing ---


def test_mixing_odd(spark):
    docs = odd(spark).unionByName(odd(spark).where("doc_id = 6"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    again = mixing.mix(docs)
    key = lambda df: sorted((r.doc_id, str(r.source)) for r in df.select("doc_id", "source").collect())
    assert key(mixed) == key(again)
    most = mixed.groupBy("doc_id").count().join(docs.groupBy("doc_id").agg(F.count("*").alias("rows")), "doc_id")
    assert most.where("count > 3 * rows").count() == 0
    assert mixing.mix(none(spark)).count() == 0


@pytest.mark.parametrize("broadcast", [50_000, 0])  # both ways to join the plan
def test_mixing_with_ties(spark, monkeypatch, broadcast):
    """Rows without an id, with one id, or alike in all columns: sources meet targets."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(None, "a", "one two three")] * 40 + [(None, "b", f"w{i} x y") for i in range(40)] + [(7, "c", f"v{i} x") for i in range(50)] + [(8, None, "q r s t")] * 30 + [(9, "c", None), (9, "c", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, size, again = {}, {}, mixing.mix(docs).collect()
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    for _, source, text in rows:
        size[source] = size.get(source, 0) + len(words(text))
    weights = {"a": 5, "b": 2, "c": 1, None: 5}
    total, full = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(weights[s] for s in size if s not in full)
        over = {s for s in size if s not in full and weights[s] * level > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in size:
        assert abs(taken[s] - (3 * size[s] if s in full else weights[s] * level)) <= 2.5, s
    key = lambda rows: sorted(map(str, rows))
    assert key(again) == key(mixing.mix(docs).collect())
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("__mix_n", F.lit(1)))


def test_water_filling(spark):
    totals = spark.createDataFrame([("a", 5, 10), ("b", 2, 100), ("c", 1, 1000)], "source string, weight long, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(totals).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0}
    empty = spark.createDataFrame([("a", 5, 0)], "source string, weight long, source_size long")
    assert [r.target for r in mixing.water_fill(empty).collect()] == [0.0]


# --- n-gram Jaccard join ---


def test_jaccard_odd(spark):
    got = {r.doc_id: r for r in jaccardjoin.classify(odd(spark)).collect()}
    want = brute_components(TEXTS.items())
    assert {i: r.component_id for i, r in got.items()} == want
    kept = {r.doc_id for r in jaccardjoin.keep_one(odd(spark)).collect()}
    assert kept == set(want.values())
    assert jaccardjoin.classify(none(spark)).count() == 0


@pytest.mark.parametrize("form", [jaccardjoin.OP4, {}])
def test_jaccard_near_the_threshold(spark, form):
    """Chains of texts that change a few words each: no link is lost or added."""
    rnd = random.Random(5)
    rows, n = [], 0
    for size in (5, 9, 14, 30, 75, 200, 520):
        for _ in range(4):
            text = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            for _ in range(8):
                rows.append((n, " ".join(text)))
                n += 1
                for _ in range(max(1, round(size * rnd.choice([0.005, 0.015, 0.025, 0.03])))):
                    text[rnd.randrange(len(text))] = f"w{rnd.randrange(10**6)}"
                if rnd.random() < 0.5:
                    text = text[rnd.randrange(2) :]
    got = {r.doc_id: r.component_id for r in jaccardjoin.classify(spark.createDataFrame(rows, "doc_id long, text string"), **form).collect()}
    assert got == brute_components(rows, **form)


@pytest.mark.parametrize("few", [1, 10**6])
@pytest.mark.parametrize("form", [jaccardjoin.OP4, {}])
def test_jaccard_of_large_components(spark, monkeypatch, form, few):
    """Components of many blocks: families of near copies, joined by a common passage
    that makes them candidates, and chains that leave the largest class; with sketches in
    many blocks, and without them."""
    monkeypatch.setattr(jaccardjoin, "BLOCK", 6)
    monkeypatch.setattr(jaccardjoin, "SKETCHES", 3)
    monkeypatch.setattr(jaccardjoin, "FEW", few)
    rnd = random.Random(8)
    rows, n = [], 0
    for family in range(5):
        text = [f"f{family}w{k}" for k in range(40)]
        for _ in range(12):
            rows.append((n, " ".join(text)))
            n += 1
            if rnd.random() < 0.8:
                text[rnd.randrange(40)] = f"x{rnd.randrange(10**6)}"
    # sizes from 12 words to 40, each of which links with the next few
    rows += [(n + k, " ".join(f"grow{i}" for i in range(12 + k))) for k in range(28)]
    n += 28
    rows += [(n + k, f"all share these four words {k % 9}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccardjoin.classify(docs.unionByName(docs.where("doc_id < 3")), **form).collect()}
    assert got == brute_components(rows, **form)


def test_jaccard_links_through_null_ids(spark):
    """Documents that only a row without an id joins are one component."""
    word = [f"w{i}" for i in range(100)]
    change = lambda at: " ".join("y" if i in at else w for i, w in enumerate(word))
    rows = [(4, change([0])), (None, change([])), (9, change([99])), (None, None), (None, "alone here"), (7, "other text of a few words")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccardjoin.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(4, 96): 4, (None, 96): 4, (9, 96): 4, (None, 0): None, (None, 1): None, (7, 2): 7}


def test_sketches_part_no_sets_that_link():
    """At every size, also where the cells of two sizes differ, sets that link may link by
    their sketches; unlike sets and sets that share half may not."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 9, 60, 128, 129, 500, 1030, 5000):
        whole = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets = [np.unique(np.concatenate([whole[: size - cut], rng.integers(0, 2**63, more, dtype=np.uint64)])) for cut in {0, size // 20, size // 9, size // 5, size // 2, size} for more in {0, size // 20, size // 9, size // 5, size // 2}]
        sets = [s for s in sets if len(s)]
        rows, n = jaccardjoin.sketch_rows([jaccardjoin.sketch(s) for s in sets]), np.array([len(s) for s in sets])
        for link in (80, 85, 100):
            may, links = jaccardjoin.may_link(rows, n, rows, n, link), jaccardjoin.block_links(sets, sets, link)
            assert (may | ~links).all()
        if size >= 60:  # sizes that meet in a task are within two levels
            near = [k for k in range(len(sets)) if 0.75 * size <= n[k] <= 1.25 * size]
            rows, n, sets = jaccardjoin.sketch_rows([jaccardjoin.sketch(sets[k]) for k in near]), n[near], [sets[k] for k in near]
            same = jaccardjoin.intersections(sets, sets)
            assert not (jaccardjoin.may_link(rows, n, rows, n, 80) & (100 * same < 60 * (n[:, None] + n[None, :] - same))).any()


def test_block_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (5, 40, 90, 3)]
    got = jaccardjoin.intersections(sets, sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


# --- exact dedup ---


def test_exact_dedup_odd(spark):
    docs = odd(spark).unionByName(odd(spark).where("doc_id in (8, 3)"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = exactdedup.group_digests(exactdedup.digests_of(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(t for i, t in rows if i == r.doc_id)
        group = [i for i, t in rows if t == own]
        assert (r.keep_id, r.group_size) == (max(group), len(group))
    assert sum(r.kept for r in got) == len({t for _, t in rows})
    kept = exactdedup.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t for _, t in rows})
    assert exactdedup.drop_repeats(none(spark)).count() == 0


def test_exact_dedup_decides_by_row(spark):
    """Ids that are null or stand at several texts: the rows that op5 marks stay."""
    for rows in (
        [(None, "A"), (9, "A"), (None, "B")], [(None, "A"), (None, "A"), (None, "B")], [(5, "A"), (9, "A"), (5, "B")],
        [(5, "A"), (5, "A"), (5, "B"), (3, "B"), (5, None), (5, ""), (None, "")],
    ):
        docs = odd(spark).limit(0).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
        marked = [(r.doc_id, r.digest) for r in exactdedup.group_digests(exactdedup.digests_of(docs)).where("kept").collect()]
        kept = exactdedup.drop_repeats(docs)
        assert kept.columns == docs.columns
        got = [(r.doc_id, hashlib.sha256((r.text or "").encode()).digest()) for r in kept.collect()]
        key = lambda x: (x[0] is None, x)
        assert sorted(got, key=key) == sorted(((i, bytes(d)) for i, d in marked), key=key)
        assert sorted({r.text or "" for r in kept.collect()}) == sorted({t or "" for _, t in rows})


def test_jaccard_keeps_one_row(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [
        (5, one + " end"), (3, one), (5, two), (9, two + " end"), (7, three), (7, three + " end"), (7, three), (None, three.upper()), (8, three),
        (4, ""), (4, None), (None, "only here"), (None, "Only here"), (None, "or here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccardjoin.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert (3, one) in got and (5, two) in got
    assert len([t for _, t in got if t and t.startswith("c0")]) == 1 and {i for i, t in got if t and t.lower().startswith("c0")} == {7}
    assert sum(not t for _, t in got) == 2 and sorted(t.lower() for i, t in got if i is None) == ["only here", "or here"]
    assert len(got) == 7


def test_exact_dedup_with_a_history(spark):
    digests = lambda rows: exactdedup.digests_of(spark.createDataFrame(rows, "doc_id long, text string"))
    history = exactdedup.history_of(digests([(1, "old"), (50, "old"), (2, "less"), (3, "less")]))
    new = digests([(10, "old"), (11, "new"), (12, "new"), (13, "one"), (14, "less")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.group_digests(new, history).collect()}
    assert got == {10: (50, 3, False), 11: (12, 2, False), 12: (12, 2, True), 13: (13, 1, True), 14: (14, 3, True)}


def test_minimal_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    perfect = exactdedup.PerfectHash(digests)
    assert perfect.slots == 5000 and sorted(perfect.slot(digests)) == list(range(5000))


# --- packing ---


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 400)
    bins, offsets = packing.best_fit(lengths, 100)
    fill = {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in fill.values() if c + lengths[i] <= 100]
        if fits:
            assert fill[bins[i]] == max(fits)
        assert fill.get(bins[i], 0) == offsets[i]
        fill[bins[i]] = fill.get(bins[i], 0) + int(lengths[i])
    assert max(fill.values()) <= 100


def test_packing_in_rounds(spark, monkeypatch):
    """Many groups: underfull bins are packed again with those of other groups."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 7, i]), 0, 0, rnd.choice([rnd.randint(1, 2048), rnd.randint(900, 1300), 2048]), i) for i in range(1500)]
    pieced = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieced).collect()
    assert sorted(r.ids_crc32 for r in got) == list(range(1500))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    once = packing.best_fit(np.array([r[3] for r in rows]), 2048)[0].max() + 1
    assert len(bins) <= 1.06 * once


def test_packing_odd(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(odd(spark)).collect()
    for i, text in TEXTS.items():
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        size = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        assert sum(x[2] for x in own) == size and all(x[2] == 2048 for x in own[:-1])
    assert packing.pack_documents(none(spark)).count() == 0


def test_word_encoder_equals_whole_text(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from weft.llm._words import slices

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, coder = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["Caf\u00e9, d\u00e9j\u00e0-vu! it's 3.14?", "a\u00a0b\u2028c \u4e2d\u6587, ok.", "x <|startoftext|> Y!", "don't. \u00c9T\u00c9! 12:30; e\u0301.", "\U0001f600! a?! \u00d7, \u00f7. \u00df."]
    for text in texts:
        (_, _, data, at), = slices(pa.array([text]))
        assert coder.encode(data, at)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


# --- WARC ---


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nb c", None), (2, None, ""), (3, "u", "x\r\n\r\ny"), (4, "u", "x\r\n\r\ny"), (5, "u", "\u00e9" * 2_000_000), (6, "v", "x\r\n\r\ny")]
    pages = warc.dealt(warc.with_digests(spark.createDataFrame(rows, "page_id long, url string, html string")), 2)
    folder = f"{shared_dir(spark)}/warc-test"
    fs, root = warc.file_system(folder)
    fs.create_dir(root, recursive=True)
    files = warc.normalise(warc.write_archives(pages, warc.revisits_of(pages), folder), folder)
    files.write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    got = {r.page_id: r for r in warc.read_archives(files, folder).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 6), 4: ("revisit", 6), 5: ("response", None), 6: ("response", None)}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), warc.base32_sha1(payload))
    # a task that runs again finds what it has left
    for r in files.collect():
        assert warc.normalise_file(fs, r.path.replace("part-", "mono-"), r.path) == r.records
    # every index entry leads to a member of its own
    for r in files.collect():
        for line in open(r.path + ".idx"):
            entry = json.loads(line)
            headers, _ = warc.read_member(fs.open_input_file(r.path), entry["offset"], entry["length"])
            assert headers["WARC-Record-ID"] == entry["id"]
            if entry["id"].endswith(":1>"):
                assert headers["WARC-Target-URI"] == "http://a/%0D%0Ab%20c"


def test_warc_null_and_repeated_ids(spark):
    rows = [(None, "a", "x"), (None, "b", "y"), (None, "c", "y"), (4, "d", "x"), (4, "e", "x"), (3, "f", "x"), (3, "g", "z")]
    pages = warc.dealt(warc.with_digests(spark.createDataFrame(rows, "page_id long, url string, html string")), 3)
    folder = f"{shared_dir(spark)}/warc-nulls"
    fs, root = warc.file_system(folder)
    fs.create_dir(root, recursive=True)
    read = warc.read_archives(warc.normalise(warc.write_archives(pages, warc.revisits_of(pages), folder).checkpoint(), folder).checkpoint(), folder).checkpoint()
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.resolved(read).collect()), key=key)
    assert got == sorted([(None, "revisit", 4), (None, "response", None), (None, "response", None), (4, "response", None), (4, "response", None), (3, "revisit", 4), (3, "response", None)], key=key)
    with pytest.raises(Exception, match="without its response"):
        warc.resolved(read.where("page_id = 3")).collect()


def test_truncated_streams_are_errors():
    data = warc.member(warc.record("response", "1", "u", b"x" * 100, 100, "D", None))
    assert len(list(warc.records(warc.inflate(iter([data[:20], data[20:], data]))))) == 2
    for part in (data[:-1], data[:-8], data + data[:5]):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflate(iter([part]))))


def test_warc_empty(spark):
    pages = warc.dealt(warc.with_digests(spark.createDataFrame([], "page_id long, url string, html string")), 2)
    assert warc.revisits_of(pages).count() == 0
    folder = f"{shared_dir(spark)}/warc-empty"
    assert warc.normalise(warc.write_archives(pages, warc.revisits_of(pages), folder), folder).count() == 0


# --- substring dedup ---


def test_substrings_odd(spark):
    rows = [(i, t) for i, t in TEXTS.items()] + [(100, "pre " + TEXTS[6] + " post"), (101, " ".join(f"k{i}" for i in range(13))), (102, "a " + " ".join(f"k{i}" for i in range(13)))]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, kept in brute_removed(rows).items():
        r = got[i]
        assert (r.n_words, r.n_removed) == (len(words(dict(rows)[i])), len(words(dict(rows)[i])) - len(kept))
        assert r.kept == " ".join(kept) and r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
    assert got[102].removed == [[1, 14]]
    assert substrings.remove_repeats(none(spark)).count() == 0


# --- URL filters ---


def test_url_rules(spark):
    urls = [None, "", "no-scheme", "http://NET", "http://net/", "https://a.example.net/en/x", "http://example.net/enx", "http://example.com/de/a?q#f", "http://notexample.com/de/", "x://y.org/fr/", "http://a/b://net/", "http://net?x/", "s://org/fr"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "", None, "allow"), ("net", "/", "net/", "block"),
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/enx", "net/", "block"), ("example.com", "/de/a", "example.com/de/", "block"),
        ("notexample.com", "/de/", None, "allow"), ("y.org", "/fr/", "org/fr/", "allow"), ("a", "/b://net/", None, "allow"), ("net", "", None, "allow"), ("org", "/fr", None, "allow"),
    ]
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_very_long_urls_and_many_rules(spark, monkeypatch):
    long = "x" * 300_000
    urls = [f"http://a.b.net/{long}/de", f"http://{long}.org/fr/{long}", "http://s7.example.com/p3/q", "http://s7.example.com/p3", "http://u.s9.example.com/p9x", "http://s8.example.com/"]
    rules = [*urlfilter.RULES, *[("block", f"s{i}.example.com", f"/p{i % 4}/") for i in range(10)], ("allow", "s9.example.com", "/p"), ("block", "s9.example.com", "/p9"), ("allow", "s8.example.com", "/"), ("block", "s8.example.com", "/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    once = [(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, rules).orderBy("page_id").collect()]
    assert time.time() - began < 20
    assert [x[1] for x in once] == ["net/", "org/fr/", "s7.example.com/p3/", None, "s9.example.com/p9", "s8.example.com/"] and once[-1][2] == "allow"
    monkeypatch.setattr(urlfilter, "MAX_RULES", 3)
    assert [(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, rules).orderBy("page_id").collect()] == once


# --- language-model scoring ---


def test_elias_fano():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 40, 20_000).astype(np.uint64))
    ef = eliasfano.EliasFano.build(values, 1 << 40)
    assert (ef.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values[::7], values[::7] + np.uint64(1)])
    want = np.searchsorted(values, asked)
    hit = (want < len(values)) & (values[np.minimum(want, len(values) - 1)] == asked)
    assert (ef.find(asked) == np.where(hit, want, -1)).all()
    assert len(eliasfano.EliasFano.build(values[:0], 1).find(np.zeros(3, np.uint64))) == 3


def test_select_in_word():
    rng = np.random.default_rng(7)
    words = np.concatenate([rng.integers(1, 1 << 63, 500).astype(np.uint64), np.array([1, 1 << 63, 2**64 - 1], np.uint64)])
    for w in words.tolist():
        ones = [k for k in range(64) if w >> k & 1]
        assert eliasfano.select_in_word(np.full(len(ones), w, np.uint64), np.arange(len(ones))).tolist() == ones


def test_successors_lie_between_their_pointers():
    """The same successor id under another context is not found."""
    values = np.array([3, 9, 9, 9, 12], np.uint64)
    ef = eliasfano.EliasFano.build(values, 16)
    assert ef.find(np.array([9, 9, 3], np.uint64), np.array([2, 4, 1]), np.array([3, 5, 5])).tolist() == [2, -1, -1]


def test_trie_of_many_contexts(tmp_path):
    """More contexts than ranks that fit beside a successor, the last ones included."""
    rng = np.random.default_rng(6)
    contexts = np.unique(rng.integers(0, 1 << 63, 150_000).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(rng.integers(0, 3, len(contexts)))])
    owner = np.repeat(np.arange(len(contexts)), np.diff(first))
    successors = rng.integers(0, 1 << 20, len(owner)).astype(np.uint64)
    successors[1:][owner[1:] == owner[:-1]] += np.uint64(1 << 30)
    codes = rng.integers(1, 256, len(owner)).astype(np.uint8)
    backoff = rng.integers(1, 65536, len(contexts)).astype(np.uint16)
    with open(tmp_path / "trie", "wb") as file:
        eliasfano.BigramTrie.build(contexts, first, successors, codes, backoff).tofile(file)
    trie = eliasfano.BigramTrie.open(tmp_path / "trie")
    code, weight = trie.look_up(contexts, owner, successors)
    assert (code == codes).all() and (weight == backoff).all()
    # the same successor of a context 2^16 further on is another bigram
    have = set(zip(owner.tolist(), successors.tolist()))
    far = (owner + (1 << 16)) % len(contexts)
    want = np.array([(o, s) in have for o, s in zip(far.tolist(), successors.tolist())])
    assert ((trie.look_up(contexts, far, successors)[0] > 0) == want).all()
    assert (trie.look_up(contexts + np.uint64(1), owner, successors)[0] == 0).mean() > 0.99


def test_shard_of_many_contexts():
    n = 70_000
    contexts = np.arange(n, dtype=np.uint64) << np.uint64(40)
    owner = np.repeat(np.arange(n), 2)
    successors = np.tile(np.array([3, 9], np.uint64), n)
    trie = lmscore.build_shard(contexts, owner, successors, np.tile(np.array([2, 6]), n))
    code, backoff = trie.look_up(contexts, owner, successors)
    assert np.allclose(lmscore.backoff_of(backoff), 1 - lmscore.share_of(code[:2]).sum(), rtol=1e-3)
    assert (code == lmscore.code_of(np.tile(np.array([1.25, 5.25]) / 8, n))).all() and len(set(backoff.tolist())) == 1


def test_lm_odd(spark):
    docs = odd(spark).withColumn("held_out", F.col("doc_id") % 4 == 0).select("doc_id", "text", "held_out")
    rows = {r.doc_id: r for r in lmscore.score_documents(docs).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {i: len(words(t)) + 1 for i, t in TEXTS.items()}
    assert all(np.isfinite(r.score) and r.score < 0 and np.isfinite(r.base_score) for r in rows.values())
    assert lmscore.score_documents(none(spark).withColumn("held_out", F.lit(True))).count() == 0
    untrained = lmscore.score_documents(docs.withColumn("held_out", F.lit(True))).collect()
    assert len(untrained) == len(TEXTS) and {r.train_tokens for r in untrained} == {0}


def test_lm_null_and_repeated_ids(spark):
    rows = [(None, "a b a", False), (None, "a b a", False), (3, "b", False), (3, "c c", True), (None, None, True)]
    got = lmscore.score_documents(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()
    assert sorted((r.n_tokens, r.n_known, r.held_out) for r in got) == [(1, 1, True), (2, 2, False), (3, 1, True), (4, 4, False), (4, 4, False)]
    assert {r.train_tokens for r in got} == {10} and sum(r.doc_id is None for r in got) == 3


def test_substrings_null_and_repeated_ids(spark):
    """A row without an id yields to all ids, and rows of one id never yield to each other."""
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(None, text), (None, text + " x"), (5, text), (5, "a " + text), (9, text), (None, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed, r.doc_id or 0) for r in got) == [(0, 0, 0), (20, 0, 5), (20, 20, 0), (20, 20, 9), (21, 0, 5), (21, 20, 0)]


def test_schema_has_clashing_names():
    assert {"g", "part", "size", "root", "node", "hashes", "score"} <= {c.split()[0] for c in SCHEMA.split(", ")}


# --- ids that a double cannot hold, beside null ids ---

BIG = 2**53 + 1


def big(spark):
    rows = [(None, "x"), (BIG, "x"), (BIG - 2, "x"), (None, "a b"), (BIG + 2, "c d e"), (BIG + 4, "x"), (None, None), (BIG + 6, "")]
    return spark.createDataFrame([(i, t, "de", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_big_ids_exact_dedup(spark):
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.group_digests(exactdedup.digests_of(big(spark))).collect()}
    x = {(i, BIG + 4, 4, i == BIG + 4) for i in (None, BIG, BIG - 2, BIG + 4)}
    assert found == x | {(None, None, 1, True), (BIG + 2, BIG + 2, 1, True), (None, BIG + 6, 2, False), (BIG + 6, BIG + 6, 2, True)}
    kept = exactdedup.drop_repeats(big(spark))
    assert ids(kept) == sorted([None, BIG + 2, BIG + 4, BIG + 6], key=str)
    assert kept.where("text = 'x'").count() == 1


def test_big_ids_packing(spark):
    assert ids(packing.pack_documents(big(spark))) == ids(big(spark))


@pytest.mark.parametrize("run", [
    jaccardjoin.classify, jaccardjoin.keep_one, substrings.remove_repeats, langid.keep_identified, mixing.mix,
    lambda df: lmscore.score_documents(df.withColumn("held_out", F.lit(False))), lambda df: langid.identify(df, langid.training_samples(df)), lambda df: simhash.near_components(df), lambda df: alignment.align(df), lambda df: periodic.periodic_runs(df),
])
def test_big_ids_stay(spark, run):
    """No operator gives an id that it was not given."""
    assert set(ids(run(big(spark)))) <= set(ids(big(spark)))


def test_big_ids_warc_and_topk(spark, tmp_path):
    pages = spark.createDataFrame([(None, "http://a", "x"), (BIG, "http://a", "x"), (BIG + 2, "http://b", "x"), (None, None, None)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    assert found == {(None, "revisit", BIG + 2), (BIG, "revisit", BIG + 2), (BIG + 2, "response", None), (None, "response", None)}
    v = topk.quantised(spark.createDataFrame([(BIG, [1.0]), (None, [1.0]), (BIG + 2, [2.0])], "vec_id long, embedding array<float>"))
    assert {r.vec_id for r in topk.search(v, v.where(f"vec_id = {BIG}")).collect()} <= {BIG + 2, None}
