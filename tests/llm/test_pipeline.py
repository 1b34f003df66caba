"""Each stage of the pipeline against a brute-force form of it on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

from .common import brute_components, odd, words

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(name, input rows, output rows) of each stage, written and read again."""
    folder, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        out.append((before, docs.collect()))
    return out


def test_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"]


def test_rejected_languages_go(spark, steps):
    """By a plain parse with samples of the half that a text is not in: no letters, or a
    label that another language contradicts."""
    from weft.llm import langid

    before, after = steps[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    side = {r.doc_id: r.side for r in docs.select("doc_id", langid.half().alias("side")).collect()}
    halves = [langid.training_samples(docs.where(langid.half() != k)) for k in (0, 1)]
    halves = [{name: langid.SuffixAutomaton(text) for name, text in samples.items()} for samples in halves]
    want = set()
    for r in before:
        if any(c.isalpha() for c in r.text or ""):
            count = {name: a.phrases(langid.normalise(r.text) + " ") for name, a in halves[side[r.doc_id]].items()}
            if r.lang in count and 1 - min(count.values()) / count[r.lang] < langid.CONTRADICTED:
                want.add(r.doc_id)
    assert {r.doc_id for r in after} == want


def test_mislabelled_texts_go(spark):
    """Texts whose label is exchanged go, the others stay: their own labels teach nothing
    about them, for they are judged by the other half."""
    from pyspark.sql import functions as F

    from weft.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 200").dropDuplicates(["text"])
    names = sorted(r.lang for r in docs.select("lang").distinct().collect())
    after = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, names[(k + 1) % len(names)])]), F.col("lang"))
    wrong = docs.where("doc_id % 25 = 0").withColumn("lang", after)
    kept = {r.doc_id for r in langid.keep_identified(docs.where("doc_id % 25 <> 0").unionByName(wrong)).select("doc_id").collect()}
    rows = docs.select("doc_id").collect()
    bad = {r.doc_id for r in rows if r.doc_id % 25 == 0}
    good = {r.doc_id for r in rows} - bad
    assert len(bad) > 10 and len(bad & kept) <= 0.2 * len(bad) and len(good - kept) <= 0.02 * len(good)


def test_private_names_pass_through(spark):
    """Columns named as the stages' own helpers keep their values."""
    from weft.llm import exactdedup, jaccardjoin, langid

    text = "one two three four five six seven eight"
    rows = [(k, text if k < 3 else f"{text} {k}{k} other words again {k}", "en", "s", 8) for k in range(5)]
    extra = ["__digest", "__id", "__at", "__lang_pred", "__lang_score", "__against"]
    docs = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in extra]) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in extra)}")
    for stage in (exactdedup.drop_repeats, jaccardjoin.keep_one, langid.keep_identified):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in extra)


def test_largest_id_of_equal_texts_stays(steps):
    before, after = steps[1]
    last = {}
    for r in before:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(last.values())


def test_one_of_each_component_stays(steps):
    before, after = steps[2]
    want = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(want.values()))


def test_mix(steps):
    before, after = steps[3]
    times = Counter(r.doc_id for r in after)
    size, total, taken = Counter(), 0, Counter()
    longest = Counter()
    for r in before:
        n = len(words(r.text))
        size[r.source] += n
        total += n
        taken[r.source] += n * times[r.doc_id]
        longest[r.source] = max(longest[r.source], n)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        over = {s for s in size if s not in full and weight[s] * level > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in size:
        target = 3 * size[s] if s in full else weight[s] * level
        assert abs(taken[s] - target) <= longest[s]
    assert max(times.values()) <= 3


def test_packed_rows(steps):
    before, after = steps[4]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after if r.piece == 0)


def test_odd_input(spark, tmp_path):
    docs = odd(spark)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() > 0
    docs = odd(spark).limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/none-{name}")
        docs = spark.read.parquet(f"{tmp_path}/none-{name}")
    assert docs.count() == 0
