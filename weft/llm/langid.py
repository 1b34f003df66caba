"""Language identification by cross-parsing entropy.

One suffix automaton is built for each language over labelled text. A text is
parsed greedily into the longest phrases that occur in a language's labelled
text; the language that needs the fewest phrases wins. Phrases are normalised by
the symbols parsed, so the score does not depend on the length of the text.

Labelled text is a bounded sample: of the ``MAX_LANGUAGES`` languages with most
training rows, the ``SAMPLE_DOCS`` distinct texts each that come first by a hash of
the text. Each gives an excerpt of ``EXCERPT`` symbols from a place that its hash
names, anywhere in the whole text; every excerpt is learned whole. The bound is the
number of labelled rows; predictions read whole texts.

Many texts are parsed in step. Long ones are parsed in segments; a segment that its
predecessor leaves inside a phrase is parsed again from the predecessor's state, up
to where both parses agree, so counts are those of one parse of the whole text. An
automaton's transitions are a table over its ``COMMON`` most frequent symbols and a
sorted list of the others: at most ``2 * SAMPLE_CHARS`` states of 4 * (COMMON + 1)
bytes, and 12 bytes for each of at most ``3 * SAMPLE_CHARS`` listed transitions.

Repeated rows are predicted alike, each by itself; a row without an id takes part.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import crc_fold, own_name, small_batches

SAMPLE_DOCS = 100
EXCERPT = 300
SAMPLE_CHARS = SAMPLE_DOCS * (EXCERPT + 1)  # what such excerpts come to, not a bound of its own
MAX_LANGUAGES = 256
COMMON = 63
SEGMENT = 512
LANES = 4096
TABLE_BYTES = 1 << 29  # of all languages' tables; beyond, tables get narrower and lists longer
MIN_SCORE = 0.05  # of rows without a learned label that stay in a pipeline
CONTRADICTED = 0.15  # of labelled rows that go: another language needs so much fewer phrases than their own
UNKNOWN = "und"


def normalise(text: str) -> str:
    """Lower case; every run of characters that are no letters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """Suffix automaton of one string (online construction)."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = link[at]
            if at >= 0:
                to = self.next[at][c]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and self.next[at].get(c) == to:
                        self.next[at][c] = clone
                        at = link[at]
                    link[to] = link[new] = clone
            last = new

    def phrases(self, text: str) -> int:
        """Greedy longest-match parse; a symbol that never occurs is a phrase."""
        state = count = 0
        for c in text:
            if c in self.next[state]:
                state = self.next[state][c]
                continue
            count += state > 0
            state = self.next[0].get(c, 0)
            count += state == 0
        return count + (state > 0)


class _Transitions:
    """One automaton as arrays. A state's row has an entry (next row << 2 | phrases
    that end) for each common symbol; symbol 0 is what the language never has."""

    def __init__(self, text: str, symbols: dict[str, int], width: int) -> None:
        auto = SuffixAutomaton(text)
        count = Counter(text)
        common = sorted(count, key=lambda c: (-count[c], c))[: width - 1]
        column = {c: k + 1 for k, c in enumerate(common)}
        self.width, self.column = width, np.zeros(len(symbols) + 1, np.uint8)  # column of each symbol of all languages
        for c in common:
            self.column[symbols[c]] = column[c]
        table = np.full((len(auto.next), width), -1, np.int32)
        keys, ends = [], []
        for state, edges in enumerate(auto.next):
            for c, to in edges.items():
                if c in column:
                    table[state, column[c]] = to
                else:
                    keys.append(state << 21 | symbols[c])
                    ends.append(to)
        root = table[0].copy()
        missing = table < 0
        cost = np.where(missing, (np.arange(len(table)) > 0)[:, None].astype(np.int32) + (root < 0)[None, :], 0)
        self.table = ((np.where(missing, np.where(root < 0, 0, root)[None, :], table) * width << 2) | cost).astype(np.int32).ravel()
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ends = np.array(keys, np.int64)[order], np.array(ends, np.int64)[order]
        self.rare = np.zeros(len(symbols) + 1, bool)  # symbols that are looked up in the list
        self.rare[[symbols[c] for c in count if c not in column]] = True

    def step(self, state: np.ndarray, symbol: np.ndarray, rare: bool) -> np.ndarray:
        to = self.table[state + self.column[symbol]]
        if rare and (at := np.flatnonzero(self.rare[symbol])).size:
            own = state[at] // self.width
            found, start = self._listed(own, symbol[at]), self._listed(np.zeros_like(own), symbol[at])
            back = np.where(start >= 0, start, 0)
            to[at] = np.where(found >= 0, found * self.width << 2, (back * self.width << 2) | ((own > 0).astype(np.int64) + (start < 0)))
        return to

    def _listed(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 21 | symbol
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.ends[spot], -1)


class CrossParser:
    """All languages' automata; parses the segments of many texts in step."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        self.symbols = {c: i + 1 for i, c in enumerate(sorted(set("".join(samples.values()))))}
        states = 2 * sum(map(len, samples.values())) + 1
        width = int(max(2, min(COMMON + 1, TABLE_BYTES // (4 * states))))
        self.automata = [_Transitions(samples[name], self.symbols, width) for name in self.languages]
        letters = np.zeros(0x110000, bool)
        letters[:0x34000] = np.fromiter((chr(c).isalpha() for c in range(0x34000)), bool, 0x34000)
        self.letter = letters
        self.code = np.zeros(0x110000, np.int32)
        for c, i in self.symbols.items():
            self.code[ord(c)] = i

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases a symbol of each text and language; symbols of each text."""
        parts = []
        for text in texts:
            points = np.frombuffer(((text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = self.letter[points]
            keep = letter.copy()
            keep[1:] |= letter[:-1]  # one space after each run of letters
            parts.append(np.where(letter, self.code[points], self.code[32])[keep] if letter.any() else np.zeros(0, np.int32))
        size = np.array([len(p) for p in parts], np.int64)
        phrases = np.zeros((len(self.languages), len(texts)), np.int64)
        stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(size)])
        segments = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        first = at[owner] + nth * SEGMENT
        length = np.minimum(first + SEGMENT, at[owner + 1]) - first
        for k, auto in enumerate(self.automata):
            count, ends = self._parse(auto, stream, first, length, nth)
            last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
            phrases[k] = np.bincount(owner, count, len(texts)).astype(np.int64)
            phrases[k][owner[last]] += ends[last] > 0  # the phrase that ends with the text
        return phrases / np.maximum(size, 1), size

    @staticmethod
    def _parse(auto: _Transitions, stream: np.ndarray, first: np.ndarray, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end inside, state at the end) of each segment."""
        counts, ends = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        rare = len(auto.keys) > 0
        order = np.argsort(-length, kind="stable")
        for lane in range(0, len(order), LANES):
            pick = order[lane : lane + LANES]
            steps = int(length[pick[0]])
            live = np.searchsorted(-length[pick], -np.arange(steps), side="left")
            grid = stream[np.minimum(first[pick][None, :] + np.arange(steps)[:, None], len(stream) - 1)]
            state, count = np.zeros(len(pick), np.int64), np.zeros(len(pick), np.int64)
            for step in range(steps):
                n = live[step]
                to = auto.step(state[:n], grid[step, :n], rare)
                count[:n] += to & 3
                np.right_shift(to, 2, out=state[:n], casting="unsafe")
            counts[pick], ends[pick] = count, state
        # segments that begin inside a phrase: the same parse from the state before them
        entered = np.zeros(len(first), np.int64)
        while True:
            before = np.where(nth > 0, np.concatenate([[0], ends[:-1]]), 0) if len(ends) else entered
            again = np.flatnonzero(before != entered)
            if not len(again):
                return counts, ends
            # both parses walk on until they are in one state
            own, old, where = before[again], entered[again], first[again].copy()
            change = np.zeros(len(again), np.int64)
            stop, open_ = first[again] + length[again], np.arange(len(again))
            while len(open_):
                symbol = stream[where[open_]]
                to, other = auto.step(own[open_], symbol, rare), auto.step(old[open_], symbol, rare)
                change[open_] += (to & 3).astype(np.int64) - (other & 3)
                own[open_], old[open_] = to >> 2, other >> 2
                where[open_] += 1
                open_ = open_[(own[open_] != old[open_]) & (where[open_] < stop[open_])]
            counts[again] += change
            ends[again] = np.where(own == old, ends[again], own)
            entered[again] = before[again]

    def predict(self, texts: list[str | None], labels: list[str | None] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and how far its label is contradicted.

        The score is 1 - best / mean of the other languages' phrase rates, within
        0 to 1. ``und`` with score 0: no letter, null, or no language was learned.
        Equal rates go to the language that sorts first. The last is 1 - best / the
        label's rate; not a number where the label is none of the languages.
        """
        rates, size = self.rates(texts)
        nothing = np.full(len(texts), np.nan)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), nothing
        best = rates.argmin(0)
        low = rates[best, np.arange(len(texts))]
        others = (rates.sum(0) - low) / max(1, len(self.languages) - 1)
        score = np.where(others > 0, 1 - low / np.where(others > 0, others, 1), 1.0 if len(self.languages) == 1 else 0.0)
        score = np.where(size > 0, np.clip(score, 0, 1), 0.0)
        if labels is not None:
            number = {name: k for k, name in enumerate(self.languages)}
            at = np.array([number.get(x, -1) for x in labels], np.int64)
            own = rates[at, np.arange(len(texts))]
            nothing = np.where((at >= 0) & (own > 0), 1 - low / np.where(own > 0, own, 1), nothing)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, size)], score, nothing


def training_samples(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> dict[str, str]:
    """Bounded labelled text of each language, from the rows outside fold 0 of 5."""
    text = F.col(text_col)
    place = 1 + F.pmod(F.xxhash64(text, F.lit(1)), F.greatest(F.lit(1), F.length(text) - EXCERPT + 1))
    d = docs.where((crc_fold(id_col, 5) != 0) & F.col(lang_col).isNotNull() & text.isNotNull())
    d = d.select(F.col(lang_col).alias("lang"), F.xxhash64(text).alias("key"), F.substring(text, place, F.lit(EXCERPT)).alias("text"))
    known = d.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).select(F.col("lang").alias("known"))
    # a salted first cut keeps each task's rows of a language few, whatever its share
    near = Window.partitionBy("lang", F.pmod("key", F.lit(16))).orderBy("key", "text")
    rows = d.withColumn("k", F.row_number().over(near)).where(F.col("k") <= SAMPLE_DOCS).dropDuplicates(["lang", "key"])
    far = Window.partitionBy("lang").orderBy("key")
    rows = rows.withColumn("k", F.row_number().over(far)).where(F.col("k") <= SAMPLE_DOCS)
    picked = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("texts"))
    # MAX_LANGUAGES rows of SAMPLE_DOCS excerpts at most
    picked = picked.join(F.broadcast(known), F.col("lang") == F.col("known"), "left_semi").collect()
    samples: dict[str, str] = {}
    for row in picked:
        text = " ".join(normalise(part) for _, part in row["texts"])
        if text.strip():
            samples[row["lang"]] = text + " "
    return samples


_PARSERS: dict[str, CrossParser] = {}


def _parser(key: str, samples: dict[str, str]) -> CrossParser:
    """The worker's own parser; tasks of one query share it."""
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def identify(docs: DataFrame, samples: dict[str, str], text_col="text", lang_col="lang_pred", score_col="score", label_col=None, against_col="against") -> DataFrame:
    """``docs`` with two more columns, the predicted language and its score; with
    ``label_col`` a third one, how far the text contradicts that label (or null).

    Null and letterless texts get ``und`` and score 0. Columns of these names that
    are there already are replaced; all others pass through unchanged.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(samples)  # MAX_LANGUAGES x SAMPLE_CHARS at most
    key = uuid.uuid4().hex
    more = {lang_col: F.lit(None).cast("string"), score_col: F.lit(None).cast("double")} | ({against_col: F.lit(None).cast("double")} if label_col else {})
    docs = docs.drop(*more)
    schema, added = docs.select("*", *[c.alias(n) for n, c in more.items()]).schema, list(more)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(key, shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023,E731
            lang, score, against = parser.predict(column(text_col), column(label_col) if label_col else None)
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(against, pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found[: len(added)]], names=[*batch.schema.names, *added])

    return docs.mapInArrow(predict, schema)


def half(text_col="text"):
    """0 or 1 by the text, so that copies of a text lie in one half."""
    return F.pmod(F.xxhash64(text_col), F.lit(2))


def keep_identified(docs: DataFrame, lang_col="lang") -> DataFrame:
    """Pipeline form: the rows whose language can be told, with their own columns.

    The texts lie in two halves (``half``), and each is judged by what was learned from
    the other, so no text bears on its own case. Rejected are texts that hold no evidence
    (null, without a letter, no language learned), labelled rows of which another language needs
    15 % fewer phrases than their own (``CONTRADICTED``), and rows without a
    learned label whose score is below ``MIN_SCORE``. Columns of any names pass through.
    """
    lang, score, against = (own_name(docs, n) for n in ("__lang_pred", "__lang_score", "__against"))
    sure = F.when(F.col(against).isNull(), F.col(score) >= MIN_SCORE).otherwise(F.col(against) < CONTRADICTED)

    def judged(side: int) -> DataFrame:
        samples = training_samples(docs.where(half() != side), lang_col=lang_col)
        return identify(docs.where(half() == side), samples, lang_col=lang, score_col=score, label_col=lang_col, against_col=against)

    return judged(0).unionByName(judged(1)).where((F.col(lang) != UNKNOWN) & sure).select(*docs.columns)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = docs.select("doc_id", "text", (crc_fold("doc_id", 5) == 0).alias("held_out"))
    return identify(d, training_samples(docs)).drop("text")
