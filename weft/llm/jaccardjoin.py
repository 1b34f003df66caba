"""Similarity self-join of shingle sets by PartEnum signatures.

A document's set are its distinct word shingles. Sizes fall into bands; sets that
are similar enough to link are in one band or in neighbouring ones, and differ in
at most k elements, k following from the band. The feature domain is partitioned
by hash into groups of ``PARTS`` partitions. There are enough groups that in one of
them at most one partition differs; for each group all subsets that leave one
partition out are enumerated, so two such sets share one signature: the hash of
what they hold in a subset's partitions.

``SLACK`` of the groups are more than needed, so more than the spare ones must
agree. A signature of few elements says little. A set leaves out those below the
largest size for which it has no more weak groups than there are spare ones: one of
the agreeing groups is then strong, and what both hold there has that size.

Sets that share a signature are candidates. A task links what shares a signature in
its own rows, so a signature that many sets hold is one row of each flush. The
candidates' connected components are found first, on narrow rows. Passages that many
documents share join them into components far larger than their links, so a component
of more than ``FEW`` sets is divided by sketches: a sketch holds the parity of the
elements in each of its cells, and two sketches differ in no more cells than their sets
in elements. Sets whose sketches differ in too many cells for a link stay apart, and
none that link do. Only then the candidates' sets are gathered, by component, and links
inside are found exactly. A component of more than ``BLOCK`` sets is split into blocks. First all meet one block of
pivots, each set travelling once. Sets that are then in one class need no more links
among them; only the others (sets outside their component's largest class) meet all
blocks of sets whose sizes are near enough. Pairs are counted in the tasks, never emitted. Copies have one set: they
are one class from the start, known by a 64-bit hash of it.

Texts without words link with nothing. Null texts are such. Rows that repeat an id
are one document if their texts are equal; else they are told apart. A null id links
like any other, but is no component's smallest id unless there is none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import runs, shard_edges
from ._spark import cut, planned_bytes, small_batches, text_digest, without
from ._words import U, bounds, lower_ascii, mix, slices, span_hashes, window_hashes, word_hashes
from .components import components

WIDTH = 5
LINK = 80  # percent
OP4 = {"width": 4, "link": 85}  # the contract of the query; the pipeline's stage takes the defaults
PARTS = 4
SLACK = 0.15
SIZES = (6, 5, 4, 3, 2, 1, 0)
BAND = 1.4
BLOCK = 1024
FEW = 16
SKETCHES = 2048  # of one task and side, ...
SKETCH_BYTES = 4 << 20  # ... or fewer, if they are large
FLUSH = 1_000_000
SHARD_BYTES = 8 << 20
COLUMNS = 4096


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, end, data, at in slices(column):
        data = lower_ascii(data)
        start, stop, first = bounds(data, at)
        words = word_hashes(data, start, stop)
        full = window_hashes(words, width)
        for k in range(end - row):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield row + k, np.unique(full[a : b - width + 1])
            elif b > a:
                yield row + k, span_hashes(words[a:b], np.array([0]), np.array([b - a]))
            else:
                yield row + k, np.zeros(0, U)


def set_hash(elements: np.ndarray) -> int:
    """64-bit signed hash of a set."""
    total = int(mix(elements).sum(dtype=U)) + len(elements) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total & (2**64 - 1)], U)).view(np.int64)[0])


def sketch(elements: np.ndarray) -> bytes:
    """Parities of a set's elements over cells: a power of two of them, 256 at least and
    from twice to four times the elements."""
    cells = max(256, 1 << (2 * len(elements) - 1).bit_length())
    count = np.bincount((mix(elements ^ U(0xD1B54A32D192ED03)) & U(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_rows(sketches: list[bytes]) -> np.ndarray:
    """One row of 64-bit words a sketch, all folded to the cells of the smallest."""
    width = min(len(s) for s in sketches)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, "<u8").reshape(-1, width // 8), axis=0) for s in sketches])


def may_link(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, link: int) -> np.ndarray:
    """Boolean matrix: where the sketches leave a link possible. Sets link when they differ
    in (100 - link) of (100 + link) parts of their sizes' sum at most."""
    cells = np.zeros((len(a), len(b)), np.int64)
    least = np.abs(size_a[:, None] - size_b[None, :])
    for k in range(a.shape[1]):
        cells += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return np.maximum(cells, least) * (100 + link) <= (size_a[:, None] + size_b[None, :]) * (100 - link)


class Bands:
    """Size bands and the scheme of each, for linking at ``link`` percent."""

    def __init__(self, link: int = LINK) -> None:
        self.link, self.low = link, [1]

    def _reach(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(int(self.low[-1] * max(BAND, 100 / self.link)) + 1)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size takes part: its own, and the one
        below if a set of that one can be similar."""
        self._reach(size)
        own = next(b for b in range(len(self.low) - 1) if size < self.low[b + 1])
        return [own, own - 1] if own and (self.low[own] - 1) * 100 >= size * self.link else [own]

    def scheme(self, band: int) -> tuple[int, int]:
        """(groups, spare ones). A set of up to ``most`` elements and a similar
        larger one differ in at most k elements."""
        most = self.low[band + 1] - 1
        k = most * (100 - self.link) // self.link
        if not k:
            return 0, 0  # only equal sets are similar
        need = -(-(k + 1) // 2)  # in one of these at most one element's partition differs
        spare = 1 + int(need * SLACK)
        return need + spare, spare


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    out = []
    for band in bands.of(len(elements)):
        groups, spare = bands.scheme(band)
        if not groups:
            continue
        salted = mix(elements + U((band + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
        cell = ((salted >> U(32)) % U(groups * PARTS)).astype(np.int64)
        sums, count = np.zeros(groups * PARTS, U), np.bincount(cell, minlength=groups * PARTS)
        np.add.at(sums, cell, mix(salted))
        sums, count = sums.reshape(groups, PARTS), count.reshape(groups, PARTS)
        # each subset leaves one partition out
        value = sums.sum(1, dtype=U)[:, None] - sums
        size = count.sum(1)[:, None] - count
        place = U(band) << U(40) | np.arange(groups * PARTS, dtype=U).reshape(groups, PARTS)
        value = mix(value ^ mix(place))
        weakest = np.sort(size.min(1))
        least = next(n for n in SIZES if (weakest < n).sum() <= spare)
        out.append(value[size >= least])
    return np.concatenate(out) if out else np.zeros(0, U)


def sets_of(docs: DataFrame, width: int = WIDTH, digests: bool = False) -> DataFrame:
    """(doc_id, n_shingles, set, sketch, at) of every row, and its text's digest if wanted;
    ``set`` and ``sketch`` are null where it is empty; ``at`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            name = np.zeros(batch.num_rows, np.int64)
            drawn = [None] * batch.num_rows
            for row, elements in shingle_sets(batch.column(1), width):
                if len(elements):
                    size[row], name[row], drawn[row] = len(elements), set_hash(elements), sketch(elements)
            own = [batch.column(0), pa.array(size), pa.array(name, mask=size == 0), pa.array(drawn, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], names=["doc_id", "n_shingles", "set", "sketch", "at", "digest"][: 2 + batch.num_columns])

    small_batches(docs.sparkSession)
    more = [text_digest().alias("digest")] if digests else []
    return docs.select("doc_id", "text", F.xxhash64("text").alias("at"), *more).mapInArrow(run, "doc_id long, n_shingles long, set long, sketch binary, at long" + ", digest binary" * digests)


def _five(signatures: np.ndarray) -> bytes:
    """Five bytes below the leading ones; with the shard they tell enough apart. A
    clash only adds a candidate."""
    return np.ascontiguousarray((signatures >> U(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def candidate_edges(docs: DataFrame, width: int, link: int) -> DataFrame:
    """(a, b) of sets that share a signature, as stars around the smallest."""
    size = planned_bytes(docs.select("text"))
    shards = 1 << max(6, int(size // SHARD_BYTES).bit_length())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, have, names, count, known = Bands(link), [], [], 0, set()

        def flush() -> pa.RecordBatch:
            s, n = np.concatenate(have), np.concatenate(names)
            order = np.lexsort((n, s))
            s, n = s[order], n[order]
            each = runs(s)
            # what shares a signature here links here; the smallest set asks for all of them
            star = np.repeat(n[each[:-1]], np.diff(each))
            here = np.unique(np.stack([star, n])[:, star != n], axis=1)
            s, n = s[each[:-1]], n[each[:-1]]
            edges = shard_edges(s, shards)
            some = np.flatnonzero(np.diff(edges))
            owner = np.searchsorted(some, here[0].view(U) % U(shards)) % max(1, len(some))
            order = np.argsort(owner, kind="stable")
            here, cuts = here[:, order], np.searchsorted(owner[order], np.arange(len(some) + 1))
            rows = []
            for i, k in enumerate(some):
                part = np.argsort(n[edges[k] : edges[k + 1]], kind="stable") + edges[k]
                each = runs(n[part])
                rows.append((_five(s[part]), n[part][each[:-1]].tobytes(), np.diff(each).astype("<u4").tobytes(), here[:, cuts[i] : cuts[i + 1]].tobytes()))
            have.clear(), names.clear(), known.clear()
            columns = [pa.array([r[c] for r in rows], pa.binary()) for c in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *columns], names=["shard", "signatures", "sets", "counts", "here"])

        for batch in batches:
            for _, elements in shingle_sets(batch.column(0), width):
                if not len(elements):
                    continue
                name = set_hash(elements)
                if name in known:
                    continue
                known.add(name)
                own = signatures(elements, bands)
                if not len(own):
                    continue
                have.append(own)
                names.append(np.full(len(own), name))
                count += len(own)
                if count > FLUSH:
                    yield flush()
                    count = 0
        if have:
            yield flush()

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = np.zeros((sum(len(b.as_py()) for b in table["signatures"]) // 5, 8), np.uint8)
        s[:, :5] = np.frombuffer(b"".join(b.as_py() for b in table["signatures"]), np.uint8).reshape(-1, 5)
        s = s.view("<u8").ravel()
        n = np.concatenate([np.repeat(np.frombuffer(b.as_py(), np.int64), np.frombuffer(c.as_py(), "<u4")) for b, c in zip(table["sets"], table["counts"])])
        order = np.lexsort((n, s))
        s, n = s[order], n[order]
        edges = runs(s)
        star = np.repeat(n[edges[:-1]], np.diff(edges))
        there = [np.frombuffer(b.as_py(), np.int64).reshape(2, -1) for b in table["here"]]
        pairs = np.unique(np.concatenate([np.stack([star, n])[:, star != n], *there], axis=1), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    small_batches(docs.sparkSession)
    signed = docs.select("text").mapInArrow(sign, "shard long, signatures binary, sets binary, counts binary, here binary")
    return signed.groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 blocks of the elements that
    both sides hold."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    # an element that a single set holds on both sides joins nothing but itself
    place_a, place_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    in_a = shared[np.minimum(place_a, len(shared) - 1)] == flat_a if len(shared) else np.zeros(len(flat_a), bool)
    in_b = shared[np.minimum(place_b, len(shared) - 1)] == flat_b if len(shared) else np.zeros(len(flat_b), bool)
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        left, right = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        pick = in_a & (place_a >= low) & (place_a < low + COLUMNS)
        left[row_a[pick], place_a[pick] - low] = 1
        pick = in_b & (place_b >= low) & (place_b < low + COLUMNS)
        right[row_b[pick], place_b[pick] - low] = 1
        out += left @ right.T
    return out.astype(np.int64)


def block_links(a: list[np.ndarray], b: list[np.ndarray], link: int) -> np.ndarray:
    """Boolean matrix: which sets of ``a`` and ``b`` link."""
    same = intersections(a, b)
    size = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    return 100 * same >= link * (size - same)


def _spanning(names: np.ndarray, links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[list, list]:
    """(a, b): a star for each component of the linked rows and columns."""
    root = np.arange(len(names))
    at = np.nonzero(links)
    x, y = rows[at[0]], columns[at[1]]
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        root = root[root]
        if (root == before).all():
            break
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[root[other]].tolist(), names[other].tolist()


def _link_blocks(link: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """One pair of blocks of a component: (set, block, elements)."""
        names, block = table["set"].to_numpy(), table["block"].to_numpy()
        elements = [np.frombuffer(e.as_py(), U) for e in table["elements"]]
        i, j = key[1].as_py(), key[2].as_py()
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        if len(rows) and len(columns):
            pick = lambda at: [elements[k] for k in at]
            a, b = _spanning(names, block_links(pick(rows), pick(columns), link), rows, columns)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _join_sketches(link: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Sketches of one block, or of two, of a component's sets: (set, size, side, sketch).
        A star for each component of those that may link."""
        names, size = table["set"].to_numpy(), table["size"].to_numpy()
        side, rows = table["side"].to_numpy(), sketch_rows(table["sketch"].to_pylist())
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # 0: on both
        root, step = np.arange(len(names)), max(1, (1 << 19) // max(1, len(right)))
        for low in range(0, len(left), step):
            part = left[low : low + step]
            at = np.nonzero(may_link(rows[part], size[part], rows[right], size[right], link))
            x, y = part[at[0]], right[at[1]]
            while (root[x] != root[y]).any():
                np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
                while (root[root] != root).any():
                    root = root[root]
        other = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[root[other]], "b": names[other]})

    return run


def _level(size, link: int):
    """Sizes of sets that link differ by one level at most; the hundredth more keeps
    rounding out of it."""
    return F.floor(F.log(size) / math.log(1.01 * 100 / link)).cast("long")


def divided(found: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """(node, root) of ``found``, components of more than ``FEW`` sets divided by sketches.
    A component's sets meet by blocks of one level of sizes, and of the next one."""
    sizes = found.groupBy("root").agg(F.count("*").alias("members"))
    large = found.join(sizes.where(F.col("members") > FEW), "root").select("node", "root")
    drawn = sets.where("set is not null").groupBy("set").agg(F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size"))
    drawn = cut(large.join(drawn, F.col("node") == F.col("set")).select("root", "set", "size", _level(F.col("size"), link).alias("level"), "sketch"))
    if drawn.isEmpty():
        return found
    needed = F.greatest(F.count("*") / SKETCHES, F.sum(F.length("sketch")) / SKETCH_BYTES)
    grid = drawn.groupBy("root", "level").agg(F.ceil(needed).cast("long").alias("blocks"))
    above = grid.select("root", (F.col("level") - 1).alias("level"), F.col("blocks").alias("above"))
    below = grid.select("root", (F.col("level") + 1).alias("level"), F.col("blocks").alias("below"))
    grid = cut(grid.join(above, ["root", "level"], "left").join(below, ["root", "level"], "left"))
    placed = drawn.join(grid, ["root", "level"]).withColumn("own", F.pmod(F.xxhash64("set"), "blocks"))
    # (at, i, j, side): blocks i and j of level ``at``, or i of it and -1 - j of the next one
    meets = """concat(
        transform(sequence(0L, blocks - 1), k -> struct(level as at, least(own, k) as i, greatest(own, k) as j, case when k = own then 0 when own < k then 1 else 2 end as side)),
        if(above is null, array(), transform(sequence(0L, above - 1), k -> struct(level as at, own as i, -1 - k as j, 1 as side))),
        if(below is null, array(), transform(sequence(0L, below - 1), k -> struct(level - 1 as at, k as i, -1 - own as j, 2 as side))))"""
    meet = placed.select("root", "set", "size", "sketch", F.explode(F.expr(meets)).alias("m")).select("root", "m.*", "set", "size", "sketch")
    joined = components(meet.groupBy("root", "at", "i", "j").applyInArrow(_join_sketches(link), "a long, b long"))
    return cut(found.join(sizes.where(F.col("members") <= FEW), "root").select("node", "root").unionByName(joined))


def _elements_of(docs: DataFrame, wanted: DataFrame, width: int, repeated: bool) -> DataFrame:
    """``wanted`` (set, id, at, ...) with each set's ``elements``, from its holder's
    text; once, also where rows repeat the holder."""
    more = [c for c in wanted.columns if c not in ("id", "at")]
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("is")).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("is") == F.col("at"))).select(*more, "text")
    if repeated:
        texts = texts.dropDuplicates(["set"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = dict(shingle_sets(batch.column(batch.num_columns - 1), width))
            keep = [k for k in range(batch.num_rows) if len(got[k]) and set_hash(got[k]) == batch.column(0)[k].as_py()]
            rows = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([got[k].tobytes() for k in keep], pa.binary())], names=[*more, "elements"])

    small_batches(docs.sparkSession)
    return texts.mapInArrow(load, ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in more) + ", elements binary")


def link_classes(docs: DataFrame, sets: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """(node, root) of every set that links with a different one."""
    found = divided(cut(components(candidate_edges(docs, width, link))), sets, link)
    sizes = found.groupBy("root").agg(F.count("*").alias("members"))
    # one document stands for all that have its set; ``n`` rows may repeat it
    holder = sets.where("set is not null").groupBy("set", "doc_id", "at").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    holder = holder.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "n", "size")).alias("h"))
    level = _level(F.col("h.size"), link).alias("level")
    plan = found.join(sizes, "root").select("node", "root", F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks"))
    plan = cut(plan.join(holder, F.col("node") == F.col("set")).select("set", "root", "blocks", F.pmod("set", "blocks").alias("block"), level, F.col("h.doc_id").alias("id"), "h.at", "h.n"))
    repeated = not plan.where("n > 1").isEmpty()
    meeting = "a long, b long"
    # every block meets the pivots, block 0; most components have no other
    loaded = cut(_elements_of(docs, plan.drop("n"), width, repeated))
    other = F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    meet = loaded.withColumn("j", F.explode(other)).select("root", F.lit(0).cast("long").alias("i"), "j", "set", "block", "elements")
    edges = meet.groupBy("root", "i", "j").applyInArrow(_link_blocks(link), meeting)
    large = plan.where("blocks > 1")
    if large.isEmpty():
        return components(edges)
    edges = cut(edges)
    classes = large.join(components(edges).select("node", F.col("root").alias("class")), F.col("set") == F.col("node"), "left").select("set", large["root"], "level", F.coalesce("class", "set").alias("class"))
    main = classes.groupBy("root", "class").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "class"))["class"].alias("main"))
    others = cut(classes.join(main, "root").where(F.col("class") != F.col("main")).select("root", "set", "level"))
    if others.isEmpty():
        return components(edges)
    # sets outside the largest class meet what of their component can be similar by size:
    # the sets of their own level of sizes and of the two beside it
    asking = others.withColumn("at", F.explode(F.expr("sequence(level - 1, level + 1)")))
    members = classes.groupBy("root", F.col("level").alias("at")).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("columns"))
    grid = cut(asking.groupBy("root", "at").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("rows")).join(members, ["root", "at"]))
    whole = loaded.where("blocks > 1").select("root", "set", "level", "elements")
    column = whole.withColumn("at", F.col("level")).join(grid, ["root", "at"]).withColumn("j", F.pmod("set", "columns") + 1).withColumn("i", F.explode(F.expr("sequence(-rows, -1L)")))
    row = whole.join(asking.select("root", "set", "at"), ["root", "set"]).join(grid, ["root", "at"]).withColumn("i", -1 - F.pmod("set", "rows")).withColumn("j", F.explode(F.expr("sequence(1L, columns)")))
    key = ["root", "i", "j", "at"]
    meet = column.select(*key, "set", F.col("j").alias("block"), "elements").unionByName(row.select(*key, "set", F.col("i").alias("block"), "elements"))
    return components(edges.unionByName(meet.groupBy(*key).applyInArrow(_link_blocks(link), meeting)))


def classes_of(docs: DataFrame, sets: DataFrame, width: int, link: int) -> DataFrame:
    """(set, least, class): the component of every distinct set, and its least id."""
    roots = link_classes(docs, sets, width, link)
    least = sets.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    return cut(least.join(roots, least["set"] == roots["node"], "left").select("set", "least", F.coalesce("root", "set").alias("class")))


def classify(docs: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; sets of ``width`` words link from
    ``link`` percent on."""
    sets = cut(sets_of(docs, width))
    classes = classes_of(docs, sets, width, link)
    some, none = sets.where("set is not null"), sets.where("set is null")
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "class").select(F.col("set").alias("of"), "component_id")
    joined = some.join(named, F.col("set") == F.col("of")).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """Pipeline form: of each component the row with the smallest id stays, a null id
    last; of rows that share this id the one with the smallest digest."""
    sets = cut(sets_of(docs, width, digests=True))
    classes = classes_of(docs, sets, width, link).select(F.col("set").alias("of"), "class")
    rows = sets.where("set is not null").join(classes, F.col("set") == F.col("of")).select("class", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("row"))
    first = rows.groupBy("class").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("class", "in")
    more = cut(rows.join(first, F.col("class") == F.col("in")).select("row.doc_id", "row.digest", (F.col("row") == F.col("first")).alias("stays")))
    twice = more.where("stays").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    return without(docs, more.where("not stays"), twice)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), **OP4)


ORACLE = {
    "op4_jaccard_join": r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS g
  FROM d),
c AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT rep, n, unnest(g) AS x FROM c),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep <> b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS node, rep AS root FROM c UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(least.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN least ON c.rep = least.node
""",
}
