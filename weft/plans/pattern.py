"""Graph patterns as join plans.

A pattern is (subject, path, object); terms that start with ``?`` are variables,
all others constants; the path may be a variable as well, over all relations of a
graph. Patterns join on the variables they share; rows are made distinct at the end. Conditions,
absent groups (anti-joins on shared variables) and alternatives are applied after
all joins, so their place in the query does not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.paths import Path, dealt, pairs, pairs_from, parts_for, recursive
from ..sources.graph import TYPE, Graph

Pattern = tuple
EXACT = 10


def _is_variable(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def _table(graph: Graph, pattern: Pattern, bound: DataFrame | None = None) -> DataFrame:
    """A pattern's bindings; rows may repeat. A path with ``+`` or ``*`` starts at an end
    that is a constant, or that ``bound``, the bindings so far, name: only what is reached
    from there is made. All pairs are, where both ends are open."""
    subject, path, object_ = pattern
    if path == "a" and not _is_variable(object_):
        df = graph.instances(object_)
        return df.select(F.col("name").alias(subject[1:])) if _is_variable(subject) else df.where(F.col("name") == F.lit(subject)).limit(1).select()
    terms = [("s", subject), ("o", object_)]
    if _is_variable(path):
        df = graph.as_triples()
        terms.append(("p", path))
    elif (end := _known_end(subject, object_, bound)) is not None and recursive(path):
        term = (subject, object_)[end]
        seeds = bound.select(F.col(term[1:]).alias("name")) if _is_variable(term) else graph.spark.range(1).select(F.lit(term).alias("name"))
        df = pairs_from(graph, path, seeds, back=end == 1)
    else:
        df = pairs(graph, path, distinct=False)
    seen: dict[str, str] = {}
    for column, term in terms:
        if not _is_variable(term):
            df = df.where(F.col(column) == F.lit(term))
        elif term[1:] in seen:
            df = df.where(F.col(column) == F.col(seen[term[1:]]))
        else:
            seen[term[1:]] = column
    return df.select(*[F.col(c).alias(v) for v, c in seen.items()])


def _known_end(subject, object_, bound: DataFrame | None) -> int | None:
    """0: the subject is known, 1: the object; a constant before a bound variable."""
    known = [not _is_variable(t) for t in (subject, object_)]
    if not any(known) and bound is not None:
        known = [t[1:] in bound.columns for t in (subject, object_)]
    return known.index(True) if any(known) else None


def any_relation(graph: Graph, subject: str, object_: str) -> DataFrame:
    """(subject, object) of any relation: the whole triples table."""
    return graph.as_triples().select(F.col("s").alias(subject), F.col("o").alias(object_)).distinct()


def _estimate(graph: Graph, pattern: Pattern) -> tuple[float, dict[str, float]]:
    """(rows, distinct values of each variable) of a pattern, by the statistics. A path's
    are unknown: it counts as all triples."""
    subject, path, object_ = pattern
    every = sum(k.triples for k in graph.statistics.values()) or 1
    known = graph.statistics.get(TYPE if path == "a" else path) if isinstance(path, str) else None
    if known is None and isinstance(path, str) and not _is_variable(path):
        return 0.0, {t: 0.0 for t in pattern if _is_variable(t)}
    rows, subjects, objects = (known.triples, known.subjects, known.objects) if known else (every, every, every)
    n = float(rows)
    for term, distinct in ((subject, subjects), (object_, objects)):
        if not _is_variable(term):
            n /= max(1, distinct)
    values = {t: min(n, float(d)) for t, d in ((subject, subjects), (object_, objects)) if _is_variable(t)}
    if _is_variable(path):
        values[path] = min(n, float(len(graph.statistics)))
    return n, values


def _joined(a: tuple[float, dict[str, float]], b: tuple[float, dict[str, float]]) -> tuple[float, dict[str, float]]:
    n = a[0] * b[0]
    for v in a[1].keys() & b[1].keys():
        n /= max(1.0, a[1][v], b[1][v])
    values = {v: min(n, *(side[1][v] for side in (a, b) if v in side[1])) for v in a[1].keys() | b[1].keys()}
    return n, values


def join_order(graph: Graph, patterns: Sequence[Pattern]) -> list[Pattern]:
    """The order whose intermediate results are smallest in sum, by the graph's statistics;
    each pattern shares a variable with those before it where one does. Up to ``EXACT`` patterns
    the best one of all, kept for each set of patterns; beyond, the best next one each time.
    Without statistics: most constants first."""
    if not graph.statistics or any(isinstance(p[1], str) and p[1] in graph.relations for p in patterns):
        return sorted(patterns, key=lambda p: -sum(not _is_variable(t) for t in (p[0], p[2])))
    sizes = [_estimate(graph, p) for p in patterns]
    # cost, order and estimate of the best way to join each set
    best = {frozenset([i]): (size[0], [i], size) for i, size in enumerate(sizes)}
    if len(patterns) > EXACT:
        start = min(best.values(), key=lambda x: (x[0], x[1]))
        best = {frozenset(start[1]): start}
    for _ in range(len(patterns) - 1):
        grown: dict[frozenset, tuple] = {}
        for chosen, (cost, order, size) in best.items():
            rest = [i for i in range(len(patterns)) if i not in chosen]
            near = [i for i in rest if sizes[i][1].keys() & size[1].keys()]
            for i in near or rest:
                both = _joined(size, sizes[i])
                way = (cost + both[0], [*order, i], both)
                key = chosen | {i}
                if key not in grown or way[:2] < grown[key][:2]:
                    grown[key] = way
        best = grown if len(patterns) <= EXACT else dict([min(grown.items(), key=lambda x: x[1][:2])])
    return [patterns[i] for i in min(best.values(), key=lambda x: x[:2])[1]]


def _large(df: DataFrame) -> bool:
    """Whether Spark will not send a table to all tasks, by its own estimate."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most


def bindings(graph: Graph, patterns: Sequence[Pattern]) -> DataFrame:
    """Joined in an order in which each pattern shares a variable with those
    before it; see ``join_order``. Large tables are dealt by what they share, in as many parts as
    their bytes ask for: rows that join are many more, and are made distinct there."""
    left = join_order(graph, patterns)
    plain = [p for p in left if not recursive(p[1])]
    parts = parts_for(*[_table(graph, p) for p in plain]) if len(plain) > 1 else None
    out, known, by = None, set(), None
    while left:
        at = next((i for i, p in enumerate(left) if known & {t for t in p if _is_variable(t)}), 0)
        p = left.pop(at)
        table, own = _table(graph, p, out), {t for t in p if _is_variable(t)}
        shared = sorted(t[1:] for t in known & own)
        if out is not None and not shared:
            raise ValueError(f"{p} shares no variable with the patterns before it")
        if out is not None and parts and _large(table) and _large(out):
            out, by = out if by == shared else dealt(out, parts, *shared), shared
            table = dealt(table, parts, *shared)
        out = table if out is None else out.join(table, shared, "left_semi" if own <= known else "inner")
        known |= own
    return out


def _steps(patterns: Sequence[Pattern]) -> list[Pattern]:
    """Sequences and inverse steps as patterns of their own, over variables of their own."""
    out: list[Pattern] = []
    todo, at = list(patterns), 0
    while todo:
        s, path, o = todo.pop(0)
        plain = isinstance(path, Path) and not recursive(path)
        if plain and path.kind == "inverse":
            todo.insert(0, (o, path.parts[0], s))
        elif plain and path.kind == "seq" and "a" not in path.parts:
            ends = [s, *(f"?__step{at + k}" for k in range(1, len(path.parts))), o]
            at += len(path.parts)
            todo[:0] = [(ends[k], p, ends[k + 1]) for k, p in enumerate(path.parts)]
        else:
            out.append((s, path, o))
    return out


def _holding(graph: Graph, patterns: Sequence[Pattern], keep: Sequence[str], bound: DataFrame | None) -> DataFrame:
    """Bindings of ``keep`` for which the patterns hold; rows may repeat. They start at the
    ``bound`` ones, if given. Other variables only have to exist: each is dropped, and rows made
    distinct, as soon as no pattern left names it."""
    left = join_order(graph, patterns if bound is not None else _steps(patterns))
    if bound is None:  # from the far end: what is kept comes last
        left = sorted(left, key=lambda p: any(t[1:] in keep for t in p if _is_variable(t)))
    out, known = bound, set() if bound is None else {f"?{c}" for c in bound.columns}
    while left:
        at = next((i for i, p in enumerate(left) if known & {t for t in p if _is_variable(t)}), 0)
        p = left.pop(at)
        table, own = _table(graph, p, out), {t for t in p if _is_variable(t)}
        shared = sorted(t[1:] for t in known & own)
        if out is not None and not shared:
            raise ValueError(f"{p} shares no variable with the patterns before it")
        out = table if out is None else out.join(table, shared, "left_semi" if own <= known else "inner")
        known |= own
        asked = {f"?{c}" for c in keep} | {t for q in left for t in q if _is_variable(t)}
        if known - asked:
            known &= asked
            out = out.select(*sorted(t[1:] for t in known))
            out = out.distinct() if left and bound is None else out
    return out.select(*keep)


def match(graph: Graph, patterns: Sequence[Pattern], *, where: Callable | None = None, absent: Sequence = (), present: Sequence = (), select: Sequence[str] | None = None) -> DataFrame:
    """Distinct bindings. ``absent``: groups of patterns of which none may hold.
    ``present``: alternatives; each entry is a list of groups of which one must.
    A group is a list of patterns, or (patterns, condition)."""
    out = bindings(graph, patterns)
    if where is not None:
        out = out.where(where)

    def group(g) -> tuple[DataFrame, list[str]]:
        inner, condition = g if isinstance(g, tuple) else (g, None)
        own = {x[1:] for p in inner for x in p if _is_variable(x)}
        shared = [c for c in out.columns if c in own]
        if condition is not None:
            return bindings(graph, inner).where(condition).select(*shared), shared
        # what ties several variables is looked for at the bindings there are, not for all nodes
        bound = out.select(*shared).distinct() if len(shared) > 1 and len(inner) > 1 else None
        return _holding(graph, inner, shared, bound), shared

    for g in absent:
        df, shared = group(g)
        out = out.join(df, shared, "left_anti")
    for choices in present:
        parts = [group(g) for g in choices]
        both = reduce(lambda a, b: a.unionByName(b), [df for df, _ in parts])
        out = out.join(both, parts[0][1], "left_semi")
    return (out.select(*select) if select else out).distinct()
