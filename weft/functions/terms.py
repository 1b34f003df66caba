"""Term and naming functions: Column in, Column out, no UDF."""

from __future__ import annotations

import keyword
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_name(iri) -> Column:
    """After the last ``#``; else after the last ``/``, a trailing one ignored."""
    iri = _c(iri)
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(F.regexp_replace(iri, "/+$", ""), "/", -1))


def namespace(iri) -> Column:
    iri = _c(iri)
    return F.substring(iri, F.lit(1), F.length(iri) - F.length(local_name(iri)))


def snake_case(name) -> Column:
    """``-`` becomes ``_``, a split before every capital, no double ``_``."""
    split = F.regexp_replace(F.replace(_c(name), F.lit("-"), F.lit("_")), "(?<!^)(?=[A-Z])", "_")
    return F.lower(F.regexp_replace(split, "_+", "_"))


def strip_has_is(name) -> Column:
    return F.regexp_replace(_c(name), "^(has|is)(?=[A-Z])", "")


def avoid_keyword(name) -> Column:
    name = _c(name)
    return F.when(name.isin(*keyword.kwlist), F.concat(name, F.lit("_"))).otherwise(name)


def field_name_for_path(iri) -> Column:
    return avoid_keyword(snake_case(strip_has_is(local_name(iri))))


def last_segment(name, mark: str = "-") -> Column:
    return F.substring_index(_c(name), mark, -1)


def field_name_for_qualified(iri) -> Column:
    return avoid_keyword(snake_case(last_segment(local_name(iri))))


def class_name_for(iri) -> Column:
    last, whole = last_segment(local_name(iri)), local_name(iri)
    name = F.regexp_replace(F.when(last == "", whole).otherwise(last), "[^0-9A-Za-z_]", "_")
    return avoid_keyword(F.when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name))


def module_segment(name) -> Column:
    """Snake case that keeps acronyms together; a name that a module can have."""
    plain = F.replace(_c(name), F.lit("-"), F.lit("_"))
    split = F.regexp_replace(plain, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return avoid_keyword(F.lower(F.regexp_replace(split, "_+", "_")))


def pascal_case(name) -> Column:
    return F.array_join(F.transform(F.split(_c(name), "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def dotted_parts(path) -> tuple[Column, Column]:
    """What is before and after the last dot; before is '' without one."""
    path = _c(path)
    return F.regexp_extract(path, r"^(.*)\.([^.]*)$", 1), F.substring_index(path, ".", -1)


def variable_name(name) -> Column:
    return F.replace(_c(name), F.lit("-"), F.lit("_"))


def compact(iri, prefixes: dict[str, str]) -> Column:
    """``prefix:local`` by the longest namespace that the term starts with."""
    iri = _c(iri)
    by_length = sorted(prefixes.items(), key=lambda x: len(x[1]))
    return reduce(lambda other, p: F.when(iri.startswith(p[1]), F.concat(F.lit(p[0] + ":"), F.substring(iri, len(p[1]) + 1, 1 << 20))).otherwise(other), by_length, iri)


def expand(name, prefixes: dict[str, str]) -> Column:
    name = _c(name)
    lookup = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    found = F.element_at(lookup, F.substring_index(name, ":", 1))
    return F.when(found.isNotNull() & name.contains(":"), F.concat(found, F.regexp_replace(name, "^[^:]*:", ""))).otherwise(name)


def typed_value(text) -> Column:
    """struct(kind, number, text): what a default's text stands for. A text with a
    point or exponent is a double if it reads as one, else a long, else it stays."""
    text = _c(text)
    whole = text.try_cast("bigint")
    # a cast that fails is slow: words other than NaN and Infinity are not tried
    real = F.when(text.rlike(r"^[\x00-\x20]*[-+.0-9NnIi]"), text.try_cast("double"))
    kind = F.when(text.isNull(), None).when(text.rlike("[.eE]") & real.isNotNull(), "double").when(whole.isNotNull(), "long").when(F.lower(text).isin("true", "false"), "boolean").otherwise("string")
    return F.struct(kind.alias("kind"), real.alias("number"), text.alias("text"))


def with_default_unit(unit, quantity_kind, defaults: dict[str, str], last: str | None = None) -> Column:
    """The data's own unit; only where it has none the kind's default, then ``last``."""
    lookup = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.coalesce(_c(unit), F.element_at(lookup, _c(quantity_kind)), F.lit(last))
