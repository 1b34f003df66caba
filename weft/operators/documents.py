"""What one block document says of itself: a helper for tasks, over the Arrow batches of
``ingest.document_warnings``."""

from __future__ import annotations

import json

#: fixed values, as in ``ingest``
REFS = {"input": "S231:hasInput", "output": "S231:hasOutput", "parameter": "S231:hasParameter", "sub_block": "S231:containsBlock"}
PORT_TYPES = {"S231:RealInput": "Real", "S231:RealOutput": "Real", "S231:BooleanInput": "Boolean", "S231:BooleanOutput": "Boolean", "S231:IntegerInput": "Integer", "S231:IntegerOutput": "Integer"}
OWN_TYPES = "S231:"
UNKNOWN = "Unknown"
DECLARES = ("S231:Block", "S231:EnumerationType")

#: columns of a fact: ``ref`` rows are references that may be wrong, with a node of their id if
#: there is one (``met``); ``type`` nodes that are a block or an enumeration; ``bare`` documents
#: without one; ``rest`` documents of another shape, as they are
FACT = {
    "what": "string", "text": "string", "body": "binary", "block": "string", "kind": "string", "position": "int", "ref_id": "string",
    "met": "boolean", "label": "string", "value": "string", "declared": "string", "target_types": "array<string>", "is_port": "boolean",
}


class _Odd(ValueError):
    """A shape that Spark's functions may read in another way: left to them."""


def _integer(text):
    if text == "-0":
        raise _Odd
    return text


def _refused(text):
    raise _Odd


_DECODER = json.JSONDecoder(parse_int=_integer, parse_float=_refused, parse_constant=_refused)


def _plain(x):
    """A text that does not look like JSON."""
    if x is None or isinstance(x, str) and x.lstrip()[:1] not in ("{", "["):
        return x
    raise _Odd


def _held(x, key):
    """A text, or that of an object's key."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if not isinstance(x, dict):
        return _plain(x)
    if not isinstance(x.get(key), str):
        raise _Odd
    return x[key]


def _types(x):
    if isinstance(x, list):
        if not all(t is None or isinstance(t, str) for t in x):
            raise _Odd
        return x
    return None if x is None else [_plain(x)]


def _declared(node):
    x = node.get("S231:isOfDataType")
    return _held(x, "@id") if isinstance(x, dict) else _plain(x) and None


def _references(node):
    """(block, kind, position, id)."""
    block, out = node.get("@id"), []
    for kind, key in REFS.items():
        x = node.get(key)
        if x is None:
            continue
        if not isinstance(x, (list, dict)):
            raise _Odd
        for at, ref in enumerate(x if isinstance(x, list) else [x]):
            id_ = _held(ref, "@id")
            if id_ is None or ref is True or ref is False:
                raise _Odd
            out.append((block, kind, at, id_))
    return out


def _met(node, types):
    """What is read of a node that a reference leads to: columns from ``met`` to ``target_types``."""
    return True, _held(node.get("S231:label"), "@value") or None, _held(node.get("S231:value"), "@value"), _declared(node), types


_UNMET = (None,) * 5
_KEYS = frozenset(REFS.values())


def facts(text: str) -> list[tuple]:
    """Facts of a document, as columns of ``FACT``. ``_Odd`` or another ``ValueError`` where it
    is of another shape."""
    if text.count('"@graph"') > 1 or "\\ud" in text or "\\uD" in text:
        raise _Odd
    document = _DECODER.decode(text)
    if not isinstance(document, dict):
        raise _Odd
    graph = document.get("@graph", [])
    if not isinstance(graph, list):
        raise _Odd
    out, nodes, refs, some, none = [], {}, [], False, False
    for node in graph:
        if not isinstance(node, dict):
            raise _Odd
        id_, types = node.get("@id"), _types(node.get("@type"))
        if id_ is not None:
            if not isinstance(id_, str):
                raise _Odd
            nodes.setdefault(id_, []).append((node, types))
        if not _KEYS.isdisjoint(node):
            refs += _references(node)
        if types and (DECLARES[0] in types or DECLARES[1] in types):
            out.append(("type", id_, None, None, None, None, None, None, None, None, None, types, None))
            some = True
        elif not types or None not in types:
            none = True
    if none and not some:
        out.append(("bare", *(None,) * 12))
    ports = {(block, id_) for block, kind, _, id_ in refs if kind != "sub_block"}
    for ref in refs:
        block, kind, _, id_ = ref
        port = block is not None and (kind != "sub_block" or (block, id_) in ports)
        found = nodes.get(id_)
        if found is None and kind != "sub_block":
            out.append(("ref", None, None, *ref, *_UNMET, port))
        for node, types in found or ():
            own = types[0] if types else None
            if kind == "sub_block":
                wrong = own is not None and not own.startswith(OWN_TYPES)
            elif kind == "parameter":
                declared = _declared(node)
                wrong = declared is None or UNKNOWN in declared
            else:
                wrong = own not in PORT_TYPES
            if wrong:
                out.append(("ref", None, None, *ref, *_met(node, types), port))
    return out


def told(batches):
    """(file, facts) of Arrow batches of (file, body)."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    for batch in batches:
        rows, at = [], []
        named = batch.column("file").is_valid().to_pylist()
        for k, body in enumerate(batch.column("body").to_pylist()):
            if body is None:
                continue
            try:
                if not named[k]:
                    raise _Odd
                found = facts(body.decode())
            except (ValueError, RecursionError):
                found = [("rest", None, body, *(None,) * 10)]
            rows += found
            at += [k] * len(found)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(FACT), map(kinds.get, FACT.values()))]
        yield pa.RecordBatch.from_arrays([batch.column("file").take(pa.array(at, pa.int32())), *columns], ["file", *FACT])
