"""Complete, strict JSON reading and an iterative walk into path-value-ordinal triples."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")
_BLANK = re.compile(r"[ \t\r\n]*")


def _no_constant(name: str):
    raise ValueError(name)


def _iterative(text: str):
    """Reads nesting of any depth with a stack of its own."""
    at, root, stack, key = _BLANK.match(text, 0).end(), [], [], None
    place = root.append
    expect = "value"
    while True:
        c = text[at : at + 1]
        if expect == "value":
            if c in ("{", "["):
                new: dict | list = {} if c == "{" else []
                place(new)
                stack.append(new)
                at = _BLANK.match(text, at + 1).end()
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    stack.pop()
                    at += 1
                    expect = "next"
                else:
                    expect = "key" if c == "{" else "value"
                    if c == "[":
                        place = new.append
            elif c == '"':
                value, at = scanstring(text, at + 1, True)
                place(value)
                expect = "next"
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise ValueError("value")
                place(json.loads(m[0]))
                at, expect = m.end(), "next"
        elif expect == "key":
            if c != '"':
                raise ValueError("key")
            key, at = scanstring(text, at + 1, True)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("colon")
            at, expect = at + 1, "value"
            place = lambda v, o=stack[-1], k=key: o.__setitem__(k, v)
        else:
            if not stack:
                if at != len(text):
                    raise ValueError("more")
                return root[0]
            top = stack[-1]
            if c == ",":
                at, expect = at + 1, "key" if isinstance(top, dict) else "value"
                if isinstance(top, list):
                    place = top.append
            elif c == ("}" if isinstance(top, dict) else "]"):
                stack.pop()
                at += 1
            else:
                raise ValueError("end")
        at = _BLANK.match(text, at).end()


def complete_json(text: str | None):
    """(True, value) for complete JSON, (False, None) for anything else."""
    if not text:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        pass
    except ValueError:
        return False, None
    try:
        return True, _iterative(text)
    except ValueError:
        return False, None


def clean(text: str) -> str:
    """Text that can be encoded: lone surrogates become question marks."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def kind_of(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "string" if isinstance(value, str) else "object"


def scalar_text(value) -> str | None:
    """A scalar as text; 1 and 1.0 are alike."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e18:
        return str(int(value))
    if isinstance(value, str):
        return clean(value)
    try:
        return str(value)
    except ValueError:  # an integer of too many digits
        return hex(value)


def leaves(value) -> Iterator[tuple[str, object]]:
    """Dotted paths to everything but objects; arrays are leaves. Any depth, in order."""
    if not isinstance(value, dict):
        return
    stack = [("", iter(value.items()))]
    while stack:
        prefix, items = stack[-1]
        for k, v in items:
            path = f"{prefix}.{k}" if prefix else k
            if isinstance(v, dict):
                stack.append((path, iter(v.items())))
                break
            yield path, v
        else:
            stack.pop()


def opened(value):
    """A string that is a whole JSON object or array as what it holds; anything else as it is."""
    while isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "["):
        whole, held = complete_json(value)
        if not whole:
            break
        value = held
    return value


def triples(value, reach: int | None = None) -> Iterator[tuple[int, str, int, object]]:
    """(owner, path, ordinal, scalar) for every scalar and each of its owners.

    An owner is an object, numbered in reading order from 1. The path leads from
    the owner to the scalar, an array step written []; the ordinal is the place
    in the innermost array on that path, -1 outside arrays. JSON that stands in
    a string is walked like any value. With `reach` only owners up to that many
    objects above the scalar are given: as many as the paths asked for have.
    """
    count = 0
    stack: list[tuple[object, tuple[tuple[int, str, int], ...]]] = [(value, ())]
    while stack:
        here, owners = stack.pop()
        here = opened(here)
        if isinstance(here, dict):
            count += 1
            mine = count
            kept = owners if reach is None else owners[-(reach - 1) :] if reach > 1 else ()
            for k, v in reversed(here.items()):
                stack.append((v, tuple((o, f"{p}.{k}" if p else k, n) for o, p, n in kept) + ((mine, k, -1),)))
        elif isinstance(here, list):
            for n in range(len(here) - 1, -1, -1):
                stack.append((here[n], tuple((o, p + "[]", n) for o, p, _ in owners)))
        else:
            for o, p, n in owners:
                yield o, p, n, here


def rows_of(value) -> Iterator[tuple[str, int, int, str, int, object]]:
    """(table, row, parent row, path, ordinal, scalar) of every scalar, by its nearest repeated ancestor.

    That is the innermost object that is an element of an array, else the record
    itself (table '', row 0). The table is its path from the record, rows are
    numbered in reading order, and the parent row is that of the next repeated
    ancestor. The path leads on from it to the scalar; the ordinal is the place
    in the innermost array on that path, -1 outside arrays. Each scalar comes
    once, whatever the depth; JSON that stands in a string is walked too.
    """
    count = 0
    stack: list[tuple[object, str, int, int, str, int, bool]] = [(value, "", 0, -1, "", -1, False)]
    while stack:
        here, table, row, parent, path, ordinal, element = stack.pop()
        here = opened(here)
        if isinstance(here, dict):
            if element:
                count += 1
                table, parent, row, path, ordinal = f"{table}.{path}" if table else path, row, count, "", -1
            for k, v in reversed(here.items()):
                stack.append((v, table, row, parent, f"{path}.{k}" if path else k, ordinal, False))
        elif isinstance(here, list):
            for n in range(len(here) - 1, -1, -1):
                stack.append((here[n], table, row, parent, path + "[]", n, True))
        else:
            yield table, row, parent, path, ordinal, here
