"""JSON texts of any depth, and the string literals in them."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"(?:true|false|null)|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
#: A string literal; its closing quote is missing in texts that are cut short.
LITERAL = re.compile(r'"((?:[^"\\]|\\.)*+)("|\\?\Z)', re.DOTALL)


def _refuse(name: str) -> None:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def loads(text: str) -> object:
    """Value of a JSON text; ValueError if it is none (NaN and Infinity are none either)."""
    try:
        return _decode(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str) -> object:
    """As ``loads``, without recursion."""
    stack: list[list] = []
    at = 0

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    at = skip(at)
    while True:
        c = text[at : at + 1]
        if c == "{" or c == "[":
            end = skip(at + 1)
            if text[end : end + 1] == ("}" if c == "{" else "]"):
                value, at = ({} if c == "{" else []), end + 1
            else:
                stack.append([{} if c == "{" else [], None])
                at = end
                if c == "{":
                    at = _key(text, at, stack[-1], skip)
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1)
        elif m := _PLAIN.match(text, at):
            value, at = json.loads(m.group()), m.end()
        else:
            raise ValueError(at)
        while True:
            at = skip(at)
            if not stack:
                if at != len(text):
                    raise ValueError(at)
                return value
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(holder, dict):
                    at = _key(text, at, stack[-1], skip)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(at)
            value, at = holder, at + 1
            stack.pop()


def _key(text: str, at: int, top: list, skip) -> int:
    if text[at : at + 1] != '"':
        raise ValueError(at)
    top[1], at = scanstring(text, at + 1)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(at)
    return skip(at + 1)
