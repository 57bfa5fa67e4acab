"""Reading details texts: JSON, or a JSON string that holds JSON, of any depth and with numbers of any length."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

BLANK = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
WORDS = {"null": None, "true": True, "false": False}
#: Integers of more digits stay texts: the interpreter refuses to convert them.
LONGEST_INTEGER = 4300


class LongNumber(str):
    """A number kept as it is written."""


def _refuse(name: str):
    raise json.JSONDecodeError("not JSON", name, 0)


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def _scalar_at(text: str, at: int):
    if text[at] == '"':
        return scanstring(text, at + 1, True)
    for word, value in WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    found = NUMBER.match(text, at)
    if not found:
        raise ValueError(at)
    whole, fraction, power = found.groups()
    if fraction or power:
        return float(found[0]), found.end()
    return (int(whole) if len(whole) <= LONGEST_INTEGER else LongNumber(whole)), found.end()


def patient_decode(text: str):
    """The library's grammar without recursion: an explicit stack of the containers that are open."""
    skip = lambda at: BLANK.match(text, at).end()
    open_: list[tuple[dict | list, str | None]] = []
    at, key = skip(0), None
    while True:
        if at >= len(text):
            raise ValueError(at)
        c, value, closed = text[at], None, True
        if c in "{[":
            value, end = ({} if c == "{" else []), skip(at + 1)
            closed = text[end : end + 1] == ("}" if c == "{" else "]")
            if closed:
                end += 1
        else:
            value, end = _scalar_at(text, at)
        if not closed:
            open_.append((value, key))
        while closed:
            # The value is whole: it goes into what is open, and may close it in turn.
            if not open_:
                if skip(end) != len(text):
                    raise ValueError(end)
                return value
            holder, outer = open_[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[key] = value
            end = skip(end)
            mark = text[end : end + 1]
            if mark == ",":
                end, closed = skip(end + 1), False
            elif mark == ("]" if isinstance(holder, list) else "}"):
                open_.pop()
                value, key, end = holder, outer, end + 1
            else:
                raise ValueError(end)
        at = end
        if isinstance(open_[-1][0], dict):
            if text[at : at + 1] != '"':
                raise ValueError(at)
            key, at = scanstring(text, at + 1, True)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError(at)
            at = skip(at + 1)


def _read(text: str):
    try:
        return _decode(text)
    except json.JSONDecodeError:
        raise
    except (RecursionError, ValueError):  # too deep, or an integer of too many digits, for the library
        return patient_decode(text)


def read_json(text: str | None):
    """The value of a JSON text, or of the JSON text inside a JSON string; None if neither can be read. NaN and infinities aren't JSON."""
    if not text:
        return None
    try:
        value = _read(text)
        return _read(value) if isinstance(value, str) and not isinstance(value, LongNumber) else value
    except ValueError:
        return None


def read_details(text: str | None) -> dict | list | None:
    """The object or list that a details text holds, or None."""
    value = read_json(text)
    return value if isinstance(value, (dict, list)) else None
