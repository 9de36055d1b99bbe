"""JSON texts of any depth and any quality: one pass with a stack of open containers instead of recursion."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

#: A brace after which an object can go on.
_BEGIN = re.compile(r'\{(?=[ \t\n\r]*["}])')
_BLANK = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")


@dataclass
class _Open:
    """A container that isn't closed yet: where it began, what it has, and the key that waits for its value."""

    start: int
    value: dict | list
    key: str | None = None


class Scanner:
    """Finds the JSON objects that begin at the braces of a text.

    ``done`` has the end and value of each object found, ``dead`` the braces that begin none. An object that lies in another
    one is found with it, and an error settles all braces that are open, so no stretch is read from two of the braces
    of one reading. Only braces within the strings of an object are tried apart: there a string's quotes read the other way round.
    """

    def __init__(self, text: str):
        self.text = text
        self.done: dict[int, tuple[int, dict]] = {}
        self.dead: set[int] = set()

    def read(self, at: int) -> None:
        """Settles the brace at ``at`` and those inside."""
        if at in self.done or at in self.dead:
            return
        text, stack, i = self.text, [], at
        while True:
            if not stack or text[i : i + 1] in ("{", "["):
                if text[i] == "{" and (i in self.dead or i in self.done):
                    if i in self.dead:
                        break
                    i, value = self.done[i]
                else:
                    stack.append(_Open(i, {} if text[i] == "{" else []))
                    i = _BLANK.match(text, i + 1).end()
                    if text[i : i + 1] == ("}" if isinstance(stack[-1].value, dict) else "]"):
                        i, value = i + 1, self._closed(stack, i + 1)
                    elif isinstance(stack[-1].value, list):
                        continue
                    else:
                        i = self._key(stack[-1], i)
                        if i < 0:
                            break
                        continue
            elif found := _STRING.match(text, i):
                i, value = found.end(), json.loads(found.group())
            elif found := _ATOM.match(text, i):
                i, value = found.end(), json.loads(found.group())
            else:
                break
            # a value has ended: put it in its place, and close what closes
            ok = True
            while stack:
                top = stack[-1]
                if isinstance(top.value, dict):
                    top.value[top.key] = value
                else:
                    top.value.append(value)
                i = _BLANK.match(text, i).end()
                mark = text[i : i + 1]
                if mark == ",":
                    i = _BLANK.match(text, i + 1).end()
                    if isinstance(top.value, dict):
                        i = self._key(top, i)
                        ok = i >= 0
                    break
                if mark != ("}" if isinstance(top.value, dict) else "]"):
                    ok = False
                    break
                i, value = i + 1, self._closed(stack, i + 1)
            if not ok:
                break
            if not stack:
                return
        self.dead.update(x.start for x in stack if isinstance(x.value, dict))
        self.dead.add(at)

    def _key(self, top: _Open, i: int) -> int:
        """Reads a key and its colon; the place of the value, or -1."""
        found = _STRING.match(self.text, i)
        if not found:
            return -1
        top.key = json.loads(found.group())
        i = _BLANK.match(self.text, found.end()).end()
        return _BLANK.match(self.text, i + 1).end() if self.text[i : i + 1] == ":" else -1

    def _closed(self, stack: list[_Open], end: int) -> dict | list:
        top = stack.pop()
        if isinstance(top.value, dict):
            self.done[top.start] = end, top.value
        return top.value


def best_object(text: str) -> str | None:
    """The text of the best object in a text: one with requirements, then of most keys, then the earliest; None without any."""
    scanner, best = Scanner(text), None
    for begin in _BEGIN.finditer(text):
        at = begin.start()
        scanner.read(at)
        if at in scanner.done:
            end, value = scanner.done[at]
            rank = ("requirements" in value, len(value))
            if best is None or rank > best[0]:
                best = rank, at, end
    return text[best[1] : best[2]] if best else None


def decode(text: str) -> object:
    """A JSON text's value, at any depth; ValueError if it isn't JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    body = text.strip(" \t\n\r")
    whole = Scanner('{"": ' + body + "}")
    whole.read(0)
    if 0 not in whole.done or whole.done[0][0] != len(whole.text) or list(whole.done[0][1]) != [""]:
        raise ValueError("not JSON")
    return whole.done[0][1][""]
