"""The text of a reply's `answer` while its JSON is being written: an automaton over characters whose state is a few bytes.

Only keys of the outermost object count, the first `answer` and the first `action` of them. Escapes are decoded by hand: a surrogate without
its other half is U+FFFD, a \\u without four hex digits is dropped with the digits it has, a letter that JSON doesn't escape stands for itself.
Nothing is shown before the action is known to be an answer, if asked for; what comes before the action is held, which is the
only part of the state that can grow.
"""

from __future__ import annotations

import json
import re

_PLAIN = re.compile(r'[^"\\]+')
_SKIP = re.compile(r'[^"{}\[\]:,]+')
_HEX = frozenset("0123456789abcdefABCDEF")
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_LOST = "�"
_NAME = 64  #: characters of keys and actions that are kept: longer ones aren't known anyway


class AnswerText:
    """feed() takes the next piece and returns what can be shown now; dump() is the state, for load()."""

    def __init__(self, need_action: bool = True):
        self.is_answer: bool | None = None if need_action else True
        self.depth, self.at_key, self.key, self.action = 0, False, "", ""
        self.role = ""  #: of the string that is open: k(ey), a(nswer), x (action), o(ther); empty: none is
        self.escape, self.high = "", 0  #: half an escape; a lead surrogate that waits
        self.answered, self.held = False, ""

    def dump(self) -> str:
        return json.dumps([self.is_answer, self.depth, self.at_key, self.key, self.action, self.role, self.escape, self.high, self.answered, self.held])

    @classmethod
    def load(cls, state: str) -> AnswerText:
        x = cls()
        x.is_answer, x.depth, x.at_key, x.key, x.action, x.role, x.escape, x.high, x.answered, x.held = json.loads(state)
        return x

    def feed(self, piece: str) -> str:
        out: list[str] = []
        i = 0
        while i < len(piece):
            if self.escape:
                i += self._escaped(piece[i], out)
            elif not self.role:
                i = self._outside(piece, i)
            elif piece[i] == "\\":
                self.escape = "\\"
                i += 1
            elif piece[i] == '"':
                self._lone(out)
                self._close(out)
                i += 1
            else:
                m = _PLAIN.match(piece, i)
                self._lone(out)
                self._take(m[0], out)
                i = m.end()
        return "".join(out)

    def _outside(self, piece: str, i: int) -> int:
        if m := _SKIP.match(piece, i):
            return m.end()
        c = piece[i]
        if c == '"':
            self.role = self._opens()
        elif c in "{[":
            self.depth += 1
            self.at_key = c == "{" if self.depth == 1 else self.at_key
        elif c in "}]":
            self.depth -= 1
        elif self.depth == 1:
            self.at_key = c == ","
        return i + 1

    def _opens(self) -> str:
        if self.depth != 1:
            return "o"
        if self.at_key:
            self.key = ""
            return "k"
        if self.key == "answer" and not self.answered:
            return "a"
        return "x" if self.key == "action" and self.is_answer is None else "o"

    def _close(self, out: list[str]) -> None:
        if self.role == "x":
            self.is_answer = self.action == "answer"
            if self.is_answer:
                out.append(self.held)
            self.held = ""
        self.answered |= self.role == "a"
        self.role = ""

    def _take(self, text: str, out: list[str]) -> None:
        if self.role == "k":
            self.key = (self.key + text)[:_NAME]
        elif self.role == "x":
            self.action = (self.action + text)[:_NAME]
        elif self.role == "a" and self.is_answer:
            out.append(text)
        elif self.role == "a" and self.is_answer is None:
            self.held += text

    def _lone(self, out: list[str]) -> None:
        if self.high:
            self.high = 0
            self._take(_LOST, out)

    def _escaped(self, c: str, out: list[str]) -> int:
        """The character after a begun escape; 0 if it is to be read again as text."""
        if self.escape == "\\":
            if c == "u":
                self.escape = "\\u"
                return 1
            self.escape = ""
            self._lone(out)
            self._take(_SHORT.get(c, c), out)
            return 1
        if c not in _HEX:
            self.escape = ""
            self._lone(out)
            return 0
        self.escape += c
        if len(self.escape) == 6:
            code, self.escape = int(self.escape[2:], 16), ""
            if self.high and 0xDC00 <= code < 0xE000:
                self._take(chr(0x10000 + (self.high - 0xD800 << 10) + code - 0xDC00), out)
                self.high = 0
                return 1
            self._lone(out)
            if 0xD800 <= code < 0xDC00:
                self.high = code
            else:
                self._take(_LOST if 0xDC00 <= code < 0xE000 else chr(code), out)
        return 1
