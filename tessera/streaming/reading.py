"""An incremental reader of call lists: takes text as it comes, in pieces of any size, and keeps no text that it has read.

It keeps the open brackets, the tool, the keys so far, and the string or word that hasn't ended. The batch form of the
same rules is ``operators.automaton.reading``.
"""

from __future__ import annotations

import copy
import json
import re

from tessera.functions.text import CALL_END, CALL_START

BLANKS = " \t\n\x0b\f\r"
MARK = re.compile("|".join(map(re.escape, (CALL_START, CALL_END))))
KEPT = max(len(CALL_START), len(CALL_END)) - 1


class Reading:
    """The state of an unfinished list of calls; state: disarmed, free, name, key, await (a value with a rule comes next) or value."""

    FIELDS = ("armed", "tail", "stack", "tool", "keys", "key", "args", "broken", "state", "span", "open", "escaped")

    def __init__(self, tools: list[dict], saved: str | None = None):
        self.rules = {}
        for t in tools:
            p = t.get("parameters") or {}
            self.rules[str(t.get("name") or "")] = (p.get("properties") or {}, set(p.get("required") or []))
        self.armed, self.tail = False, ""
        self._clear()
        if saved:
            for name, value in zip(self.FIELDS, json.loads(saved)):
                setattr(self, name, value)

    def saved(self) -> str:
        """All there is to go on from, as text."""
        return json.dumps([getattr(self, name) for name in self.FIELDS])

    def _clear(self):
        self.stack, self.tool, self.keys, self.key, self.args, self.broken = [], None, [], None, 0, False
        self.state, self.span, self.open, self.escaped = "free", "", "", False

    def feed(self, piece: str) -> Reading:
        """Goes on by a piece. A marker may come in parts: what is read of it before it is whole doesn't count then."""
        text, at, cut = self.tail + piece, len(self.tail), 0
        for m in MARK.finditer(text):
            at = cut = m.end()
            self.armed = m.group() == CALL_START
            self._clear()
        if self.armed:
            self._chars(text[at:])
        self.tail = text[max(cut, len(text) - KEPT) :]
        return self

    def report(self) -> dict:
        """Where the text stops, as if it ended here."""
        if not self.armed:
            return {"state": "disarmed", "text": "", "tool": None, "keys": [], "pending": [], "broken": False, "forbids_close": False}
        r = copy.copy(self)
        r.stack, r.keys = list(self.stack), list(self.keys)
        if r.open:
            r._token(r.open, False)
        pending = sorted(r.rules.get(r.tool, ({}, set()))[1] - set(r.keys)) if r.args else []
        return {"state": r.state, "text": r.span, "tool": r.tool, "keys": r.keys, "pending": pending, "broken": r.broken, "forbids_close": bool(pending) and len(r.stack) == r.args}

    def _chars(self, text: str):
        for c in text:
            if self.open.startswith('"'):
                self.open += c
                if self.escaped:
                    self.escaped = False
                elif c == "\\":
                    self.escaped = True
                elif c == '"':
                    token, self.open = self.open, ""
                    self._token(token, True)
                continue
            if c in '{}[],:"' or c in BLANKS:
                if self.open:
                    token, self.open = self.open, ""
                    self._token(token, True)
                if c == '"':
                    self.open = c
                elif c not in BLANKS:
                    self._sign(c)
            else:
                self.open += c

    def _rule(self):
        field = self.rules.get(self.tool, ({}, set()))[0].get(self.key or "") or {}
        return field if isinstance(field, dict) and field.keys() & {"enum", "minimum", "maximum"} else None

    def _sign(self, c: str):
        inside = len(self.stack)
        self.state, self.span = "free", ""
        if c in "{[":
            if c == "{" and self.key == "arguments" and not self.args:
                self.args, self.keys = inside + 1, []
            self.stack.append("k" if c == "{" else "[")
            self.key = None
        elif c in "}]":
            if self.args and inside == self.args:
                self.args = 0
            del self.stack[-1:]
        elif c == "," and inside and self.stack[-1] == "v":
            self.stack[-1] = "k"
        elif c == ":" and self.args and inside == self.args and self._rule():
            self.state = "await"

    def _token(self, token: str, closed: bool):
        quoted, in_args = token.startswith('"'), bool(self.args) and len(self.stack) == self.args
        inner = token[1 : -1 if closed else None] if quoted else token
        word = "".join(c for c in inner if c not in BLANKS)
        self.state, self.span = "free", ""
        if quoted and self.stack and self.stack[-1] == "k":
            word = inner.strip(BLANKS) if closed and not in_args else word
            if not closed:
                self.state, self.span = "key" if in_args else "free", word
                return
            self.key, self.stack[-1] = word, "v"
            if in_args:
                self.keys.append(word)
                self.broken |= word not in self.rules.get(self.tool, ({}, set()))[0]
                self.state = "await" if self._rule() else "free"
        elif quoted and self.key == "name" and not self.args:
            if closed:
                self.tool = word
                self.broken |= word not in self.rules
            else:
                self.state, self.span = "name", word
        elif in_args and (rule := self._rule()):
            if closed:
                self.broken |= not self._allowed(rule, quoted, inner.strip(BLANKS))
            else:
                self.state, self.span = "value", word

    @staticmethod
    def _allowed(rule: dict, quoted: bool, token: str) -> bool:
        if "enum" in rule:
            return any(quoted == isinstance(e, str) and (e if quoted else json.dumps(e)) == token for e in rule["enum"])
        if quoted:
            return True
        try:
            x = float(token)
        except ValueError:
            return False
        return rule.get("minimum", x) <= x <= rule.get("maximum", x)
