"""What the recognisers share: token kinds, bracket matching and the cursor.

A lexer gives one *kind* per token: keywords and marks stand for themselves, everything else is ID, NUM, STR, TPL and
so on.  Parsers walk over the list of kinds with an index and raise ``Refused`` at the first token no rule takes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

#: Kind of the token behind the last one.
END = ""
_MEMO = 100_000
_CLOSING = {")": "(", "]": "[", "}": "{"}


class Refused(Exception):
    """The text is no valid syntax; ``at`` is the number of the token that fits no rule."""

    def __init__(self, at: int = -1):
        self.at = at


class Kinds(dict):
    """token text -> kind; texts that are in no table are classified once and kept, long ones are not."""

    def __init__(self, fixed: dict[str, str], classify: Callable[[str], str | None]):
        super().__init__(fixed)
        self.fixed, self.classify = dict(fixed), classify

    def __missing__(self, text: str) -> str | None:
        kind = self.classify(text)
        if len(text) <= 64:
            if len(self) > _MEMO:
                self.clear()
                self.update(self.fixed)
            self[text] = kind
        return kind


def table(words: str, marks: str) -> dict[str, str]:
    return {w: w for w in (*words.split(), *marks.split())}


def brackets(kinds: list[str]) -> dict[int, int]:
    """Number of the closing token for every opening one; refuses what does not match."""
    match: dict[int, int] = {}
    stack: list[int] = []
    for at, kind in enumerate(kinds):
        if kind in "([{" and kind:
            stack.append(at)
        elif kind in ")]}" and kind:
            if not stack or kinds[stack[-1]] != _CLOSING[kind]:
                raise Refused(at)
            match[stack.pop()] = at
    if stack:
        raise Refused(stack[-1])
    return match


class Parser:
    """A cursor over token kinds."""

    def __init__(self, kinds: list[str]):
        self.match = brackets(kinds)
        self.k = [*kinds, END]
        self.p = 0
        #: (token of the name, first token of the declaration, token behind it) of the named functions met so far
        self.found: list[tuple[int, int, int]] = []

    def fail(self):
        raise Refused(self.p)

    def take(self, kind: str) -> None:
        if self.k[self.p] != kind:
            raise Refused(self.p)
        self.p += 1

    def has(self, kind: str) -> bool:
        if self.k[self.p] == kind:
            self.p += 1
            return True
        return False

    def take_in(self, kinds: frozenset[str]) -> None:
        if self.k[self.p] not in kinds:
            raise Refused(self.p)
        self.p += 1

    def tries(self, rule: Callable[[], object]) -> bool:
        """Whether the rule takes what stands here; where it does not, the cursor stays."""
        start, found = self.p, len(self.found)
        try:
            rule()
            return True
        except Refused:
            self.p = start
            del self.found[found:]
            return False

    def note(self, name: int, first: int) -> None:
        """A function of that name ends here; a closing semicolon belongs to it."""
        self.found.append((name, first, self.p + 1 if self.k[self.p] == ";" else self.p))

    def all_in(self, close: int, rule: Callable[[], object], separator: str = ",", trailing: bool = True) -> None:
        """A separated list of the rule up to the closing bracket at ``close``, which is taken."""
        k = self.k
        while self.p < close:
            rule()
            if self.p >= close:
                break
            if k[self.p] != separator or (not trailing and self.p + 1 == close):
                raise Refused(self.p)
            self.p += 1
        if self.p != close:
            raise Refused(self.p)
        self.p += 1


class Source(NamedTuple):
    """The tokens of a text with their places; comments are (start, end) offsets."""

    kinds: list[str]
    starts: list[int]
    ends: list[int]
    comments: list[tuple[int, int]]


def source(text: str, lexer: re.Pattern, kinds: Kinds) -> Source:
    """The tokens of a lexer that needs no context; kinds of None are comments, line ends are kept."""
    out = Source([], [], [], [])
    for m in lexer.finditer(text):
        kind = kinds[m.group()]
        if kind is None or (kind == "\n" and text[m.start()] == "/"):
            out.comments.append(m.span())
        if kind is not None:
            out.kinds.append(kind)
            out.starts.append(m.start())
            out.ends.append(m.end())
    return out


class Function(NamedTuple):
    """A named function: heads are the offsets at which a comment above it may end, the declaration's own start first."""

    name: str
    at: int
    end: int
    heads: list[int]


def named_functions(text: str, parser: Parser, tokens: Source) -> list[Function]:
    """The functions that the parser met, by the place of their names."""
    out = []
    for name, first, end in sorted(parser.found):
        heads, t = [], first
        while t <= name:
            heads.append(tokens.starts[t])
            t = parser.match.get(t, t) + 1
        out.append(Function(text[tokens.starts[name] : tokens.ends[name]], tokens.starts[name], tokens.ends[end - 1], heads))
    return out


def number(pattern: str) -> Callable[[str], object]:
    return re.compile(pattern).fullmatch
