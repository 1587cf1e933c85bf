"""What a block of a document does to the lexer's place in the grammar, whatever that place was at the block's start.

A state says what a cut falls into: text, a comment, a quoted value, braces of some depth and so on. A block maps each
state at its start to one at its end. Blocks are read from every state, but two readings that come to the same place in
the same state are one from there on, and most meet within a construct or two. Maps of consecutive blocks compose.

States: ``T`` text, ``S`` blanks that are passed over, ``L`` behind a '<', ``!...`` behind the beginning of a declaration
(its characters), ``C0`` to ``C2`` a comment behind that many dashes, ``D0`` to ``D2`` CDATA behind brackets, ``E`` a
declaration, ``P`` an instruction, ``K`` a closing tag, ``Y0`` blanks, ``Y1`` the word and ``Y`` the rest of a doctype,
``Z`` a declaration in it; in opening tags ``N`` the name, ``A`` between attributes, ``/`` behind a slash, ``B`` an
attribute's name, ``W`` behind it, ``V`` behind '=', ``Q"`` and ``Q'`` quoted, ``U`` and ``U/`` unquoted (behind a slash),
``J`` and a number: braces of that depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from .lexer import _ATTR_NAME, _BLANK, _BRACE, _DOCTYPE_STOP, _PLAIN_ATTR, _PLAIN_TAG, _TAG_NAME, _TEXT_RUN, _UNQUOTED, _WORD, NAME_START

_NAME = re.compile(f"[{NAME_START}]")
_WORDS = {"<!--": "C0", "<![cdata[": "D0", "<!doctype": "Y0"}
_HEADS = sorted({w[:n] for w in _WORDS for n in range(2, len(w))})
PLAIN = ["T", "S", "L", *[f"!{h}" for h in _HEADS], *"C0 C1 C2 D0 D1 D2 E P K Y0 Y1 Y Z N A / B W V".split(), 'Q"', "Q'", "U", "U/"]


class Way(NamedTuple):
    """From a state at a block's start: the state at its end, and the first place where a construct or line ends (or -1)."""

    end: str
    cut: int
    skipping: bool  # whether blanks behind that place are passed over
    last: int | None = None  # the number of the last block with such a place


@dataclass
class Block:
    """Ways from all states. From braces of depth d: the first way in ``closed`` whose number is d or more, or else ``net`` braces deeper."""

    ways: dict[str, Way]
    closed: list[tuple[int, Way]]
    net: int

    def way(self, state: str) -> Way:
        if not state.startswith("J"):
            return self.ways[state]
        depth = int(state[1:])
        for most, way in self.closed:
            if depth <= most:
                return way
        return Way(f"J{depth + self.net}", -1, False)


def compose(a: Block, b: Block) -> Block:
    """What ``a`` and ``b`` behind it do together (places are those in ``a``, or -1)."""

    known: dict[Way, Way] = {}

    def on(way: Way) -> Way:
        if way not in known:
            end, _, _, last = b.way(way.end)
            known[way] = Way(end, way.cut, way.skipping, way.last if last is None else last)
        return known[way]

    closed = [(most, on(way)) for most, way in a.closed]
    reached = closed[-1][0] if closed else 0
    closed += [(most - a.net, Way(way.end, -1, False, way.last)) for most, way in b.closed if most - a.net > reached]
    return Block({s: on(w) for s, w in a.ways.items()}, closed, a.net + b.net)


UNCHANGED = Block({s: Way(s, -1, False) for s in PLAIN}, [], 0)


class _Reader:
    """Readings of one block's text from any state and place, each step once."""

    def __init__(self, text: str, number: int):
        self.s, self.n, self.number = text, len(text), number
        self.known: dict[tuple[str, int], Way] = {}
        self.name = (1, 0)  # where an attribute's name was found to go on, and its end

    def way(self, state: str, i: int) -> Way:
        path = []
        while i < self.n and (state, i) not in self.known:
            after, j, ended = self.step(state, i)
            path.append((state, i, j, ended, after == "S"))
            state, i = after, j
        way = self.known.get((state, i)) or Way(state, -1, False)
        for state, i, j, ended, skipping in reversed(path):
            if ended:
                way = Way(way.end, j, skipping, self.number)
            if state in ("T", "S", "A"):  # where readings meet
                self.known[state, i] = way
        return way

    def step(self, state: str, i: int) -> tuple[str, int, bool]:
        """The next state and place, and whether a construct or a line has ended there."""
        s, n = self.s, self.n
        if state == "T":
            j = _TEXT_RUN.match(s, i).end()
            if j >= n - 1 and (j == n or s[j] == "<"):
                return ("T" if j == n else "L"), n, False
            if s[j] == "\n":
                return "S", j + 1, True
            m = _PLAIN_TAG.match(s, j)
            return ("T", m.end(), True) if m else self.step("L", j + 1)
        if state == "A":
            while (m := _PLAIN_ATTR.match(s, i)) is not None:
                i = m.end()
            i = _BLANK.match(s, i).end()
            if i == n:
                return "A", n, False
            return ("T", i + 1, True) if s[i] == ">" else ("/", i + 1, False) if s[i] == "/" else ("B", i, False)
        if state == "S":
            j = _BLANK.match(s, i).end()
            return ("S" if j == n else "T"), j, False
        c, kind = s[i], state[0]
        if kind == "L":
            if c == ">":
                return "T", i + 1, True
            if c in "/!?":
                return {"/": "K", "!": "!<!", "?": "P"}[c], i + 1, False
            return ("N", i, False) if _NAME.match(c) else ("T", i + (c == "<"), False)
        if kind == "!":
            head = state[1:] + c.lower()
            if head in _WORDS:
                return _WORDS[head], i + 1, False
            return (f"!{head}", i + 1, False) if head in _HEADS else ("E", i, False)
        if kind in "CD":
            mark = "-" if kind == "C" else "]"
            behind = int(state[1])
            if behind == 2 and c == ">":
                return "T", i + 1, True
            if behind:
                return (f"{kind}2", i + 1, False) if c == mark else (f"{kind}0", i, False)
            j = s.find(f"{mark}{mark}>", i)
            if j >= 0:
                return "T", j + 3, True
            return f"{kind}{min(2, n - max(i, len(s[i:].rstrip(mark)) + i))}", n, False
        if kind in "EPK":
            j = s.find(">", i)
            return (state, n, False) if j < 0 else ("S" if kind == "E" else "T", j + 1, True)
        if kind == "Z":
            j = s.find(">", i)
            return ("Z", n, False) if j < 0 else ("Y", j + 1, False)
        if kind == "Y":
            if state == "Y":
                m = _DOCTYPE_STOP.search(s, i)
                return ("Y", n, False) if m is None else ("T", m.end(), True) if m[0] == ">" else ("Z", m.end(), False)
            j = (_BLANK if state == "Y0" else _WORD).match(s, i).end()
            return (state if j == n else "Y1" if state == "Y0" else "Y"), j, False
        if kind == "N":
            j = _TAG_NAME.match(s, i).end()
            return ("N" if j == n else "A"), j, False
        if kind == "/":
            return ("T", i + 1, True) if c == ">" else ("A", i + 1, False)
        if kind == "B":
            if not self.name[0] <= i <= self.name[1]:
                self.name = (i, _ATTR_NAME.match(s, i).end())
            j = self.name[1]
            return ("B" if j == n else "W"), j, False
        if kind in "WV":
            j = _BLANK.match(s, i).end()
            if j == n:
                return state, n, False
            if kind == "W":
                return ("V", j + 1, False) if s[j] == "=" else ("A", j, False)
            if s[j] in "\"'":
                return f"Q{s[j]}", j + 1, False
            return ("J1", j + 1, False) if s[j] == "{" else ("A", j + (s[j] == "="), False) if s[j] in "=>" else ("U", j, False)
        if kind == "Q":
            j = s.find(state[1], i)
            return (state, n, False) if j < 0 else ("A", j + 1, False)
        if kind == "U":
            j = _UNQUOTED.match(s, i).end()
            slash = s[j - 1] == "/" if j > i else state == "U/"
            if j == n:
                return ("U/" if slash else "U"), n, False
            return ("A", j, False) if not slash else ("T", j + 1, True) if s[j] == ">" else ("A", j + 1, False)
        depth = int(state[1:])
        for m in _BRACE.finditer(s, i):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return "A", m.end(), False
        return f"J{depth}", n, False


def read_block(text: str, number: int = 0) -> Block:
    """The ways of a block from all states."""
    reader = _Reader(text, number)
    ways = {s: reader.way(s, 0) for s in PLAIN}
    closed: list[tuple[int, Way]] = []
    depth, drops = 0, 0
    for m in _BRACE.finditer(text):
        depth += 1 if m[0] == "{" else -1
        if -depth > drops:
            drops = -depth
            way = reader.way("A", m.end()) if m.end() < len(text) else Way("A", -1, False)
            if closed and closed[-1][1] == way:
                closed[-1] = (drops, way)
            else:
                closed.append((drops, way))
    return Block(ways, closed, depth)
