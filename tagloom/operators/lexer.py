"""The exact lexer: markup to events, one construct at a time, from wherever a text was cut.

A construct (tag, comment, declaration, ...) is read whole or not at all, by searches for what ends it. If the end isn't
there yet, the lexer keeps the text from the construct's start for later pieces, so results don't depend on cuts. Pieces
without what the end needs are laid aside unread, so a long construct is read a few times, not once a piece.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np

from ..schema import ALL_EVENTS, AttributeType, EventType

# Name characters of XML 1.0
NAME_START = (
    "A-Za-z_:À-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏"
    "Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff"
)
NAME_REST = "0-9.·̀-ͯ‿-⁀-"

BOM = "﻿"
# text up to a line break or markup; a '<' that begins nothing is text and takes a '<' behind it along
_TEXT_RUN = re.compile(f"(?:[^<\n]++|<<|<(?=[^!/?>{NAME_START}<]))*+")
_BLANK = re.compile(r"[\x00-\x20]*")
_TAG_NAME = re.compile(r"[^>/ \n\t\r]*")
_ATTR_NAME = re.compile(r"[^=> \t\n]*")
_UNQUOTED = re.compile(r"[^ \t\n>]*")
_BRACE = re.compile(r"[{}]")
_PI_TARGET = re.compile(r"[^> \n\t\r]*")
_WORD = re.compile(r"[^ \n\t\r>]*")
_DOCTYPE_STOP = re.compile(r"[!>]")
_KEYWORD = re.compile(r"(?:[> \-\[]|[^> \-\[]+)?")
_CLOSE_WORDS = re.compile(r" [\x00-\x20]*")
# the plainest tags and attributes, of which most documents are made, in one step
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")
_PLAIN_ATTR = re.compile(r'[\x00-\x20]*([A-Za-z][A-Za-z0-9_:.-]*)="([^"]*)"')

TEXT, PI, DECLARATION, DOCTYPE, COMMENT = (int(e) for e in list(EventType)[:5])
OPEN_START, ATTRIBUTE, OPEN, CLOSE, CDATA = (int(e) for e in list(EventType)[5:])

FULL, FLAT, BARE = "full", "flat", "bare"  # what events hold: all, numbers instead of attributes and text nodes, nothing
LARGE = 1 << 20  # characters of an open construct beyond which it is read again only when it has grown by half

Pos = tuple[int, int]


class TextNode(NamedTuple):
    value: str
    start: Pos
    end: Pos
    byte_start: int
    byte_end: int


class Attr(NamedTuple):
    name: TextNode
    value: TextNode
    type: int
    byte_start: int
    byte_end: int


class ProcInst(NamedTuple):
    target: TextNode
    content: TextNode
    start: Pos
    end: Pos
    byte_start: int
    byte_end: int


class Tag(NamedTuple):
    name: str
    attributes: tuple[Attr, ...]
    text_nodes: tuple[TextNode, ...]
    self_closing: bool
    open_start: Pos
    open_end: Pos
    close_start: Pos
    close_end: Pos
    byte_start: int
    byte_end: int
    implicit: bool = False


Event = tuple[int, int, object]
NOWHERE: Pos = (0, 0)
EMPTY = TextNode("", NOWHERE, NOWHERE, 0, 0)


class _Places:
    """Lines, UTF-16 columns and byte offsets of places in a piece of text that begins somewhere in a document."""

    __slots__ = ("line", "column", "byte", "breaks", "plain", "bytes", "units")

    def __init__(self, text: str, line: int, column: int, byte: int):
        self.line, self.column, self.byte = line, column, byte
        self.breaks = [m.start() for m in re.finditer("\n", text)] if "\n" in text else []
        self.plain = text.isascii()
        if not self.plain:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            wide = (codes > 0xFFFF).astype(np.int64)
            size = 1 + (codes > 0x7F) + (codes > 0x7FF) + wide
            self.bytes = np.append(0, np.cumsum(size))
            self.units = np.append(0, np.cumsum(1 + wide))

    def at(self, i: int) -> tuple[Pos, int]:
        """(line, column) and byte offset of place ``i``."""
        row = bisect_right(self.breaks, i - 1)
        if self.plain:
            byte, since = i, i - (self.breaks[row - 1] + 1 if row else 0)
        else:
            byte, since = int(self.bytes[i]), int(self.units[i] - (self.units[self.breaks[row - 1] + 1] if row else 0))
        return (self.line + row, since + (0 if row else self.column)), self.byte + byte


class Lexer:
    """Feed text with ``write``, finish with ``end``; both return events as (number, mask bit, entity).

    ``events`` chooses which are returned; it changes neither what they hold nor their numbers, which count all kinds. ``compat`` gives what
    older consumers expect: declarations with the code of CDATA, no '<' at the start of a text, ``<!>`` as a declaration
    up to the next '>', and nothing behind ``<![``, ``<!-`` or ``<!D`` that begins no CDATA, comment or doctype. The state
    is plain data: a lexer can be pickled between writes. ``detail`` says what tags hold (see ``FULL``).
    """

    def __init__(self, events: int = int(ALL_EVENTS), compat: bool = False, detail: str = FULL):
        self.events, self.compat, self.detail = events, compat, detail
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.reset()

    def reset(self) -> None:
        self.decoder.reset()
        self.held: list[str] = []  # pieces of what is open
        self.size = self.tried = 0  # their characters, and those that the last reading saw
        self.need: tuple[str, ...] = ("",)  # one of these has to come before what is open can end
        self.tail = ""
        self.line, self.column, self.byte = 0, 0, 0
        self.seq = 0
        self.begun = False
        self.skipping = False  # after a line break: blanks are passed over
        self.open_names: dict[str, int] = {}  # how many elements of a name are open
        self.below = 0  # elements open below the stack, which nothing to come closes
        self.stack: list[list] = []  # [name, attributes, text nodes, open_start, open_end, byte_start, byte_end]

    def write(self, chunk: bytes | str) -> list[Event]:
        """Events that the text so far completes. Bytes may be cut anywhere, even within a character.

        Events of constructs beyond ``LARGE`` characters may come with a later piece, at the latest with ``end``.
        """
        return self._read(self.decoder.decode(chunk) if isinstance(chunk, (bytes, bytearray)) else chunk, False)

    def end(self) -> list[Event]:
        """Events of what is pending; unfinished constructs and unclosed elements give none. The lexer starts anew."""
        out = self._read(self.decoder.decode(b"", True), True)
        self.reset()
        return out

    def parse(self, content: bytes | str | None) -> list[Event]:
        """All events of a whole document."""
        out = self.open_document(content)
        self.reset()
        return out

    def open_document(self, content: bytes | str | None) -> list[Event]:
        """The same, after which ``unclosed`` tells what is still open in the document."""
        self.reset()
        if not content:
            return []
        return self._read(content if isinstance(content, str) else bytes(content).decode("utf-8", "replace"), True)

    def unclosed(self) -> list[tuple[str, int, int]]:
        """Name and first and last byte of the opening tag of each open element, outer ones first (if tags are asked for)."""
        return [(own[0], own[5], own[6]) for own in self.stack]

    def _read(self, piece: str, final: bool) -> list[Event]:
        out: list[Event] = []
        if self.held and not final and not self._worth(piece):
            self.held.append(piece)
            self.size += len(piece)
            self.tail = (self.tail + piece)[-2:]
            return out
        s = "".join([*self.held, piece]) if self.held else piece
        if not s:
            return out
        self.places = places = _Places(s, self.line, self.column, self.byte)
        self.out = out
        self.need = ("",)
        i = self._scan(s, final)
        rest = s[i:]
        self.held = [rest] if rest else []
        self.size = self.tried = len(rest)
        self.tail = rest[-2:]
        (self.line, self.column), self.byte = places.at(i)
        del self.places, self.out
        return out

    def _worth(self, piece: str) -> bool:
        """Whether what is open can end with ``piece``."""
        if self.size > LARGE and self.size + len(piece) < 1.5 * self.tried:
            return False
        return any(x in piece or (len(x) > 1 and x in self.tail + piece[:2]) for x in self.need)

    def _scan(self, s: str, final: bool) -> int:
        """Reads constructs from the start of ``s``; the place up to which it has been read."""
        i, n = 0, len(s)
        if not self.begun:
            self.begun = True
            i = 1 if s[0] == BOM else 0
        while i < n:
            if self.skipping:
                i = _BLANK.match(s, i).end()
                if i == n:
                    break
                self.skipping = False
            j = _TEXT_RUN.match(s, i).end()
            if j == n or (j == n - 1 and s[j] == "<"):  # what ends the text isn't there; a lone '<' at the end is nothing
                if not final:
                    self.need = ("<", "\n") if j == n else ("",)
                    break
                self._emit_text(s, i, j)
                return n
            self._emit_text(s, i, j)
            if s[j] == "\n":
                self.skipping = True
                i = j + 1
                continue
            m = _PLAIN_TAG.match(s, j)
            if m is None:
                after = self._construct(s, j)
            elif m[1]:
                after = self._closed(s, j, m[2], m.end())
            else:
                after = self._opened(s, j, m[2], (), False, m.end())
            if after is None:
                return n if final else j
            i = after
        return i

    def _emit_text(self, s: str, i: int, stop: int) -> None:
        if self.compat and i < stop and s[i] == "<":
            i += 1
        if i < stop:
            self._add_text(s, i, stop)

    def _add_text(self, s: str, i: int, stop: int, value: str | None = None) -> None:
        """A text, as an event and as a text node of the element that is open, where these are asked for."""
        events, full = self.events, self.detail == FULL
        inside = self.stack and events & CLOSE and self.detail != BARE
        if inside and not full:
            self.stack[-1][2] += 1
        if events & TEXT or (inside and full):
            node = None if self.detail == BARE else self._node(s, i, stop, value)
            if inside and full:
                self.stack[-1][2].append(node)
            self._emit(TEXT, node)
        else:
            self.seq += 1

    def _emit(self, kind: int, entity: object) -> None:
        if self.events & kind:
            self.out.append((self.seq, kind, entity))
        self.seq += 1

    def _node(self, s: str, i: int, j: int, value: str | None = None) -> TextNode:
        (start, a), (end, b) = self.places.at(i), self.places.at(j)
        return TextNode(s[i:j] if value is None else value, start, end, a, b)

    def _spanned(self, kind: int, s: str, i: int, j: int, value: str) -> None:
        """An event whose entity is a text, if it is asked for."""
        if self.events & kind:
            self.out.append((self.seq, kind, None if self.detail == BARE else self._node(s, i, j, value)))
        self.seq += 1

    def _construct(self, s: str, i: int) -> int | None:
        """Reads the construct at the '<' at ``i``; the place after it, or None if it isn't all there."""
        c = s[i + 1]
        self.need = ("",)
        if c == "/":
            return self._close(s, i)
        if c == "!":
            return self._declared(s, i)
        if c == "?":
            return self._instruction(s, i)
        if c == ">":
            return self._opened(s, i, "", (), False, i + 2)
        self.need = (">",)  # before which no tag ends
        j = _TAG_NAME.match(s, i + 1).end()
        if j == len(s):
            return None
        found = self._attributes(s, j)
        if found is None:
            return None
        attrs, closing, end = found
        return self._opened(s, i, s[i + 1 : j], attrs, closing, end)

    def _attributes(self, s: str, i: int) -> tuple[list, bool, int] | None:
        """(places of attributes, self-closing, place after '>') of a tag from behind its name."""
        n, out = len(s), []
        while True:
            while (m := _PLAIN_ATTR.match(s, i)) is not None:
                i = m.end()
                out.append((*m.span(1), *m.span(2), AttributeType.DoubleQuoted, i))
            i = _BLANK.match(s, i).end()
            if i == n:
                return None
            c = s[i]
            if c == ">":
                return out, False, i + 1
            if c == "/":
                if i + 1 == n:
                    return None
                if s[i + 1] == ">":
                    return out, True, i + 2
                i += 2  # the character behind a slash goes with it
                continue
            j = _ATTR_NAME.match(s, i).end()
            k = _BLANK.match(s, j).end()
            if k == n:
                return None
            if s[k] != "=":
                out.append((i, j, -1, -1, AttributeType.NoValue, j))
                i = k
                continue
            v = _BLANK.match(s, k + 1).end()
            if v == n:
                return None
            q = s[v]
            if q == '"' or q == "'":
                e = s.find(q, v + 1)
                if e == -1:
                    self.need = (q,)
                    return None
                out.append((i, j, v + 1, e, AttributeType.DoubleQuoted if q == '"' else AttributeType.SingleQuoted, e + 1))
                i = e + 1
            elif q == "{":
                depth, e = 1, v
                while depth:
                    m = _BRACE.search(s, e + 1)
                    if m is None:
                        self.need = ("}",)
                        return None
                    e = m.start()
                    depth += 1 if s[e] == "{" else -1
                out.append((i, j, v + 1, e, AttributeType.JSX, e + 1))
                i = e + 1
            elif q in "=>":
                out.append((i, j, v, v, AttributeType.NoQuotes, v))
                i = v + (q == "=")
            else:
                e = _UNQUOTED.match(s, v).end()
                if e == n:
                    return None
                out.append((i, j, v, e, AttributeType.NoQuotes, e))
                i = e
                if s[e - 1] == "/":  # the value keeps its slash, which still may close the tag
                    if s[e] == ">":
                        return out, True, e + 1
                    i = e + 1

    def _opened(self, s: str, i: int, name: str, found: list | tuple, closing: bool, end: int) -> int:
        at, events, detail = self.places.at, self.events, self.detail
        if detail == BARE:
            for kind, n in ((OPEN_START, 1 if name else 0), (ATTRIBUTE, len(found)), (OPEN, 1), (CLOSE, int(closing))):
                if events & kind:
                    self.out += [(self.seq + k, kind, None) for k in range(n)]
                self.seq += n
            if not closing:
                self._push([name])
            return end
        attrs: list | range = []
        if events & ATTRIBUTE or (detail == FULL and events & (OPEN | CLOSE)):
            for n0, n1, v0, v1, kind, e in found:
                value = EMPTY if kind == AttributeType.NoValue else self._node(s, v0, v1)
                node = self._node(s, n0, n1)
                attrs.append(Attr(node, value, int(kind), node.byte_start, at(e)[1]))
        if name:
            if events & OPEN_START:
                open_start, a = at(i)
                self.out.append((self.seq, OPEN_START, Tag(name, (), (), False, open_start, NOWHERE, NOWHERE, NOWHERE, a, 0)))
            self.seq += 1
        if events & ATTRIBUTE:
            self.out += [(self.seq + k, ATTRIBUTE, x) for k, x in enumerate(attrs)]
        self.seq += len(found)
        if not events & (OPEN | CLOSE):
            self.seq += 1 + closing
            if not closing:
                self._push([name, (), [], NOWHERE, NOWHERE, 0, 0])
            return end
        (open_start, a), (open_end, z) = at(i), at(end)
        own = tuple(attrs) if detail == FULL else range(len(found))
        if events & OPEN or closing:
            tag = Tag(name, own, (), closing, open_start, open_end, NOWHERE, NOWHERE, a, z)
            self._emit(OPEN, tag)
            if closing:
                self._emit(CLOSE, tag)
                return end
        else:
            self.seq += 1
        self._push([name, own, [] if detail == FULL else 0, open_start, open_end, a, z])
        return end

    def _push(self, own: list) -> None:
        self.stack.append(own)
        self.open_names[own[0]] = self.open_names.get(own[0], 0) + 1

    def _close(self, s: str, i: int) -> int | None:
        j = s.find(">", i + 2)
        if j == -1:
            self.need = (">",)
            return None
        words = [w for w in _CLOSE_WORDS.split(s[i + 2 : j]) if w]
        return self._closed(s, i, words[-1] if words else "", j + 1)

    def _closed(self, s: str, i: int, name: str, end: int) -> int:
        """A closing tag between ``i`` and ``end``: of the nearest open element of that name, or else it is text."""
        stack, k = self.stack, len(self.stack) - 1
        if not self.open_names.get(name):
            self._add_text(s, i, end, f"</{name}>")
            return end
        while stack[k][0] != name:
            k -= 1
        for own in stack[k:]:
            left = self.open_names[own[0]] - 1
            if left:
                self.open_names[own[0]] = left
            else:
                del self.open_names[own[0]]
        n = len(stack) - k
        if not self.events & CLOSE or self.detail == BARE:
            if self.events & CLOSE:
                self.out += [(self.seq + x, CLOSE, None) for x in range(n)]
            self.seq += n
            del stack[k:]
            return end
        (start, _), (stop, byte) = self.places.at(i), self.places.at(end)
        while len(stack) > k:
            own, attrs, texts, open_start, open_end, a, z = stack.pop()
            explicit = len(stack) == k
            where = (start, stop, a, byte) if explicit else (NOWHERE, NOWHERE, a, z)
            nodes = tuple(texts) if self.detail == FULL else range(texts)
            self._emit(CLOSE, Tag(own, attrs, nodes, False, open_start, open_end, *where, not explicit))
        return end

    def _enclosed(self, s: str, i: int, kind: int, skip: int, stop: str) -> int | None:
        j = s.find(stop, i + skip)
        if j == -1:
            self.need = (stop,)
            return None
        end = j + len(stop)
        self._spanned(kind, s, i, end, s[i + skip : j])
        return end

    def _declare(self, s: str, i: int, end: int, value: str) -> None:
        if self.events & DECLARATION:
            node = None if self.detail == BARE else self._node(s, i, end, value)
            self.out.append((self.seq, CDATA if self.compat else DECLARATION, node))
        self.seq += 1

    def _declared(self, s: str, i: int) -> int | None:
        """'<!': a comment, CDATA, a doctype or else a declaration, which ends at the first '>'."""
        n, head = len(s), s[i : i + 9].lower()
        if head.startswith("<!--"):
            return self._enclosed(s, i, COMMENT, 4, "-->")
        if head == "<![cdata[":
            return self._enclosed(s, i, CDATA, 9, "]]>")
        if head == "<!doctype":
            return self._doctype(s, i)
        if n - i < 9 and any(x.startswith(head) for x in ("<!--", "<![cdata[", "<!doctype")):
            return None  # it can still become one of them
        if self.compat and head[2:3] in ("-", "[", "d"):
            return None
        j = s.find(">", i + 3 if self.compat and head[2:3] == ">" else i + 2)
        if j == -1:
            self.need = (">",)
            return None
        if self.compat and head[2:3] == ">":
            self._declare(s, i, j + 1, s[_BLANK.match(s, i + 3).end() : j] or ">")
            self.skipping = True
            return j + 1
        start = _KEYWORD.match(s, i + 2, j).end()
        start = min(j, _BLANK.match(s, start).end())
        self._declare(s, i, j + 1, s[start:j] or (">" if j > i + 2 else ""))
        self.skipping = True  # blanks behind a declaration are no text
        return j + 1

    def _doctype(self, s: str, i: int) -> int | None:
        self.need = (">",)
        start = _BLANK.match(s, i + 9).end()
        word = _WORD.match(s, start).end()
        at, inner = word, []
        while True:
            m = _DOCTYPE_STOP.search(s, at)
            if m is None:
                return None
            at = m.start()
            if s[at] == ">":
                break
            j = s.find(">", at + 1)
            if j == -1:
                return None
            inner.append((at - (s[at - 1] == "<"), j + 1, s[at + 1 : j]))
            at = j + 1
        for a, z, value in inner:
            self._declare(s, a, z, value)
        self._spanned(DOCTYPE, s, i, at + 1, s[start:word])
        return at + 1

    def _instruction(self, s: str, i: int) -> int | None:
        j = s.find(">", i + 2)
        if j == -1:
            self.need = (">",)
            return None
        if not self.events & PI or self.detail == BARE:
            self._emit(PI, None)
            return j + 1
        t = _PI_TARGET.match(s, i + 2).end()
        if t >= j:  # no blank: all up to the '>' is the target
            target, content = self._node(s, i + 2, j + 1), EMPTY
        else:
            c = min(j, _BLANK.match(s, t).end())
            target, content = self._node(s, i + 2, t), self._node(s, c, max(c, j - 1))
        (start, a), (end, z) = self.places.at(i), self.places.at(j + 1)
        self._emit(PI, ProcInst(target, content, start, end, a, z))
        return j + 1

    def __getstate__(self) -> dict:
        state = dict(self.__dict__)
        state["decoder"] = self.decoder.getstate()
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.decoder.setstate(state["decoder"])



class AttributeLexer(Lexer):
    """Gives attributes as (number, name, value, type), without their places."""

    def __init__(self, compat: bool):
        super().__init__(ATTRIBUTE, compat, FLAT)

    def _opened(self, s: str, i: int, name: str, found: list | tuple, closing: bool, end: int) -> int:
        seq = self.seq + bool(name)
        if found:
            self.out += [(seq + k, s[n0:n1], s[v0:v1] if v0 >= 0 else "", kind) for k, (n0, n1, v0, v1, kind, _) in enumerate(found)]
        self.seq = seq + len(found) + 1 + closing
        if not closing:
            self._push([name, (), [], NOWHERE, NOWHERE, 0, 0])
        return end
