"""Random documents that know what is to be read from them.

A sheet writes constructs one after the other and notes for each the events it makes, by places in the text so far. Lines,
columns and bytes are worked out from these at the end, by looking at all of the text before a place. Nothing is parsed.
"""

import random

from tagloom.schema import AttributeType, EventType

NAMES = ["moor", "fen", "ü-9", "a.b", "K:L", "tarn"]
WORDS = ["peat", "3 < 4", "bog & sedge", "é", "🦆 🦆", "]]", "--", "{", "}", "' \"", "x=y", "a<<b>", "/", "\r"]
KINDS = {e.name: int(e) for e in EventType}


class Sheet:
    def __init__(self, seed, steps=25, marked=False):
        self.rng = random.Random(seed)
        self.text = "﻿" if marked else ""
        self.events = []  # (kind, dict)
        self.stack = []
        self.bare = False  # behind a declaration blanks are passed over
        self.flowing = False  # the last thing was text, which another text would be part of
        for _ in range(steps):
            self.rng.choice([self.words, self.words, self.open, self.open, self.open, self.close, self.close, self.comment, self.cdata, self.instruction, self.doctype, self.declaration])()

    def put(self, s):
        a = len(self.text)
        self.text += s
        return a, len(self.text)

    def some(self, pool, most=3, sep=" "):
        return sep.join(self.rng.choice(pool) for _ in range(self.rng.randint(1, most)))

    def note(self, kind, **what):
        self.events.append((kind, what))

    def node(self, value, a, z):
        node = {"value": value, "a": a, "z": z}
        if self.stack:
            self.stack[-1]["texts"].append(node)
        self.note("Text", **node)

    def construct(self, bare=False):
        self.bare, self.flowing = bare, False

    def words(self):
        if self.flowing:
            return
        lines = ["".join(self.rng.choice(["", " ", "\t "]) + self.some(WORDS) for _ in range(self.rng.randint(0, 2))) for _ in range(self.rng.randint(1, 4))]
        for k, line in enumerate(lines):
            a, z = self.put(line)
            kept = line.lstrip("".join(map(chr, range(33)))) if k or self.bare else line
            if kept:
                self.node(kept, z - len(kept), z)
                self.bare = False
            if k + 1 < len(lines):
                self.put("\n")
        self.flowing = "".join(lines) != "" or len(lines) > 1
        if self.flowing:
            self.bare = False

    def comment(self):
        value = self.some(["late", "- - >", "<fen>", "--", "\n", "é"]).rstrip("-")
        a, z = self.put(f"<!--{value}-->")
        self.note("Comment", value=value, a=a, z=z)
        self.construct()

    def cdata(self):
        value = self.some(["raw", "<fen a='1'>", "]] >", "\n ", "🦆", "-->"]) if self.rng.random() < 0.8 else ""
        word = "".join(self.rng.choice([c, c.lower()]) for c in "CDATA")
        a, z = self.put(f"<![{word}[{value}]]>")
        self.note("Cdata", value=value, a=a, z=z)
        self.construct()

    def instruction(self):
        a, _ = self.put("<?")
        target = self.rng.choice(["ferry", "é-2", "x"])
        if self.rng.random() < 0.3:  # without a blank all of it is the target
            t0, t1 = self.put(target + self.rng.choice(["?>", ">"]))
            _, z = t0, t1
            self.note("ProcessingInstruction", target={"value": self.text[t0:t1], "a": t0, "z": t1}, content=None, a=a, z=z)
        else:
            t0, t1 = self.put(target)
            self.put(self.some([" ", "\n", "\t"], sep=""))
            content = self.some(["at=noon", '"8"', "<p", "ü?"])
            c0, c1 = self.put(content)
            _, z = self.put("?>")
            self.note("ProcessingInstruction", target={"value": target, "a": t0, "z": t1}, content={"value": content, "a": c0, "z": c1}, a=a, z=z)
        self.construct()

    def doctype(self):
        word = "".join(self.rng.choice([c, c.lower()]) for c in "DOCTYPE")
        value = self.rng.choice(["map", "m!p", "é"])
        a, _ = self.put(f"<!{word}{self.rng.choice([' ', '  ', chr(10)])}{value}")
        inner = []
        if self.rng.random() < 0.6:
            self.put(" [")
            for _ in range(self.rng.randint(0, 3)):
                self.put(self.rng.choice([" ", "\n "]))
                content = self.some(["ENTITY", "tide '5'", "(a|b)*", "é"])
                b, y = self.put(f"<!{content}>")
                inner.append({"value": content, "a": b, "z": y})
            self.put("]")
        _, z = self.put(">")
        for d in inner:
            self.note("Declaration", **d)
        self.note("Doctype", value=value, a=a, z=z)
        self.construct()

    def declaration(self):
        keyword = self.rng.choice(["NOTE", "sluice", "é"])
        content = self.rng.choice(["", "low (water)", "<q ' r", "ü\nv"])
        a, z = self.put(f"<!{keyword}{' ' * bool(content)}{content}>")
        self.note("Declaration", value=content or ">", a=a, z=z)
        self.construct(bare=True)

    def attribute(self, last):
        """One attribute with what parts it from the next; what it does to a slash behind it is chosen by the last one."""
        rng = self.rng
        form = rng.choice(list(AttributeType))
        name = self.some([*NAMES, "*for", "[at]", "(on)", "#me", "q\r"], 1)
        n0, n1 = self.put(name)
        if form == AttributeType.NoValue:
            found = {"name": {"value": name, "a": n0, "z": n1}, "value": None, "type": 0, "z": n1}
            self.put(self.rng.choice([" ", "\n", "\t "]))
            return found
        self.put(rng.choice(["", " ", "\n "]) + "=" + rng.choice(["", " ", "\n"]))
        if form == AttributeType.NoQuotes:
            value = rng.choice(["7", "a/b", "é=2", "u'"])
            v0, v1 = self.put(value)
            self.put(" ")
            end = v1
        else:
            open_, shut, value = {
                AttributeType.DoubleQuoted: ('"', '"', self.some(["up > down", "é", "'", "\n{", "🦆", ""])), AttributeType.SingleQuoted: ("'", "'", self.some(["<tarn>", '"', "}", "ü", ""])),
                AttributeType.JSX: ("{", "}", self.some(["a => {b}", "'{'}", "{{}}", "x > 2", "é", ""])),
            }[form]
            self.put(open_)
            v0, v1 = self.put(value)
            _, end = self.put(shut)
            self.put(rng.choice(["", " ", "\n"]))
        return {"name": {"value": name, "a": n0, "z": n1}, "value": {"value": value, "a": v0, "z": v1}, "type": int(form), "z": end}

    def open(self):
        rng = self.rng
        name = rng.choice([*NAMES, ""])
        a, _ = self.put(f"<{name}")
        attributes, closing = [], False
        if name:
            n = rng.randint(0, 3)
            if n:
                self.put(rng.choice([" ", "\n  "]))
                attributes = [self.attribute(k + 1 == n) for k in range(n)]
                if rng.random() < 0.2:
                    self.put("/z")  # the character behind a slash goes with it
                    self.put(" ")
            else:
                self.put(rng.choice(["", " "]))
            closing = rng.random() < 0.4
            if closing and attributes and rng.random() < 0.3:
                n0, _ = self.put("low=")
                v0, v1 = self.put("5/")  # a bare value keeps its slash, which still closes the tag
                attributes.append({"name": {"value": "low", "a": n0, "z": n0 + 3}, "value": {"value": "5/", "a": v0, "z": v1}, "type": 2, "z": v1})
            elif closing:
                self.put("/")
        _, z = self.put(">")
        if name:
            self.note("OpenTagStart", name=name, a=a)
        for x in attributes:
            self.note("Attribute", **x)
        own = {"name": name, "attributes": attributes, "texts": [], "a": a, "open_z": z}
        self.note("OpenTag", **{**own, "closing": closing, "close": None})
        if closing:
            self.note("CloseTag", **{**own, "closing": True, "close": None, "implicit": False})
        else:
            self.stack.append(own)
        self.construct()

    def close(self):
        open_names = [x["name"] for x in self.stack]
        name = self.rng.choice([*NAMES, ""]) if self.rng.random() < 0.4 or not open_names else self.rng.choice(open_names[-3:])
        blank = self.rng.choice(["", " "]) if name else ""
        a, z = self.put(f"</{name}{blank}>")
        self.construct()
        if name not in open_names:
            self.node(f"</{name}>", a, z)
            return
        while True:
            own = self.stack.pop()
            explicit = own["name"] == name
            self.note("CloseTag", **{**own, "texts": list(own["texts"]), "closing": False, "close": (a, z) if explicit else None, "implicit": not explicit})
            if explicit:
                return

    # ---- what is to be read, as plain tuples

    def place(self, at):
        before = self.text[:at]
        return before.count("\n"), len(before.rsplit("\n", 1)[-1].encode("utf-16-le")) // 2

    def byte(self, at):
        return len(self.text[:at].encode())

    def plain_node(self, x):
        return ("", (0, 0), (0, 0), 0, 0) if x is None else (x["value"], self.place(x["a"]), self.place(x["z"]), self.byte(x["a"]), self.byte(x["z"]))

    def plain_attribute(self, x):
        return self.plain_node(x["name"]), self.plain_node(x["value"]), x["type"], self.byte(x["name"]["a"]), self.byte(x["z"])

    def expected(self):
        out = []
        for seq, (kind, x) in enumerate(self.events):
            if kind == "Attribute":
                entity = self.plain_attribute(x)
            elif kind == "ProcessingInstruction":
                entity = (self.plain_node(x["target"]), self.plain_node(x["content"]), self.place(x["a"]), self.place(x["z"]), self.byte(x["a"]), self.byte(x["z"]))
            elif kind == "OpenTagStart":
                entity = (x["name"], (), (), False, self.place(x["a"]), (0, 0), (0, 0), (0, 0), self.byte(x["a"]), 0, False)
            elif kind in ("OpenTag", "CloseTag"):
                attributes = tuple(self.plain_attribute(y) for y in x["attributes"])
                texts = tuple(self.plain_node(y) for y in x["texts"]) if kind == "CloseTag" else ()
                close = tuple(map(self.place, x["close"])) if x["close"] else ((0, 0), (0, 0))
                end = x["close"][1] if x["close"] else x["open_z"]
                entity = (x["name"], attributes, texts, x["closing"], self.place(x["a"]), self.place(x["open_z"]), *close, self.byte(x["a"]), self.byte(end), x.get("implicit", False))
            else:
                entity = self.plain_node(x)
            out.append((seq, KINDS[kind], entity))
        return out


def plain(found):
    """Events of the lexer as plain tuples."""

    def bare(x):
        return tuple(map(bare, x)) if isinstance(x, tuple) else x

    return [(n, m, bare(e)) for n, m, e in found]


SHEETS = [Sheet(seed, steps=5 + seed % 12, marked=seed % 7 == 3) for seed in range(24)]
# whole documents, and some that end within whatever is there
CASES = [s.text for s in SHEETS] + [s.text[: len(s.text) * 2 // 3] for s in SHEETS[:8]] + ["", "x", "é", "\n \n", "🦆"]
