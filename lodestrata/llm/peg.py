"""Packrat parsing-expression grammars over token codes.

A grammar is text: `rule <- expression` with ordered choice `/`, `*`, `+`, `?`, predicates `&` and `!`, groups, rules,
quoted tokens and upper-case token classes. A text is first lexed into a string with one character per token, so the
grammar compiles as follows: a rule that doesn't call itself is a regular expression with atomic choices and
possessive repeats, which mean exactly ordered choice and greedy repetition; a recursive rule becomes a function that
memoizes its result by position and skips alternatives that can't begin with the token at hand.

Where brackets nest deeply, positions of opening brackets are parsed from right to left first: what stands inside is
then remembered when the outside asks for it, so calls never nest deeper than a few brackets, however deep a text is.

A text that isn't consumed is parsed once more by the same grammar compiled without regular expressions, token by
token, which keeps the exact furthest position at which anything failed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

END = "\0"
DEEP = 64  # brackets that may be open at once before the insides are parsed first


class Codes:
    """One character for each token text or class; a second one for tokens that begin a line, if `lines` is set."""

    def __init__(self, classes: list[str], texts: list[str], lines: bool = False):
        self.lines = lines
        self.of: dict[str, str] = {}
        for name in [*classes, *texts]:
            if name not in self.of:
                self.of[name] = chr(0x21 + len(self.of))
        self.shift = 0x21 + len(self.of)
        self.later = {name: chr(ord(c) + self.shift) if lines else c for name, c in self.of.items()}

    def both(self, name: str) -> str:
        return self.of[name] + (self.later[name] if self.lines else "")


# expressions: ("set", chars) ("seq", [e]) ("alt", [e]) ("star", e) ("plus", e) ("opt", e) ("and", e) ("not", e) ("rule", name)
class Grammar:
    def __init__(self, source: str, codes: Codes, start: str = "file", single: bool = False):
        self.source, self.codes, self.single = source, codes, single
        self.rules: dict[str, tuple] = {}
        for m in re.finditer(r"(?m)^\s*(\w+) <- (.*(?:\n\s+(?!\w+ <-).*)*)", source):
            self.tokens = re.findall(r"'[^']*'|\"[^\"]*\"|\w+|[/*+?&!()]", m[2])
            self.at = 0
            self.rules[m[1]] = self.choice()
            assert self.at == len(self.tokens), (m[1], self.tokens[self.at :])
        self.start = start
        self.regular = set() if single else self.find_regular()
        self.first, self.nullable = self.find_first()
        self.opening = frozenset(c for t in ("(", "[", "{") if t in codes.of for c in codes.both(t))
        self.brackets = re.compile("[" + re.escape("".join(self.opening) + "".join(c for t in (")", "]", "}") if t in codes.of for c in codes.both(t))) + "]")
        self.run = self.build()
        self.tracker: Grammar | None = None

    def parse(self, s: str) -> tuple[int, int]:
        """(end or -1, furthest failure) of a string of codes that ends with END."""
        end, far = self.inside_out(s)
        if end < 0 and not self.single:
            if self.tracker is None:
                self.tracker = Grammar(self.source, self.codes, self.start, True)
            end, far = self.tracker.inside_out(s)
        return end, far

    def inside_out(self, s: str) -> tuple[int, int]:
        try:
            return self.run(s, self.deep(s))
        except RecursionError:  # what nests without brackets, as chains of unary operators: every place from the right
            return self.run(s, range(len(s) - 1, -1, -1))

    def deep(self, s: str) -> list[int]:
        """Places of opening brackets from right to left, if more than DEEP are ever open at once."""
        depth = most = 0
        for c in self.brackets.findall(s):
            if c in self.opening:
                depth += 1
                if depth > most:
                    most = depth
            else:
                depth -= 1
        return [m.start() for m in self.brackets.finditer(s) if m[0] in self.opening][::-1] if most > DEEP else []

    # reading the notation
    def choice(self) -> tuple:
        parts = [self.sequence()]
        while self.at < len(self.tokens) and self.tokens[self.at] == "/":
            self.at += 1
            parts.append(self.sequence())
        if all(p[0] == "set" for p in parts):
            return ("set", "".join(p[1] for p in parts))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.at < len(self.tokens) and self.tokens[self.at] not in "/)":
            parts.append(self.prefix())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefix(self) -> tuple:
        t = self.tokens[self.at]
        if t in "&!":
            self.at += 1
            return ("and" if t == "&" else "not", self.prefix())
        e = self.atom()
        while self.at < len(self.tokens) and self.tokens[self.at] in "*+?":
            e = ({"*": "star", "+": "plus", "?": "opt"}[self.tokens[self.at]], e)
            self.at += 1
        return e

    def atom(self) -> tuple:
        t = self.tokens[self.at]
        self.at += 1
        if t == "(":
            e = self.choice()
            assert self.tokens[self.at] == ")"
            self.at += 1
            return e
        if t[0] in "'\"":
            return ("set", self.codes.both(t[1:-1]))
        if t == "NL":
            return ("and", ("set", "".join(self.codes.later.values())))
        if t == "EOF":
            return ("set", END)
        if t.isupper() and t in self.codes.of:
            return ("set", self.codes.both(t))
        return ("rule", t)

    # which rules are regular: those from which no rule reaches itself
    def find_regular(self) -> set[str]:
        def calls(e) -> set[str]:
            if e[0] == "rule":
                return {e[1]}
            if e[0] == "set":
                return set()
            return set().union(*(calls(x) for x in (e[1] if e[0] in ("seq", "alt") else [e[1]])))

        direct = {n: calls(e) for n, e in self.rules.items()}
        for n, used in direct.items():
            assert used <= self.rules.keys(), (n, used - self.rules.keys())
        recursive: set[str] = set()
        for n in self.rules:
            todo, seen = list(direct[n]), set()
            while todo:
                r = todo.pop()
                if r == n:
                    recursive.add(n)
                if r not in seen:
                    seen.add(r)
                    todo += direct[r]
        regular = {n for n in self.rules if n not in recursive}
        changed = True
        while changed:  # a rule that calls a recursive one isn't regular either
            bad = {n for n in regular if direct[n] - regular}
            changed = bool(bad)
            regular -= bad
        return regular

    def is_regular(self, e: tuple) -> bool:
        if e[0] == "set":
            return True
        if self.single:
            return False
        if e[0] == "rule":
            return e[1] in self.regular
        return all(map(self.is_regular, e[1] if e[0] in ("seq", "alt") else [e[1]]))

    def regex(self, e: tuple) -> str:
        kind, x = e
        if kind == "set":
            return "[" + "".join(re.escape(c) if c != END else r"\0" for c in sorted(set(x))) + "]"
        if kind == "rule":
            return f"(?>{self.regex(self.rules[x])})"
        if kind == "seq":
            return "".join(map(self.regex, x))
        if kind == "alt":
            return "(?>" + "|".join(map(self.regex, x)) + ")"
        if kind == "and":
            return f"(?={self.regex(x)})"
        if kind == "not":
            return f"(?!{self.regex(x)})"
        return f"(?:{self.regex(x)}){ {'star': '*+', 'plus': '++', 'opt': '?+'}[kind]}"

    # sets of first tokens
    def find_first(self) -> tuple[dict[str, frozenset[str]], dict[str, bool]]:
        first = {n: frozenset() for n in self.rules}
        null = {n: False for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, e in self.rules.items():
                f, z = self.first_of(e, first, null)
                if f != first[n] or z != null[n]:
                    first[n], null[n], changed = f, z, True
        return first, null

    def first_of(self, e: tuple, first, null) -> tuple[frozenset[str], bool]:
        kind, x = e
        if kind == "set":
            return frozenset(x), False
        if kind == "rule":
            return first[x], null[x]
        if kind == "alt":
            got = [self.first_of(y, first, null) for y in x]
            return frozenset().union(*(f for f, _ in got)), any(z for _, z in got)
        if kind == "seq":
            f: frozenset[str] = frozenset()
            for y in x:
                g, z = self.first_of(y, first, null)
                f |= g
                if not z:
                    return f, False
            return f, True
        if kind in ("and", "not"):
            return frozenset(), True
        f, z = self.first_of(x, first, null)
        return f, z or kind != "plus"

    # compilation
    def build(self) -> Callable[[str], tuple[int, int]]:
        self.out: list[str] = []
        self.names = 0
        self.consts: dict[str, object] = {}
        body = []
        for n in self.rules:
            if n not in self.regular or n == self.start:
                self.out = []
                self.emit(self.rules[n], 2, "fail")
                lines = "\n".join(self.out)
                body.append(f"    memo_{n} = {{}}\n    def r_{n}(p):\n        nonlocal far\n        q = memo_{n}.get(p)\n        if q is not None: return q\n        start = p\n        while True:\n{self.indent(lines)}\n            memo_{n}[start] = p\n            return p\n        memo_{n}[start] = -1\n        return -1")
        # places that are parsed ahead: every rule that may begin there
        inner = [(n, self.constant(self.first[n], "F")) for n in self.rules if n != self.start and n not in self.regular]
        ahead = "    for p in deep:\n        c = s[p]\n" + "".join(f"        if c in {f}: r_{n}(p)\n" for n, f in inner) + "    far = 0\n" if inner else ""
        code = "def parse(s, deep):\n    far = 0\n" + "\n".join(body) + f"\n{ahead}    end = r_{self.start}(0)\n    return end, far\n"
        space = dict(self.consts)
        exec(compile(code, "<grammar>", "exec"), space)
        self.code = code
        return space["parse"]

    @staticmethod
    def indent(lines: str) -> str:
        return "\n".join("    " + x for x in lines.split("\n"))

    def name(self, prefix: str) -> str:
        self.names += 1
        return f"{prefix}{self.names}"

    def put(self, depth: int, line: str) -> None:
        self.out.append("    " * depth + line)

    def constant(self, value: object, prefix: str) -> str:
        for k, v in self.consts.items():
            if v is value or isinstance(v, frozenset) and v == value:
                return k
        n = self.name(prefix)
        self.consts[n] = value
        return n

    def emit(self, e: tuple, depth: int, mode: str) -> None:
        """Code that advances p over e, or `break`s out of the enclosing one-turn loop if e fails."""
        kind, x = e
        put = self.put
        if kind == "seq":
            run: list[tuple] = []
            for y in [*x, None]:
                if y is not None and self.is_regular(y):
                    if self.single:
                        self.regular_run(y, depth)
                    else:
                        run.append(y)
                    continue
                if run:
                    self.regular_run(("seq", run) if len(run) > 1 else run[0], depth)
                    run = []
                if y is not None:
                    self.emit(y, depth, mode)
            return
        if self.is_regular(e):
            self.regular_run(e, depth)
            return
        if kind == "rule":
            q = self.name("q")
            put(depth, f"{q} = r_{x}(p)")
            put(depth, f"if {q} < 0: break")
            put(depth, f"p = {q}")
        elif kind == "alt":
            done, at = self.name("d"), self.name("a")
            put(depth, f"{done} = False; {at} = p; c = s[p]")
            for y in x:
                f, z = self.first_of(y, self.first, self.nullable)
                guard = "" if z else f" and c in {self.constant(f, 'F')}"
                put(depth, f"if not {done}{guard}:")
                put(depth + 1, "while True:")
                self.emit(y, depth + 2, mode)
                put(depth + 2, f"{done} = True")
                put(depth + 2, "break")
                put(depth + 1, f"if not {done}: p = {at}; c = s[p]")
            put(depth, f"if not {done}:")
            put(depth + 1, "if p > far: far = p")
            put(depth + 1, "break")
        elif kind in ("star", "plus", "opt"):
            f, z = self.first_of(x, self.first, self.nullable)
            if kind == "plus":
                self.emit(x, depth, mode)
            at, ok = self.name("a"), self.name("k")
            guard = "True" if z else f"s[p] in {self.constant(f, 'F')}"
            put(depth, f"{'if' if kind == 'opt' else 'while'} {guard}:")
            put(depth + 1, f"{at} = p; {ok} = False")
            put(depth + 1, "while True:")
            self.emit(x, depth + 2, mode)
            put(depth + 2, f"{ok} = True")
            put(depth + 2, "break")
            put(depth + 1, f"if not {ok}:")
            put(depth + 2, f"p = {at}")
            if kind != "opt":
                put(depth + 2, "break")
                put(depth + 1, f"if p == {at}: break")
        else:
            at, ok = self.name("a"), self.name("k")
            put(depth, f"{at} = p; {ok} = False; saved = far")
            put(depth, "while True:")
            self.emit(x, depth + 1, mode)
            put(depth + 1, f"{ok} = True")
            put(depth + 1, "break")
            put(depth, f"p = {at}; far = saved")
            put(depth, f"if {'not ' if kind == 'and' else ''}{ok}: break")

    def regular_run(self, e: tuple, depth: int) -> None:
        put = self.put
        if e[0] == "set":
            chars = self.constant(frozenset(e[1]), "F")
            put(depth, f"if s[p] not in {chars}:")
            put(depth + 1, "if p > far: far = p")
            put(depth + 1, "break")
            put(depth, "p += 1")
            return
        m = self.name("m")
        matcher = self.constant(re.compile(self.regex(e), re.S).match, "M")
        put(depth, f"{m} = {matcher}(s, p)")
        put(depth, f"if {m} is None:")
        put(depth + 1, "if p > far: far = p")
        put(depth + 1, "break")
        put(depth, f"p = {m}.end()")
