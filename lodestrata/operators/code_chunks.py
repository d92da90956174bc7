"""Symbol chunkers for TypeScript/JavaScript, PHP and Go, run over Arrow batches.

These scan source text statefully, which columns can't express. A file becomes spans of lines with names; folding,
hashing and ids follow. A file without symbols is one chunk of type `file`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import MAX_TOKENS, MIN_TOKENS
from lodestrata.operators.chunks import CHUNK_COLUMNS, Limit, finish
from lodestrata.session import spread

_S = r"[\t\n\f\r ]"
# Declarations at column 0 that make symbols, in the order of their priority on one line.
SCRIPT_DECLARATIONS = {
    "class": rf"^(?:export{_S}+)?(?:abstract{_S}+)?class{_S}+(\w+)(?:{_S}+extends{_S}+\w+)?(?:{_S}+implements{_S}+[\w,\t\n\f\r <>]+)?{_S}*\{{",
    "interface": rf"^(?:export{_S}+)?interface{_S}+(\w+)(?:{_S}*<[^>]+>)?(?:{_S}+extends{_S}+[\w,\t\n\f\r <>]+)?{_S}*\{{",
    "enum": rf"^(?:export{_S}+)?(?:const{_S}+)?enum{_S}+(\w+){_S}*\{{",
    "type": rf"^(?:export{_S}+)?type{_S}+(\w+)(?:{_S}*<[^>]+>)?{_S}*=",
    "function": rf"^(?:export{_S}+)?(?:async{_S}+)?function{_S}+(\w+){_S}*(?:<[^>]*>)?{_S}*\(",
    "arrow_function": rf"^(?:export{_S}+)?(?:const|let|var){_S}+(\w+){_S}*(?::{_S}*[^=]+)?{_S}*={_S}*(?:async{_S}+)?(?:\([^)]*\)|[^=]){_S}*=>",
    "export_default": rf"^export{_S}+default{_S}+(?:async{_S}+)?(?:function|class){_S}+(\w+)?",
}
PHP_DECLARATIONS = {
    "class": rf"^(?:abstract{_S}+|final{_S}+)?class{_S}+(\w+)(?:{_S}+extends{_S}+[\w\\]+)?(?:{_S}+implements{_S}+[\w\\,\t\n\f\r ]+)?{_S}*\{{?",
    "interface": rf"^interface{_S}+(\w+)(?:{_S}+extends{_S}+[\w\\,\t\n\f\r ]+)?{_S}*\{{",
    "trait": rf"^trait{_S}+(\w+){_S}*\{{",
    "enum": rf"^enum{_S}+(\w+)(?:{_S}*:{_S}*\w+)?(?:{_S}+implements{_S}+[\w\\,\t\n\f\r ]+)?{_S}*\{{",
    "function": rf"^function{_S}+(\w+){_S}*\(",
}
PHP_NAMESPACE = re.compile(rf"^namespace{_S}+([\w\\]+){_S}*;", re.M | re.A)
#: Lines a brace search goes on for if nothing closes.
SCRIPT_REACH, PHP_REACH = 50, 100
NEW_STATEMENT = ("export ", "type ", "interface ", "class ", "function ", "const ", "let ")


def tokens(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass")) // 4


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    text: str

    @property
    def size(self) -> int:
        return tokens(self.text)


def declarations(text: str, patterns: dict[str, re.Pattern]) -> list[tuple[int, str, str]]:
    """(line, kind, name) in order of lines; of several on one line the first kind counts."""
    best: dict[int, tuple[int, str, str]] = {}
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in pattern.finditer(text):
            if m[1]:
                line = text.count("\n", 0, m.start()) + 1
                if line not in best or rank < best[line][0]:
                    best[line] = (rank, kind, m[1])
    return [(line, kind, name) for line, (_, kind, name) in sorted(best.items())]


def comment_start(lines: list[str], line: int, marks: tuple[str, ...]) -> int:
    """The first line of what documents the declaration on `line`; blank lines between are stepped over."""
    first, above = line, line - 1
    while above >= 1:
        row = lines[above - 1].strip()
        if row.endswith("*/"):
            opened = next((n for n in range(above, 0, -1) if "/**" in lines[n - 1]), None)
            if opened:
                return opened
        if row.startswith(marks):
            first = above
        elif row:
            break
        above -= 1
    return first


def brace_end(lines: list[str], line: int, quotes: str, reach: int) -> int:
    """The line on which the first block that opens at or after `line` closes; strings end with their line."""
    marks = re.compile(rf"[{{}}{re.escape(quotes)}]")
    depth, opened = 0, False
    for n in range(line, len(lines) + 1):
        row, quote = lines[n - 1], ""
        for m in marks.finditer(row):
            c = m[0]
            if quote:
                if c == quote and (m.start() == 0 or row[m.start() - 1] != "\\"):
                    quote = ""
            elif c in quotes:
                quote = c
            elif c == "{":
                depth, opened = depth + 1, True
            else:
                depth -= 1
                if opened and depth == 0:
                    return n
    return line + reach


def type_end(lines: list[str], line: int) -> int:
    """The line that ends a type alias."""
    depth = 0
    for n in range(line, len(lines) + 1):
        for c in lines[n - 1]:
            if c in "{<(":
                depth += 1
            elif c in "}>)":
                depth -= 1
            elif c == ";" and depth == 0:
                return n
        if depth == 0 and n < len(lines) and lines[n].strip().startswith(NEW_STATEMENT):
            return n
    return line


def cut(text: str, patterns: dict[str, re.Pattern], marks: tuple[str, ...], end: Callable[[list[str], int, str], int]) -> list[Symbol]:
    lines, found, out = text.split("\n"), declarations(text, patterns), []
    for k, (line, kind, name) in enumerate(found):
        first = comment_start(lines, line, marks) if line > 1 else line
        last = end(lines, line, kind)
        if k + 1 < len(found):
            last = min(last, found[k + 1][0] - 1)
        last = max(min(last, len(lines)), first)
        out.append(Symbol(name, kind, first, last, "\n".join(lines[first - 1 : last])))
    return out


def script_symbols(text: str) -> list[Symbol]:
    return cut(text, SCRIPT, ("//", "@"), lambda rows, n, kind: type_end(rows, n) if kind == "type" else brace_end(rows, n, "\"'`", SCRIPT_REACH))


def php_symbols(text: str) -> list[Symbol]:
    return cut(text, PHP, ("//", "#["), lambda rows, n, kind: brace_end(rows, n, "\"'", PHP_REACH))


SCRIPT = {k: re.compile(p, re.M | re.A) for k, p in SCRIPT_DECLARATIONS.items()}
PHP = {k: re.compile(p, re.M | re.A) for k, p in PHP_DECLARATIONS.items()}


def fold_pending(symbols: list[Symbol], least: int, most: int) -> list[Symbol]:
    """Small symbols in a row become one; a large one after them takes them in front if both fit, and drops their name."""
    if len(symbols) <= 1:
        return symbols
    out: list[Symbol] = []
    held: Symbol | None = None
    for s in symbols:
        if s.size < least:
            held = s if held is None else replace(held, name=f"{held.name}+{s.name}", end=s.end, text=f"{held.text}\n\n{s.text}")
            continue
        if held is not None:
            if held.size + s.size <= most:
                s = replace(s, start=held.start, text=f"{held.text}\n\n{s.text}")
            else:
                out.append(held)
            held = None
        out.append(s)
    return [*out, held] if held is not None else out


GO_LEX = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+'|[(){}\[\]\"`']|/\*", re.S)
GO_DECLARATION = re.compile(r"(func|type)\b")


def go_symbols(text: str) -> tuple[list[Symbol], str] | None:
    """(functions, methods and types in source order, package), or None if the text can't be parsed as Go."""
    # blank out strings and comments, keep line ends and brackets
    out, at, depth, comments = [], 0, [], []
    for m in GO_LEX.finditer(text):
        out.append(text[at : m.start()])
        token, at = m[0], m.end()
        if token in "([{":
            depth.append(token)
            out.append(token)
        elif len(token) == 1 and token in ")]}":
            if not depth or "([{".index(depth.pop()) != ")]}".index(token):
                return None
            out.append(token)
        elif token in ('"', "`", "'", "/*"):
            return None
        else:
            if token.startswith(("//", "/*")):
                comments.append((m.start(), m.end()))
            out.append(re.sub(r"[^\n]", " " if token[0] == "/" else "_", token))
    if depth:
        return None
    code = "".join([*out, text[at:]])
    package = re.match(r"[\s﻿]*package\s+(\w+)", code)
    if not package:
        return None
    lines = text.split("\n")
    starts, flat = [0], code.split("\n")
    for row in flat:
        starts.append(starts[-1] + len(row) + 1)
    closed = [c[1] for c in comments]

    def comment_before(at: int, breaks: tuple[int, ...]) -> tuple[int, int] | None:
        """The comment that ends before `at` with nothing but so many line ends between; only the last one can."""
        k = bisect_right(closed, at) - 1
        between = text[closed[k] : at] if k >= 0 else "x"
        return comments[k] if not between.strip("\n\t\r ") and between.count("\n") in breaks else None

    symbols: list[Symbol] = []
    level, n = 0, 0
    while n < len(flat):
        row = flat[n]
        if level == 0 and (m := GO_DECLARATION.match(row)):
            last, inside = n, 0
            while True:  # to the line on which all brackets are closed
                inside += sum(flat[last].count(c) for c in "([{") - sum(flat[last].count(c) for c in ")]}")
                if inside <= 0 or last + 1 >= len(flat):
                    break
                last += 1
            first = n
            doc = comment_before(starts[n], (0, 1))
            while doc and not text[text.rfind("\n", 0, doc[0]) + 1 : doc[0]].strip():
                first = text.count("\n", 0, doc[0])
                doc = comment_before(doc[0], (1,))
            body = "\n".join(flat[n : last + 1])
            content = "\n".join(lines[first : last + 1])
            if m[1] == "func":
                head = re.match(r"func\s*(?:\(\s*(?:[\w]+\s+)?(?P<star>\*?)\s*(?P<recv>\w+)(?P<generic>\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)", body)
                if head:
                    method = bool(re.match(r"func\s*\(", body))
                    owner = head["recv"] if method and not head["generic"] else None
                    symbols.append(Symbol(f"{owner}.{head['name']}" if owner else head["name"], "method" if method else "function", first + 1, last + 1, content))
            else:
                for name, kind in _type_specs(body):
                    symbols.append(Symbol(name, kind, first + 1, last + 1, content))
            n = last + 1
            continue
        level += sum(row.count(c) for c in "([{") - sum(row.count(c) for c in ")]}")
        n += 1
    return symbols, package[1]


def _type_specs(body: str) -> Iterator[tuple[str, str]]:
    inner = re.match(r"type\s*\((.*)\)", body, re.S)
    depth, parts = 0, []
    if inner:
        row = ""
        for c in inner[1]:
            depth += c in "([{"
            depth -= c in ")]}"
            if depth == 0 and c in "\n;":
                parts.append(row)
                row = ""
            else:
                row += c
        parts.append(row)
    else:
        parts = [body[4:]]
    for p in parts:
        m = re.match(r"\s*(\w+)\s*(?:\[(?!\s*\])[^\]]*\s[^\]]*\]\s*)?=?\s*(struct\b|interface\b)?", p)
        if m:
            yield m[1], m[2] or "type"


def fold_go(symbols: list[Symbol], least: int) -> list[Symbol]:
    """Small symbols go behind the next large one, those at the end behind the last; if all are small they are one."""
    if len(symbols) <= 1:
        return symbols
    out: list[Symbol] = []
    small: list[Symbol] = []

    def take(target: Symbol) -> Symbol:
        every = [target, *small]
        return replace(target, name=f"{target.name}+{len(small)}", start=min(s.start for s in every), end=max(s.end for s in every), text="\n\n".join(s.text for s in every))

    for s in symbols:
        if s.size < least:
            small.append(s)
        else:
            out.append(take(s) if small else s)
            small = []
    if small and out:
        out[-1] = take(out[-1])
    elif small:
        out.append(Symbol("+".join(s.name for s in small), "combined", min(s.start for s in small), max(s.end for s in small), "\n\n".join(s.text for s in small)))
    return out


def chunk_text(kind: str, path: str, module: str, language: str, text: str, merge: bool, least: int, most: int) -> list[tuple]:
    """(symbol, id symbol, type, start, end, content, language, module) of one file."""
    base = path.rpartition("/")[2]
    symbols: list[Symbol] = []
    if kind == "typescript":
        symbols = script_symbols(text)
        if symbols and merge:
            symbols = fold_pending(symbols, least, most)
        rows = [(s.name, s.name, s.kind, s.start, s.end, s.text, language, module) for s in symbols]
        whole = path
    elif kind == "php":
        space = PHP_NAMESPACE.search(text)
        space = space[1] if space else ""
        symbols = php_symbols(text)
        if symbols and merge:
            symbols = fold_pending(symbols, least, most)
        rows = [(f"{space}\\{s.name}" if space and s.kind == "class" else s.name, s.name, s.kind, s.start, s.end, s.text, "php", space) for s in symbols]
        whole, language = path, "php"
    else:
        parsed = go_symbols(text)
        symbols, package = parsed if parsed else ([], "")
        if symbols and merge:
            symbols = fold_go(symbols, least)
        rows = [(s.name, s.name, s.kind, s.start, s.end, s.text, "go", module or package) for s in symbols]
        whole, language = base, "go"
    return rows or [(whole, whole, "file", 1, text.count("\n") + 1, text, language, module)]


def code_chunks(files: DataFrame, kind: str, merge: bool = False, min_tokens: Limit = MIN_TOKENS, max_tokens: Limit = MAX_TOKENS) -> DataFrame:
    """Chunks of files of one kind (`typescript`, `php` or `go`), with ids and hashes made by columns afterwards."""
    names = ["project_id", "file_path", "symbol", "id_symbol", "symbol_type", "start_line", "end_line", "content", "language", "module"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for project, path, language, module, text, least, most in zip(*(c.to_pylist() for c in b.columns)):
                if text is not None:
                    out += [(project, path, *row) for row in chunk_text(kind, path, module or "", language, text, merge, least, most)]
            columns = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n.endswith("_line") else pa.string()) for n, c in zip(names, columns)], names=names)

    ddl = ", ".join(f"{n} {'int' if n.endswith('_line') else 'string'}" for n in names)
    limits = [(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(n) for x, n in ((min_tokens, "least"), (max_tokens, "most"))]
    rows = spread(files.select("project_id", "file_path", "language", "module", "text", *limits)).mapInArrow(run, ddl)
    return finish(rows, F.col("id_symbol")).select(*CHUNK_COLUMNS)
