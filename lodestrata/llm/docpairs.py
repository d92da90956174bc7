"""Problem 5: functions and methods paired with their documentation.

One recursive pattern per language reads a text from left to right. Strings and comments are alternatives of it, so
nothing inside them is taken for code; a run of comments directly above a declaration is captured together with the
annotations, the signature with balanced parentheses and the balanced body. Types are captured in the same way; the
innermost type whose body holds a method names it. Captures whose documentation is trivial are filtered out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrow import map_rows

LEAST_WORDS = 6
# Instructions to tools.
TOOLS = regex.compile(
    r"(?i)^\W*(?:eslint|tslint|jshint|jslint|jscs|prettier|noqa|nolint|pylint|flake8|mypy|type:|pyright|ruff|black|isort|fmt:|phpcs|phpstan|phpmd|psalm|checkstyle|nosonar|noinspection|suppress|istanbul|c8 |v8 |@ts-|ts-ignore|@codecoverage|codingstandards|go:|\+build|lint:|spell|cspell|region\b|endregion\b|sonar|pragma|coverage|biome|webpack|@vite|globals?\b|exported\b|line \d|#line|clang-format|vim:|-\*-)"
)
TAG = regex.compile(r"^\s*(?:@\w+|\\\w+\b|:\w[\w ]*:|\{@\w+[^}]*\})")
SECTION = regex.compile(r"^\s*(?:args|arguments|params|parameters|returns?|raises|throws|yields|attributes|examples?|keyword args|other parameters|see also|notes?|todo)\s*:?\s*$", regex.I)
SECTION_COLON = regex.compile(r"^\s*(?:args|arguments|params|parameters|returns?|raises|throws|yields|attributes|keyword args)\s*:", regex.I)
CODE_LINE = regex.compile(r"[;{}]\s*$|^\s*[}\])]|^\s*(?:return|if|for|while|else|elif|import|from|var|let|const|def|func|function|try|except|print|public|private|static|new|throw|raise)\b.*[(){}=:]|^\s*[\w.$\[\]>-]+\s*(?::=|=(?!=)|\+=|-=)\s*\S|^\s*[\w.$]+(?:->|\.|::)?\w*\([^)]*\)\s*;?\s*$|=>\s*[{(]?$")
WORD = regex.compile(r"[^\W\d_][\w'’-]*")

STRINGS = r'"(?:[^"\\\n]++|\\.)*+"|' + r"'(?:[^'\\\n]++|\\.)*+'"
TEMPLATE = r"`(?:[^`\\]++|\\.)*+`"
#: Strings and comments stand inline, because a call of a group costs more than the text it protects.
GROUPS = r"""(?(DEFINE)
 (?<COM>%(comment)s)
 (?<PAR>\((?:[^()"'`/\#]++|%(inline)s|[/\#]|(?&PAR))*+\))
 (?<SQ>\[(?:[^\[\]"'`/\#]++|%(inline)s|[/\#]|(?&SQ))*+\])
 (?<ANG><(?:[^<>(){};]++|(?&ANG))*+>)
 %(body)s
)"""
BODY = r"(?<BODY>\{(?:[^{}\"'`/\#]++|%(inline)s|[/\#\"'`]|(?&BODY))*+\})"
NAME = r"[A-Za-z_$][\w$]*+"


# what an arrow without braces returns, up to the end of its statement; otherwise the balanced body
ARROW_VALUE = r"(?:[^()\[\]{};,\n\"'`]++|" + STRINGS + "|" + TEMPLATE + r"|\n(?=\s*[.?:&|+*])|(?<B>[(\[{](?:[^()\[\]{}\"'`]++|" + STRINGS + "|" + TEMPLATE + r"|(?&B))*+[)\]}]))*+;?+"
WHOLE = r"(?:(?<==>)\s*+(?<value>(?!\{)" + ARROW_VALUE + r")|(?<whole>[^{;]*+(?&BODY)))?+"


def pattern(strings: str, hash_comments: bool, notes: str, heads: str) -> regex.Pattern:
    """`notes` are annotations between documentation and declaration, `heads` the signatures."""
    hash_part = r"|\#(?!\[)[^\n]*+" if hash_comments else ""
    comment = r"/\*(?:[^*]++|\*(?!/))*+\*/|//[^\n]*+" + hash_part
    inline = strings + "|" + comment
    groups = GROUPS % {"comment": comment, "inline": inline, "body": BODY % {"inline": inline}}
    doc = r"(?<doc>(?&COM)(?:[ \t\r]*+\n[ \t]*+(?&COM))*+)"
    return regex.compile(
        groups + doc + r"(?<gap>(?:[ \t\r]*+\n)?+[ \t]*+(?:(?:" + notes + r")[ \t\r]*+\n?[ \t]*+)*+)(?:" + heads + r")" + WHOLE,
        regex.X | regex.S,
    )


MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|strictfp|readonly|override|async|declare|sealed|open)\s++)*+"
NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|else|new|throw|do|try|case|function|super|this|typeof|await|yield|synchronized|assert)\b)"
# regular expression literals of JavaScript count as strings where an operand is expected
REGEXP = r"(?<=[(,=:\[!&|?{};+\n]\s{0,3})/(?![*/])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
SCRIPT_HEADS = (
    r"(?<sig>(?:export\s++(?:default\s++)?+)?+(?:declare\s++)?+(?:async\s++)?+function\b\s*+\*?\s*+(?<name>" + NAME + r")\s*+(?&ANG)?+\s*+(?&PAR)(?:\s*+:[^{};=]++)?+)"
    r"|(?<sig2>(?:export\s++)?+(?:const|let|var)\s++(?<name2>" + NAME + r")\s*+(?::(?:[^=;{}]++|=>|\{[^{}]*+\})*+)?+=\s*+(?:async\b\s*+)?+(?:function\b\s*+\*?\s*+(?:" + NAME + r")?\s*+(?&PAR)(?:\s*+:[^{};=]++)?+|(?&ANG)?+\s*+(?&PAR)(?:\s*+:(?:[^=;{}]++|\{[^{}]*+\})++)?+\s*+=>|" + NAME + r"\s*+=>))"
    r"|(?<sig3>" + MODIFIERS + r"(?:(?:get|set)\s++(?=[\w$#\[]))?+\*?\s*+" + NOT_NAMES + r"(?<name3>\#?" + NAME + r")\s*+\??(?&ANG)?+\s*+(?&PAR)(?:\s*+:(?:[^{};=]++|\{[^{}]*+\}(?=\s*+[{;]))*+)?+)(?=\s*+[{;])"
    r"|(?<sig4>" + MODIFIERS + NOT_NAMES + r"(?<name4>\#?" + NAME + r")\s*+(?::[^=;{}]++)?+=\s*+(?:async\b\s*+)?+(?&PAR)(?:\s*+:[^=;{}]++)?+\s*+=>)"
)
SCRIPT = pattern(STRINGS + "|" + TEMPLATE + "|" + REGEXP, False, r"@[\w.]++(?&PAR)?+", SCRIPT_HEADS)
JAVA_TYPE = r"(?!(?:return|new|else|throw|case|package|import|assert)\b)[\w.]++(?:(?&ANG))?+(?:\[\])*+"
JAVA = pattern(
    r'"""(?:[^"\\]++|\\.|"(?!""))*+"""|' + STRINGS,
    False,
    r"@(?!interface\b)[\w.]++\s*+(?&PAR)?+",
    r"(?<sig>(?:(?:@[\w.]++(?&PAR)?+\s++)*+" + MODIFIERS + r")(?:(?&ANG)\s*+)?+(?:" + JAVA_TYPE + r"\s++)?+" + NOT_NAMES + r"(?<name>[A-Za-z_$][\w$]*+)\s*+(?&PAR)(?:\s*+\[\])*+(?:\s*+throws\s++[\w.,\s]++)?+)(?=\s*+[{;])",
)
PHP = pattern(
    STRINGS + r"|<<<[ \t]*+(?<hq>['\"]?)(?<here>\w++)(?P=hq)[^\n]*+\n(?:(?!\s*+(?P=here)\b)[^\n]*+\n)*+\s*+(?P=here)\b",
    True,
    r"\#(?&SQ)",
    r"(?<sig>(?:(?:abstract|final|public|protected|private|static|readonly)\s++)*+function\s++&?(?<name>[A-Za-z_\x80-\U0010ffff][\w]*+)\s*+(?&PAR)(?:\s*+:\s*+[\w\\?|&()\s]+?)?)(?=\s*+[{;])",
)
GO = pattern(
    STRINGS + "|" + TEMPLATE,
    False,
    r"(?!)",
    r"(?<sig>func\s*+(?:\(\s*+(?:\w++\s++)?+\*?\s*+(?<recv>\w++)(?:\[[^\]]*+\])?+\s*+\)\s*+)?+(?<name>\w++)\s*+(?&SQ)?+\s*+(?&PAR)[^{\n]*+)",
)
PY_STRINGS = r'[rRbBuUfF]{0,2}"""(?:[^"\\]++|\\.|"(?!""))*+"""|' + r"[rRbBuUfF]{0,2}'''(?:[^'\\]++|\\.|'(?!''))*+'''|[rRbBuUfF]{0,2}\"(?:[^\"\\\n]++|\\.)*+\"|[rRbBuUfF]{0,2}'(?:[^'\\\n]++|\\.)*+'"
PYTHON = regex.compile(
    r"(?(DEFINE)(?<STR>" + PY_STRINGS + r")(?<PAR>[(\[{](?:[^()\[\]{}\"'#]++|(?&STR)|#[^\n]*+|[\"']|(?&PAR))*+[)\]}]))"
    r"(?<ind>[ \t]*+)(?:(?<doc>#[^\n]*+(?:\r?\n[ \t]*+#[^\n]*+)*+)\r?\n[ \t]*+)?+(?<deco>(?:@[\w.]++(?&PAR)?+[^\n]*+\n[ \t]*+)*+)"
    r"(?:(?<sig>(?:async\s++)?+def\s++(?<name>\w++)\s*+(?&PAR)(?:\s*+->(?:[^:\n\[\"']++|(?&PAR)|(?&STR))++)?\s*+:)(?<tail>[ \t]*+(?:#[^\n]*+)?\r?\n(?:[ \t]*+(?:#[^\n]*+)?\r?\n)*+[ \t]++(?<quoted>[rRuU]?(?:\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'))(?=[ \t]*+(?:;|\#|\r?\n|$)))?"
    r")",
    regex.M | regex.S,
)
LANGUAGES = {"js": "script", "jsx": "script", "mjs": "script", "ts": "script", "tsx": "script", "java": "java", "php": "php", "go": "go", "py": "python"}
BY_NAME = {"javascript": "js", "typescript": "ts", "java": "java", "php": "php", "go": "go", "golang": "go", "python": "py", "js": "js", "ts": "ts", "py": "py"}
BRACED = {"script": SCRIPT, "java": JAVA, "php": PHP, "go": GO}
BODY_AT = {
    k: regex.compile(r"[^{;]*+" + BODY % {"inline": strings + r"|/\*(?:[^*]++|\*(?!/))*+\*/|//[^\n]*+" + (r"|\#(?!\[)[^\n]*+" if k == "php" else "")}, regex.S)
    for k, strings in (("script", STRINGS + "|" + TEMPLATE + "|" + REGEXP), ("java", r'"""(?:[^"\\]++|\\.|"(?!""))*+"""|' + STRINGS), ("php", STRINGS), ("go", STRINGS + "|" + TEMPLATE))
}


def described(comment: str) -> str:
    """The words of a documentation that describe: without marks, tags, parameter lists, tool instructions and code."""
    kept, coded, total, section = [], 0, 0, False
    body = regex.sub(r"^\s*/\*+!?|\*+/\s*$", "", comment.strip()) if comment.lstrip().startswith("/*") else comment
    body = regex.sub(r"\*+/[ \t\r]*\n[ \t]*/\*+|\*+/", "\n", body)
    for raw in body.split("\n"):
        line = regex.sub(r"^\s*(?:/\*+!?|\*(?!/)|//+!?|#+(?!\[))?\s?", "", raw).rstrip()
        bare = line.strip()
        if not bare:
            section = False if section == "tag" else section
            continue
        if TOOLS.match(bare):
            continue
        if SECTION.match(bare) or SECTION_COLON.match(bare):
            section = True
            continue
        if TAG.match(bare):
            section = "tag"
            inner = regex.match(r"@(?:brief|summary|description|desc)\s+(.*)", bare)
            if inner:
                kept.append(inner[1])
            continue
        if section:
            if section is True and regex.match(r"\S", line) and not regex.match(r"\w+(?: \([^)]*\))?\s*:", bare) and not regex.match(r"[-=]{3,}$", bare):
                section = section if raw[:1] in " \t*" else False
            if section:
                continue
        total += 1
        if CODE_LINE.search(bare):
            coded += 1
            continue
        kept.append(bare)
    return "" if coded * 2 > total else " ".join(kept)


def docstring(quoted: str) -> str:
    inner = regex.sub(r"^[rRuUbB]?(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')$", "", quoted)
    return described(regex.sub(r"(?m)^([ \t]*)[#*/](?=\s)", r"\1", inner))


def enough(text: str, least: int = LEAST_WORDS) -> bool:
    if regex.match(r"(?i)\s*(?:todo|fixme|xxx|hack|see above|tbd)\b[\s:.]*(?:\S+\s*){0,4}$", text):
        return False
    return len(WORD.findall(text)) >= least


def pairs(text: str, kind: str) -> Iterator[tuple[str, str, str, int]]:
    """(symbol, documentation, code, line) of each documented function."""
    yield from _python(text) if kind == "python" else _braced(text, kind)


JAVA_WORDS = frozenset("public private protected internal static final abstract synchronized native default strictfp".split())
#: Where a run of comments ends and something else follows; the recursive patterns decide whether it is a declaration.
CANDIDATE = {
    k: re.compile(r"(?m)^[ \t]*(?:(?:[^\n]*\*/|//[^\n]*" + (r"|#(?!\[)[^\n]*" if k == "php" else "") + r")[ \t\r]*\n[ \t]*(?![ \t\r\n}]|//|/\*" + (r"|#(?!\[)" if k == "php" else "") + r")|/\*[^\n]*?\*/[ \t]*(?=[^\s/}]))")
    for k in BRACED
}
NO_BODY = re.compile(r"\s*+;")
TYPE_HEAD = {
    "script": re.compile(r"\b(class|interface|enum|namespace)\s+([A-Za-z_$][\w$]*)(?=[^{};()]*\{)"),
    "java": re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)(?=[^{};]*\{)"),
    "php": re.compile(r"\b(class|interface|trait|enum)\s+(\w+)(?=[^{};()]*\{)"),
    "go": re.compile(r"(?!)()()"),
}
LONG_STRING = {"script": "`", "java": '\"\"\"', "php": "<<<", "go": "`"}
LEXER = {
    "script": re.compile(r"/\*.*?\*/|//[^\n]*|" + STRINGS + "|" + TEMPLATE, re.S),
    "java": re.compile(r'/\*.*?\*/|//[^\n]*|"""(?:[^"\\]++|\\.|"(?!""))*+"""|' + STRINGS, re.S),
    "php": re.compile(r"/\*.*?\*/|//[^\n]*|#(?!\[)[^\n]*|" + STRINGS + r"|<<<[ \t]*['\"]?(\w+).*?\n\s*\1\b", re.S),
    "go": re.compile(r"/\*.*?\*/|//[^\n]*|" + STRINGS + "|" + TEMPLATE, re.S),
    "python": re.compile(r"#[^\n]*|[rRbBuUfF]{0,2}(?:" + PY_STRINGS.replace("[rRbBuUfF]{0,2}", "") + ")", re.S),
}


def protected(text: str, kind: str) -> list[tuple[int, int]]:
    """Spans of the strings that go over lines."""
    return [m.span() for m in LEXER[kind].finditer(text) if m[0][0] not in "/#" and "\n" in m[0]]


def inside(spans: list[tuple[int, int]], at: int) -> bool:
    i = bisect_right(spans, (at, 1 << 60)) - 1
    return i >= 0 and spans[i][0] < at < spans[i][1]


def run_start(text: str, end: int, marks: tuple[str, ...]) -> int:
    """Where the run of comments begins whose last line ends at `end`."""
    start = end
    while True:
        line = text.rfind("\n", 0, max(0, start - 1)) + 1 if start else 0
        row = text[line:start].strip()
        if row.endswith("*/"):
            opened = text.rfind("/*", 0, start)
            if opened < 0:
                return start
            first = text.rfind("\n", 0, opened) + 1
            if text[first:opened].strip():
                return opened
            start = first
        elif row.startswith(marks) and not row.startswith("#["):
            start = line
        else:
            return start
        if start == 0:
            return 0


def _braced(text: str, kind: str) -> Iterator[tuple[str, str, str, int]]:
    spans = types = None
    done = -1
    for c in CANDIDATE[kind].finditer(text):
        stop = text.find("\n", c.start())
        stop = c.end() if stop < 0 or stop > c.end() else stop
        begin = run_start(text, stop, ("//", "#") if kind == "php" else ("//",))
        begin += len(text[begin:stop]) - len(text[begin:stop].lstrip())
        if begin <= done or len(WORD.findall(text, begin, c.end())) < LEAST_WORDS:
            continue
        m = BRACED[kind].match(text, begin)
        if not m:
            continue
        if spans is None:
            spans = protected(text, kind) if LONG_STRING[kind] in text else []
            types = []
            for t in TYPE_HEAD[kind].finditer(text):
                if not inside(spans, t.start()):
                    whole = BODY_AT[kind].match(text, t.end())
                    types.append((t.start(), whole.end() if whole else len(text), t[2], t[1]))
        if inside(spans, begin):
            continue
        which = next((s for s in ("", "2", "3", "4") if f"sig{s}" in m.groupdict() and m[f"sig{s}"] is not None), None)
        if which is None:
            continue
        name, sig = m[f"name{which}"], m[f"sig{which}"]
        body = next((x for x in (m["value"], m["whole"]) if x is not None), None)
        if body is None:
            body = ";" if NO_BODY.match(text, m.end()) else ""
        at = m.start(f"sig{which}")
        done = begin
        owner = next((t for t in reversed(types) if t[0] < at < t[1]), None)
        if kind == "script":
            if which in ("3", "4"):
                if owner is None or owner[3] in ("enum", "namespace"):
                    continue
                if body == ";" and owner[3] != "interface" and not regex.match(r"(?:\w+\s+)*abstract\b", sig):
                    continue
            else:
                owner = None
        elif kind == "java":
            if body == ";" and not (owner and owner[3] == "interface" or regex.search(r"\b(?:abstract|native)\b", sig)):
                continue
            before = [w for w in regex.sub(r"@[\w.]++(?:\([^)]*\))?", " ", sig[: m.start("name") - at]).split() if w not in JAVA_WORDS]
            if not before and not (owner and owner[2] == name) and not sig.startswith(("public", "private", "protected")):
                continue
        doc = described(m["doc"])
        if enough(doc):
            symbol = f"{m['recv']}.{name}" if kind == "go" and m["recv"] else f"{owner[2]}.{name}" if owner and kind != "go" else name
            yield symbol, doc, sig + " " + (body if body != ";" else ""), text.count("\n", 0, at) + 1


PY_HEAD = re.compile(r"(?m)^([ \t]*)(?:(?:async[ \t]+)?def\b|class[ \t]+(\w+))")


def _python(text: str) -> Iterator[tuple[str, str, str, int]]:
    scopes: list[tuple[int, str | None]] = []  # indentation and class, or None for a function
    spans = protected(text, "python") if "\"\"\"" in text or "'''" in text else []
    for h in PY_HEAD.finditer(text):
        if inside(spans, h.start()):
            continue
        indent = len(h[1].expandtabs(8))
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        if h[2]:
            scopes.append((indent, h[2]))
            continue
        owner = scopes[-1][1] if scopes else None
        scopes.append((indent, None))
        above = h.start()
        while above:  # decorators, which may go over lines, and comments
            line = text.rfind("\n", 0, above - 1) + 1
            row = text[line:above].strip()
            if row.startswith(("@", "#")) and not inside(spans, line):
                above = line
            elif row.endswith((")", ",")) and (d := text.rfind("\n" + h[1] + "@", 0, above)) >= 0 and "\n\n" not in text[d:above] and "def " not in text[d:above]:
                above = d + 1
            else:
                break
        m = PYTHON.match(text, above)
        if not m or m["sig"] is None or m.start("sig") > h.end():
            m = PYTHON.match(text, h.start())
            if not m:
                continue
        doc = docstring(m["quoted"]) if m["quoted"] else ""
        if not enough(doc) and m["doc"]:
            doc = described(m["doc"])
        if enough(doc):
            rest = regex.compile(r"(?:[^\n]*\n?)(?:[ \t]*\r?\n|[ \t]{%d,}[^\n]*\n?)*+" % (indent + 1)).match(text, m.end("sig"))
            yield (f"{owner}.{m['name']}" if owner else m["name"]), doc, m["sig"] + (rest[0] if rest else ""), text.count("\n", 0, m.start("sig")) + 1


def language_of(path: str | None, language: str | None) -> str | None:
    ending = (path or "").rpartition(".")[2].lower()
    if ending not in LANGUAGES:
        ending = BY_NAME.get((language or "").lower(), "") if "." not in (path or "").rpartition("/")[2] else ""
    return LANGUAGES.get(ending)


def captures(points: DataFrame) -> DataFrame:
    """The rows of `documented_functions`, once for each stored row of a point."""
    code = points.select("point_id", "file_path", "language", "symbol_type", "content").where(F.col("content").isNotNull() & ~F.coalesce(F.col("symbol_type") == "heading", F.lit(False)))

    def make():
        def read(point_id, file_path, language, _, content):
            kind = language_of(file_path, language)
            if kind is None:
                return
            for pair in pairs(content, kind):
                yield point_id, *pair

        return read

    return map_rows(code, make, "point_id string, symbol string, documentation string, code string, line int")


def documented_functions(points: DataFrame) -> DataFrame:
    """point_id, symbol, documentation, code, line INT: each function or method with documentation of at least six words.

    The language is that of the file's extension, or of the column where there is none; other languages have no rows.
    Overloads have a row each. Rows that repeat a point_id are one point. Null and empty contents have no rows; an empty table gives an empty result; other columns are ignored.
    """
    return captures(points).dropDuplicates(["point_id", "symbol", "line"])


def documented_symbols(points: DataFrame) -> DataFrame:
    """(point_id, symbol), once each."""
    return captures(points).select("point_id", "symbol").distinct()
