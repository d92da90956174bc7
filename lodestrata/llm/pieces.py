"""Problem 4: cutting oversized items at natural boundaries by packing a structure tree.

The content is read as a tree: headings and their sections, blank-line separated blocks, statements with their
indented bodies or list items with their continuation, lines, sentences, words, characters. A node above the limit is
descended into, level by level; siblings are merged again from the bottom up as long as they fit. Nodes that fit are
never opened, so the cost is linear in the text for each level that is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrow import map_rows

LIMIT = 2048
Span = tuple[int, int]


def tokens_of(n_bytes: int) -> int:
    """The estimate of the oversized report: 2.5 bytes of UTF-8 a token, rounded down."""
    return n_bytes * 2 // 5


# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<end>/)?(?P<name>[A-Za-z][\w:.-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?(?P<alone>/)?>", re.S)


class Packer:
    """Cuts one text; positions are characters, sizes are bytes of UTF-8."""

    def __init__(self, text: str, cap: int, markdown: bool):
        self.text, self.cap, self.markdown = text, cap, markdown
        self.ascii = text.isascii()
        self.marked = text.lstrip("\ufeff \t\r\n")[:1] == "<" and not text.lstrip("\ufeff \t\r\n").startswith("<?php")

    def size(self, s: int, e: int) -> int:
        return e - s if self.ascii else len(self.text[s:e].encode("utf-8", "surrogatepass"))

    def pack(self, s: int, e: int, level: int = 0) -> list[Span]:
        if s >= e:
            return []
        if self.size(s, e) <= self.cap:
            return [(s, e)]
        while level < len(self.LEVELS):
            parts = self.LEVELS[level](self, s, e)
            level += 1
            if len(parts) > 1:
                break
        else:
            return self.characters(s, e)
        out: list[list] = []  # start, end, whether it is whole siblings
        for a, b in parts:
            below = self.pack(a, b, level)
            for x, y in below:
                whole = len(below) == 1
                # whole siblings merge; the rest of an opened node joins the next sibling only if it is short
                if out and self.size(out[-1][0], y) <= self.cap and (whole and out[-1][2] or self.size(*out[-1][:2]) * 3 < self.cap or self.size(x, y) * 3 < self.cap):
                    out[-1][1] = y
                    out[-1][2] = out[-1][2] and whole
                else:
                    out.append([x, y, whole])
        return [(x, y) for x, y, _ in out]

    def cut(self, s: int, e: int, starts: Iterator[int]) -> list[Span]:
        at = [s, *(x for x in starts if s < x < e), e]
        return list(zip(at, at[1:]))

    def sections(self, s: int, e: int) -> list[Span]:
        """Markdown headings of the highest level within the span, outside fences; a section has its subsections."""
        if not self.markdown:
            return [(s, e)]
        heads, fence, at = [], None, s
        for line in self.text[s:e].splitlines(keepends=True):
            mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
            if mark:
                fence = None if fence and mark[1].startswith(fence) else fence or mark[1][:3]
            elif fence is None and (m := re.match(r"(#{1,6})\s", line)):
                heads.append((at, len(m[1])))
            at += len(line)
        inner = [h for h in heads if h[0] > s]
        if not inner:
            return [(s, e)]
        top = min(d for _, d in inner)
        return self.cut(s, e, (p for p, d in inner if d == top))

    def elements(self, s: int, e: int) -> list[Span]:
        """Elements of markup at the least depth at which one begins within the span; an element has what is in it."""
        if not self.marked:
            return [(s, e)]
        open_: list[str] = []
        starts: list[tuple[int, int]] = []
        for m in TAG.finditer(self.text, s, e):
            name = (m["name"] or "").lower()
            if not name:  # a comment, a declaration or the text of a script
                continue
            if m["end"]:
                if name in open_:
                    while open_.pop() != name:
                        pass
                continue
            starts.append((m.start(), len(open_)))
            if not m["alone"] and name not in VOID:
                open_.append(name)
        inner = [x for x in starts if x[0] > s]
        least = min((d for _, d in inner), default=0)
        return self.cut(s, e, (p for p, d in inner if d == least))

    def blocks(self, s: int, e: int) -> list[Span]:
        """Runs separated by blank lines, at the least indentation that such runs have; fences stay whole."""
        starts, at, blank, fence = [], s, False, None
        for line in self.text[s:e].splitlines(keepends=True):
            bare = line.strip()
            if bare and blank and fence is None:
                starts.append((at, len(line) - len(line.lstrip())))
            if self.markdown and bare[:3] in ("```", "~~~"):
                fence = None if fence else bare[:3]
            blank = not bare
            at += len(line)
        if not starts:
            return [(s, e)]
        least = min(i for _, i in starts)
        return self.cut(s, e, (p for p, i in starts if i == least))

    def indented(self, s: int, e: int) -> list[Span]:
        """Statements or list items with what is indented below them, and closing brackets with what they close."""
        lines, at = [], s
        for line in self.text[s:e].splitlines(keepends=True):
            bare = line.strip()
            if bare and not re.match(r"[)\]}]|end\b|</", bare):
                lines.append((at, len(line) - len(line.lstrip())))
            at += len(line)
        depths = sorted({i for p, i in lines if p > s})
        for depth in depths[:4]:
            parts = self.cut(s, e, (p for p, i in lines if i <= depth))
            if len(parts) > 1:
                return parts
        return [(s, e)]

    def lines(self, s: int, e: int) -> list[Span]:
        return self.cut(s, e, (m.end() for m in re.compile(r"\n|\r(?!\n)").finditer(self.text, s, e)))

    def sentences(self, s: int, e: int) -> list[Span]:
        return self.cut(s, e, (m.end() for m in re.compile(r"[.!?…。！？;]+[\"')\]]*\s+|[。！？;{}]|</[^>]{1,80}>").finditer(self.text, s, e)))

    def words(self, s: int, e: int) -> list[Span]:
        return self.cut(s, e, (m.end() for m in re.compile(r"\s+|,").finditer(self.text, s, e)))

    def characters(self, s: int, e: int) -> list[Span]:
        out = []
        while s < e:
            step = min(self.cap if self.ascii else max(1, self.cap // 4), e - s)
            if not self.ascii:  # as many characters as fit
                while s + step < e and self.size(s, s + step + max(1, step // 8)) <= self.cap:
                    step += max(1, step // 8)
                step = min(step, e - s)
            out.append((s, s + step))
            s += step
        return out

    LEVELS = (sections, sections, sections, elements, elements, elements, elements, blocks, blocks, indented, indented, indented, lines, sentences, words)


def split(text: str, limit: int, overlap: int, markdown: bool) -> list[tuple[int, int, int]]:
    """(start, body, end) in characters: piece text[start:end], of which text[start:body] repeats the piece before."""
    most = max(5, (limit * 5 - 1) // 2)  # largest number of bytes that is estimated below `limit`
    while tokens_of(most) >= limit and most > 5:
        most -= 1
    again = min(-(-max(0, overlap) * 5 // 2), most // 2)
    spans = Packer(text, max(4, most - again - (3 if again else 0)), markdown).pack(0, len(text))
    out = []
    for n, (s, e) in enumerate(spans):
        at = s
        if n and again:
            room, at = again, max(0, s - again)
            if not text.isascii():
                at = s
                while at > 0 and room > 0:
                    at -= 1
                    room -= len(text[at].encode("utf-8", "surrogatepass"))
        out.append((at, s, e))
    return out


def oversized_pieces(points: DataFrame, reports: DataFrame, config: DataFrame, limit: int = LIMIT) -> DataFrame:
    """point_id, project_id, file_path, piece INT, start_line, end_line INT, token_count INT, overlap_tokens INT, source_tokens INT, content.

    Points whose content has more estimated tokens than max_allowed of a report of the same project, path and symbol,
    or than `limit` where no report names one, whether or not they are reported; unfounded reports have no effect.
    Each piece has fewer tokens than the limit, except where one character alone is larger. Consecutive pieces overlap
    by the project's overlap_tokens, at whole characters and at most half a piece; null or unknown projects have none.
    Without the overlaps, the pieces of a point joined in order are its content. Lines count from the start_line of
    the point (1 if null). Rows that repeat a point_id are one point, of which the latest row counts. Null contents
    have no pieces; an empty table gives an empty result; other columns are ignored.
    """
    size = F.octet_length("content")
    told = reports.where(F.col("max_allowed") > 0).groupBy("project_id", "file_path", "symbol").agg(F.min("max_allowed").alias("allowed"))
    least = told.agg(F.min("allowed")).first()[0]
    least = min(limit, least) if least else limit
    big = points.select("point_id", "project_id", "file_path", "symbol", "language", "start_line", "content", "indexed_at").where(F.floor(size * 2 / 5) > least)
    same = (big.project_id.eqNullSafe(told.project_id)) & (big.file_path.eqNullSafe(told.file_path)) & (big.symbol.eqNullSafe(told.symbol))
    big = big.join(told, same, "left").select(*(big[c] for c in big.columns), "allowed").withColumn("allowed", F.coalesce("allowed", F.lit(limit))).where(F.floor(size * 2 / 5) > F.col("allowed"))
    big = big.groupBy("point_id").agg(F.max_by(F.struct("project_id", "file_path", "language", "start_line", "content", "allowed"), F.struct("indexed_at", "start_line")).alias("r")).select("point_id", "r.*")
    overlaps = config.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(F.max(F.coalesce("overlap_tokens", F.lit(0))).alias("overlap"))
    big = big.join(overlaps, "project_id", "left")

    def make():
        def cut(point_id, project_id, file_path, language, start_line, content, allowed, overlap):
            markdown = (language or "").lower() == "markdown" or (file_path or "").lower().endswith((".md", ".markdown"))
            first = 1 if start_line is None else start_line
            line, at, whole = first, 0, tokens_of(len(content.encode("utf-8", "surrogatepass")))
            for n, (s, body, e) in enumerate(split(content, allowed, overlap or 0, markdown)):
                line += content.count("\n", at, s) if s >= at else -content.count("\n", s, at)
                at = s
                text = content[s:e]
                last = line + text.count("\n") - (1 if text.endswith("\n") and len(text) > 1 else 0)
                bytes_ = len(text.encode("utf-8", "surrogatepass"))
                again = tokens_of(len(content[s:body].encode("utf-8", "surrogatepass")))
                yield point_id, project_id, file_path, n + 1, line, last, tokens_of(bytes_), again, whole, text

        return cut

    ddl = "point_id string, project_id string, file_path string, piece int, start_line int, end_line int, token_count int, overlap_tokens int, source_tokens int, content string"
    return map_rows(big.select("point_id", "project_id", "file_path", "language", "start_line", "content", "allowed", "overlap"), make, ddl, flush=256)


def oversized_points(points: DataFrame, reports: DataFrame, config: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(point_id): points of `oversized_pieces` above `limit` itself; one row for each."""
    return oversized_pieces(points, reports, config, limit).where(F.col("source_tokens") > limit).select("point_id").distinct()
