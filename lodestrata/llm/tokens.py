"""Problem 7: exact encoding of a corpus with a public byte-level BPE, in parallel within a text too.

Short texts are encoded whole. A longer text is cut into leaves that are encoded in parallel tasks and concatenated
as a tree: at each join the text around it is split and encoded again in windows that grow until both sides agree.

Why the result is exact. (1) Splitting is memoryless: from a boundary on, it depends only on what follows. A piece of
the left side is final as soon as neither its end nor the characters its match looked at touch the join, and once a
re-split boundary falls on a boundary of the right side, the rest of the right side is final. (2) Within one piece, a
token sequence is the encoding if and only if each adjacent pair is the encoding of its own bytes, so only tokens
around a join need checking.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern of this vocabulary, with possessive repeats, which match the same pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters only.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]++| ?[0-9]++| ?[^\sA-Za-z0-9]++|\s+(?!\S)|\s+"
LEAF_CHARS = 4096
UNSPLIT_BYTES = 512
CACHE_PIECES = 400_000


class Encoder:
    """Encodes texts, and concatenates encodings. `ids` of a text never holds special tokens."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(PATTERN).finditer
        self.ascii_pieces = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """A whole text; ASCII texts go through a cache of pieces, which is quicker than the merges."""
        if not text.isascii():
            return self.core.encode_ordinary(text)
        cache, out = self.cache, []
        for piece in self.ascii_pieces(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece.encode())
                if len(cache) < CACHE_PIECES and len(piece) < 64:
                    cache[piece] = ids
            out += ids
        return out

    def piece(self, data: bytes) -> list[int]:
        """One unsplit piece: a long one by halves and a join, so that its cost stays near linear."""
        if len(data) <= UNSPLIT_BYTES:
            return self.core.encode_single_piece(data)
        half = len(data) // 2
        return self.join_tokens(self.piece(data[:half]), self.piece(data[half:]))

    def fits(self, a: int, b: int) -> bool:
        return self.core.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Concatenate two encodings of parts of one piece by re-encoding growing windows around the join."""
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.core.encode_single_piece(b"".join(self.bytes_of[t] for t in [*left[i:], *right[:j]]))
            if (i == 0 or self.fits(left[i - 1], window[0])) and (j == len(right) or self.fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def leaf(self, text: str) -> Segment:
        starts, counts, ids = [], [], []
        for m in self.pieces(text):
            tokens = self.piece(m.group().encode())
            starts.append(m.start())
            counts.append(len(tokens))
            ids.append(tokens)
        return Segment(text, starts, counts, [t for x in ids for t in x])

    def join(self, a: Segment, b: Segment) -> Segment:
        """Concatenate two segments of one text."""
        if not a.text or not b.text:
            return a if a.text else b
        cut = len(a.text)
        ends = [*a.starts[1:], cut]
        keep = len(a.starts)
        while keep and (ends[keep - 1] >= cut or a.starts[keep - 1] + 3 > cut):
            keep -= 1
        keep = min(keep, len(a.starts) - 1)
        at = a.starts[keep]
        kept = sum(a.counts[:keep])
        tail = a.text[at:]
        known = {s: i for i, s in enumerate(b.starts)}
        reach = 64
        while True:
            whole = reach >= len(b.text)
            window = tail + (b.text if whole else b.text[:reach])
            spans, met = [], None
            for m in self.pieces(window):
                if not whole and (m.end() >= len(window) or m.start() + 3 > len(window)):
                    break
                spans.append(m.span())
                if m.end() >= len(tail) and m.end() - len(tail) in known:
                    met = known[m.end() - len(tail)]
                    break
            if met is not None or whole:
                break
            reach *= 4
        if met is None:
            met = len(b.starts)
        starts, counts, ids = a.starts[:keep], a.counts[:keep], a.ids[:kept]
        for s, e in spans:
            if s == 0 and keep == len(a.starts) - 1 and met == 1 and len(spans) == 1:
                tokens = self.join_tokens(a.ids[kept:], b.ids[: b.counts[0]])  # one piece across the join
            else:
                tokens = self.piece(window[s:e].encode())
            starts.append(at + s)
            counts.append(len(tokens))
            ids += tokens
        skip = sum(b.counts[:met])
        return Segment(a.text + b.text, starts + [s + cut for s in b.starts[met:]], counts + b.counts[met:], ids + b.ids[skip:])

    def concatenate(self, parts: list[Segment]) -> Segment:
        """Pairwise, as a balanced tree, so that each character is copied a logarithmic number of times."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else Segment("", [], [], [])


class Segment:
    """A stretch of a text with the starts of its pieces, tokens per piece, and ids."""

    __slots__ = ("text", "starts", "counts", "ids")

    def __init__(self, text: str, starts: list[int], counts: list[int], ids: list[int]):
        self.text, self.starts, self.counts, self.ids = text, starts, counts, ids


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    flat = np.fromiter((i for x in rows for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, ids ARRAY<INT>): one row for each row of `df`, repeated ids included.

    Null and empty texts give an empty list. Texts up to `leaf_chars` are encoded where they are read, without a
    shuffle; only leaves of longer ones are exchanged. A group of that exchange is one text, so its size is that of
    one row. Other columns of `df` are ignored. An empty table gives an empty result.
    """
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = dict(df.dtypes)[id_col]
    ddl = f"id {kind}, ids array<int>"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            ids = lists([own.encode(t) if t else [] for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(2).to_pylist()):
                parts = [t[k : k + leaf_chars] for k in range(0, len(t), leaf_chars)]
                for lo in range(0, len(parts), 1024):
                    some = parts[lo : lo + 1024]
                    at = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(range(lo, lo + len(some)), pa.int32()), pa.array(some)], names=["row", "id", "leaf", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            done = [own.leaf(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, lists([x.starts for x in done]), lists([x.counts for x in done]), lists([x.ids for x in done])], names=["row", "id", "leaf", "text", "starts", "counts", "ids"])

    def tree(group: pa.Table) -> pa.Table:
        own = encoder(vocabulary)
        group = group.sort_by("leaf")
        parts = [Segment(*x) for x in zip(*(group.column(c).to_pylist() for c in ("text", "starts", "counts", "ids")))]
        return pa.table({"id": group.column("id").slice(0, 1), "ids": lists([own.concatenate(parts).ids])})

    is_long = F.length("text") > leaf_chars
    here = rows.where(~is_long | F.col("text").isNull()).mapInArrow(short, ddl)
    pieces = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(cut, f"row bigint, id {kind}, leaf int, text string")
    pieces = pieces.repartition(F.col("row"), F.col("leaf")).mapInArrow(leaves, f"row bigint, id {kind}, leaf int, text string, starts array<int>, counts array<int>, ids array<int>")
    return here.unionByName(pieces.groupBy("row").applyInArrow(tree, ddl)).withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, columns: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`columns` of each row and `tokens` BIGINT, the size of its text; null and empty texts have 0."""
    kinds = dict(df.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            n = [len(own.encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*columns, "tokens"])

    return spread(df.select(*columns, F.col(text_col).alias("__text"))).mapInArrow(run, ddl)
