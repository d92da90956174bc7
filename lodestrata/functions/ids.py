"""Identity columns: hashes, chunk and point ids, token estimates. All are bit-exact formats of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chunk limits where a project sets none, and the limit of the oversized report.
MIN_TOKENS, IDEAL_TOKENS, MAX_TOKENS = 200, 500, 800
OVERSIZED_TOKENS = 2048


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(content: Column | str) -> Column:
    return F.sha2(_c(content), 256)


def chunk_id(project: Column | str, path: Column | str, symbol: Column | str, hashed: Column | str) -> Column:
    """project:path:symbol:first eight digits of the hash; an empty symbol is `_`, colons in it become `_`."""
    name = F.replace(F.when(F.coalesce(_c(symbol), F.lit("")) == "", F.lit("_")).otherwise(_c(symbol)), F.lit(":"), F.lit("_"))
    return F.concat_ws(":", _c(project), _c(path), name, F.substring(_c(hashed), 1, 8))


def point_id(chunk: Column | str) -> Column:
    """The first 16 bytes of the SHA-256 of a chunk id, written in the shape 8-4-4-4-12."""
    h = F.sha2(_c(chunk), 256)
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def index_tokens(content: Column | str) -> Column:
    """Bytes over four, rounded down: the estimate used for cutting."""
    return F.floor(F.octet_length(_c(content)) / 4).cast("int")


def report_tokens(content: Column | str) -> Column:
    """Bytes over two and a half, rounded down: the estimate used by the oversized report."""
    return F.floor(F.octet_length(_c(content)) * 2 / 5).cast("int")


def override(value: Column | str, default: int) -> Column:
    """A project's setting; null, zero and below mean unset."""
    return F.when(_c(value) > 0, _c(value)).otherwise(F.lit(default)).cast("int")


def clamp_top_k(k: Column | str) -> Column:
    """Five where unset or not positive, twenty at most."""
    return F.least(F.lit(20), F.when(F.coalesce(_c(k), F.lit(0)) <= 0, F.lit(5)).otherwise(_c(k))).cast("int")
