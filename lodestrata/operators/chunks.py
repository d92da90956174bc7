"""Chunking that Catalyst can express: whole files, greedy line packing, Markdown sections and their merge.

Input everywhere: project_id, file_path, language, module, text. Output: chunk columns with ids and hashes. Nulls in
text have no chunks; an empty text is one empty chunk. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import MAX_TOKENS, MIN_TOKENS, chunk_id, content_hash, index_tokens
from lodestrata.functions.paths import base_name, extension

CHUNK_COLUMNS = ["chunk_id", "project_id", "file_path", "language", "module", "symbol", "symbol_type", "start_line", "end_line", "token_count", "content", "content_hash"]


Limit = int | Column  # one limit for all files or a column of theirs


def finish(df: DataFrame, id_symbol: Column | None = None) -> DataFrame:
    """Add hash, token estimate and id to rows with content, symbol and lines."""
    df = df.withColumn("content_hash", content_hash("content")).withColumn("token_count", index_tokens("content"))
    df = df.withColumn("chunk_id", chunk_id("project_id", "file_path", F.col("symbol") if id_symbol is None else id_symbol, "content_hash"))
    return df.select(*(F.col(c).cast("int") if c.endswith("_line") else F.col(c) for c in CHUNK_COLUMNS))


def strategy(path: Column | str = "file_path") -> Column:
    """Which chunker a file gets by its extension."""
    e = extension(path)
    return F.when(e == ".go", "go").when(e.isin(".ts", ".tsx", ".js", ".jsx", ".vue"), "typescript").when(e == ".php", "php").when(e.isin(".md", ".markdown"), "markdown").otherwise("fixed")


def whole_files(files: DataFrame, max_tokens: Limit = MAX_TOKENS) -> DataFrame:
    """Files within the limit: one chunk of type `file`, named after the file."""
    rows = files.where(F.col("text").isNotNull() & (index_tokens("text") <= max_tokens))
    last = F.size(F.split("text", "\n"))
    return finish(rows.withColumns({"symbol": base_name("file_path"), "symbol_type": F.lit("file"), "start_line": F.lit(1), "end_line": last, "content": F.col("text")}))


def line_starts(lines: Column, max_tokens: Limit) -> Column:
    """Lines at which greedy packing begins a fragment. The state is the starts so far and the tokens since the last."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("n"), index_tokens(x).alias("t")))
    first = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("t"))

    def step(a: Column, x: Column) -> Column:
        over = (a["t"] + x["t"] > max_tokens) & (x["n"] > 1)
        return F.struct(F.when(over, F.concat(a["starts"], F.array(x["n"]))).otherwise(a["starts"]).alias("starts"), F.when(over, x["t"]).otherwise(a["t"] + x["t"]).cast("int").alias("t"))

    return F.aggregate(numbered, first, step)["starts"]


def fragments(files: DataFrame, max_tokens: Limit = MAX_TOKENS) -> DataFrame:
    """Files above the limit, packed line by line; a line of its own size above the limit stays one fragment."""
    rows = files.where(index_tokens("text") > max_tokens).withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("starts", line_starts(F.col("lines"), max_tokens))
    rows = rows.select("*", F.posexplode("starts").alias("nth", "start_line"))
    rows = rows.withColumn("end_line", F.when(F.col("nth") + 1 < F.size("starts"), F.element_at("starts", F.col("nth") + 2) - 1).otherwise(F.size("lines")))
    rows = rows.withColumn("content", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    base = base_name("file_path")
    later = F.replace(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit("."), F.lit("_"))
    return finish(rows.withColumns({"symbol": F.when(F.col("start_line") > 1, later).otherwise(base), "symbol_type": F.lit("fragment")}))


def fixed(files: DataFrame, max_tokens: Limit = MAX_TOKENS) -> DataFrame:
    return whole_files(files, max_tokens).unionByName(fragments(files, max_tokens))


HEADING = r"(?d)^(#{1,6})[\t\f\r ]+([^\n]+)"


def _sections(files: DataFrame) -> DataFrame:
    """files with `parts`, the text of each section, and `counts`, their numbers of lines.

    One split before each heading does it; text before the first heading is a section of its own. Nothing is looked up
    in the arrays from within a lambda, because Catalyst would put the whole split in its place.
    """
    rows = files.where(F.col("text").isNotNull()).withColumn("parts", F.split("text", r"\n(?=#{1,6}[\t\f\r ][^\n])"))
    return rows.withColumn("counts", F.transform("parts", lambda p: F.size(F.split(p, "\n"))))


def _lines_before(nth: Column) -> Column:
    return F.aggregate(F.slice("counts", F.lit(1), nth), F.lit(0), lambda a, x: a + x)


def _name(part: Column) -> Column:
    return F.when(part.rlike(HEADING), F.regexp_extract(part, HEADING, 2)).otherwise(F.lit("(intro)"))


def _as_markdown(rows: DataFrame) -> DataFrame:
    return finish(rows.withColumns({"symbol_type": F.lit("heading"), "language": F.lit("markdown")}))


def markdown_sections(files: DataFrame) -> DataFrame:
    """One chunk per heading; fences are not looked at, so a `# x` in a code block opens a section too."""
    rows = _sections(files).select("project_id", "file_path", "module", "counts", F.posexplode_outer("parts").alias("nth", "content"))
    start = _lines_before(F.col("nth")) + 1
    return _as_markdown(rows.select("project_id", "file_path", "module", _name(F.col("content")).alias("symbol"), start.alias("start_line"), (start + F.get("counts", F.col("nth")) - 1).alias("end_line"), "content"))


def markdown_merged(files: DataFrame, min_tokens: Limit = MIN_TOKENS) -> DataFrame:
    """Sections below the minimum join the chunk before, or the next one if there is none yet.

    A merged chunk is a run of sections joined by blank lines. The fold over byte counts finds the runs, each with the
    section that names it; their text is built once afterwards.
    """
    rows = _sections(files)
    sizes = F.transform("parts", F.octet_length)
    start = F.struct(
        F.array().cast("array<struct<s:int,e:int,a:int>>").alias("runs"),
        F.lit(0).alias("bytes"),  # of the last run
        F.lit(-1).alias("held"),  # first section that waits for the next one
        F.lit(0).alias("held_bytes"),
        F.lit(0).alias("i"),
        F.size("parts").alias("n"),
    )

    def run(s: Column, e: Column, a: Column) -> Column:
        return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), a.cast("int").alias("a"))

    def step(acc: Column, size: Column) -> Column:
        i, runs = acc["i"], acc["runs"]
        waiting = acc["held"] >= 0
        own = F.when(waiting, acc["held_bytes"] + 2 + size).otherwise(size)
        first = F.when(waiting, acc["held"]).otherwise(i)
        small = F.floor(own / 4) < min_tokens
        has_run = F.size(runs) > 0
        joins = small & has_run
        waits = small & ~has_run & (i < acc["n"] - 1)
        last = F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(run(last["s"], i, last["a"])))
        return F.struct(
            F.when(joins, grown).when(waits, runs).otherwise(F.concat(runs, F.array(run(first, i, i)))).alias("runs"),
            F.when(joins, acc["bytes"] + 2 + own).when(waits, acc["bytes"]).otherwise(own).cast("int").alias("bytes"),
            F.when(waits, first).otherwise(F.lit(-1)).cast("int").alias("held"),
            F.when(waits, own).otherwise(F.lit(0)).cast("int").alias("held_bytes"),
            (i + 1).cast("int").alias("i"),
            acc["n"].alias("n"),
        )

    rows = rows.withColumn("runs", F.aggregate(sizes, start, step)["runs"]).select("project_id", "file_path", "module", "parts", "counts", F.explode_outer("runs").alias("r"))
    rows = rows.select(
        "project_id", "file_path", "module",
        _name(F.get("parts", F.col("r.a"))).alias("symbol"),
        (_lines_before(F.col("r.s")) + 1).alias("start_line"),
        _lines_before(F.col("r.e") + 1).alias("end_line"),
        F.array_join(F.slice("parts", F.col("r.s") + 1, F.col("r.e") - F.col("r.s") + 1), "\n\n").alias("content"),
    )
    return _as_markdown(rows)
