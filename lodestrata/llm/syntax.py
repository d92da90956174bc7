"""Problem 6: source files that do not parse, by packrat parsing-expression grammars.

A file is valid if the grammar of its extension consumes all of it. For one that isn't, the furthest position at which
the parser failed gives the line, and the text around it the cause.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.paths import normal_path
from lodestrata.llm.arrow import map_rows
from lodestrata.llm.grammars import SOURCES

DEPTH = 30_000  # calls of rules; brackets that nest deeper than a few are parsed from the inside out
CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$")


@lru_cache(maxsize=None)
def grammar(language: str):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
    lex, make = SOURCES[language]
    return lex, make().parse


def furthest_failure(text: str, language: str) -> int | None:
    """The furthest place at which the text fails to be of the language; None if all of it is consumed."""
    lex, parse = grammar(language)
    codes, places, wrong = lex(text)
    if wrong is not None:
        return wrong
    end, far = parse(codes)
    return None if end >= 0 else places[min(far, len(places) - 1)]


def judge(text: str, language: str) -> tuple[bool, int | None, str | None]:
    """(valid, line of the furthest failure, cause)."""
    at = furthest_failure(text, language)
    if at is None:
        return True, None, None
    line = text.count("\n", 0, at) + 1
    if CONFLICT.search(text):
        cause = "merge conflict"
    elif not text[at:].strip() or at > 0 and text.find("\n", at) < 0 and len(text) - at < 200:
        cause = "truncated"
    elif text.lstrip("﻿ \r\n\t")[:1] == "<" and language != "php" or any(furthest_failure(text, x) is None for x in SOURCES if x not in (language, "php") and (x, language) != ("ts", "js")) or language != "php" and text.lstrip().startswith("<?php"):
        cause = "wrong extension"
    else:
        cause = "syntax error"
    return False, line, cause


def judge_files(points: DataFrame) -> DataFrame:
    """point_id, project_id, file_path, language, valid BOOLEAN, line INT, cause of each judged file.

    Judged are points of symbol_type `file` with a content whose extension is, in any letter case, one of the grammars';
    `language` is that extension. An empty text is valid, except for JSON. A byte order mark alone is no error. Rows that
    repeat a point_id are one point. An empty table gives an empty result; other columns are ignored.
    """
    ending = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    files = points.where((F.col("symbol_type") == "file") & F.col("content").isNotNull()).select("point_id", "project_id", normal_path("file_path").alias("file_path"), ending.alias("language"), "content")
    files = files.where(F.col("language").isin(*SOURCES))

    def make():
        def run(point_id, project_id, file_path, language, content):
            yield (point_id, project_id, file_path, language, *judge(content, language))

        return run

    return map_rows(files, make, "point_id string, project_id string, file_path string, language string, valid boolean, line int, cause string")


def invalid_files(points: DataFrame) -> DataFrame:
    """(point_id) of judged files that aren't valid, once each."""
    return judge_files(points).where(~F.col("valid")).select("point_id").distinct()


def invalid_rates(points: DataFrame) -> DataFrame:
    """project_id, language, files, invalid BIGINT, rate DOUBLE of each project (null included) and language."""
    once = judge_files(points).select("point_id", "project_id", "language", "valid").dropDuplicates(["point_id"])
    return once.groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("bigint")).alias("invalid"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("rate"))
