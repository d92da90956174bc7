"""File predicates of a project: included extensions and excluded paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.paths import base_name, extension


def included(path: Column, extensions: Column) -> Column:
    """Whether the extension, in any letter case, is in the list; a null or empty list includes nothing."""
    return F.coalesce(F.exists(extensions, lambda e: F.lower(e) == extension(path)), F.lit(False))


def glob_regex(pattern: Column) -> Column:
    """A regular expression of a glob over one path segment: `*`, `?`, `[...]` and escapes; malformed ones match nothing."""
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|])", r"\\$1")
    stars = F.regexp_replace(escaped, r"(?<!\\)\*", "[^/]*")
    marks = F.regexp_replace(stars, r"(?<!\\)\?", "[^/]")
    whole = F.concat(F.lit("^(?s)"), marks, F.lit("$"))
    broken = (F.instr(pattern, "[") > 0) & ~pattern.rlike(r"\[\^?[^\]]+\]") | pattern.rlike(r"(?<!\\)(\\\\)*\\$")
    return F.when(broken, F.lit("(?!)")).otherwise(whole)


def _matches(path: Column, pattern: Column) -> Column:
    return path.startswith(pattern) | F.rlike(base_name(path), glob_regex(pattern)) | (pattern.endswith("/") & F.contains(path, pattern))


def excluded(path: Column, patterns: Column) -> Column:
    """Whether a pattern matches the path or one of its folders, by prefix, by glob of the last segment, or as `dir/` anywhere.

    The root counts as the folder `.`. A null list excludes nothing. A folder that matches takes everything below it along.
    """
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    tested = F.concat(F.array(F.lit(".")), folders)
    return F.coalesce(F.exists(patterns, lambda p: p.isNotNull() & F.exists(tested, lambda a: _matches(a, p))), F.lit(False))
