"""Column expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    "go": "go", "md": "markdown", "markdown": "markdown", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin",
    "scala": "scala", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "html": "html",
    "css": "css", "scss": "scss", "less": "less", "vue": "vue", "svelte": "svelte",
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Lower case, from the last dot of the last segment, dot included; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def detect_language(path: Column | str) -> Column:
    """Language by extension, `text` for all others and for null."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in ("." + pair[0], pair[1])])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("text"))


def extract_module(path: Column | str) -> Column:
    """The last segment of the parent folder; empty at the root."""
    p = _c(path)
    return F.when(F.instr(p, "/") == 0, F.lit("")).otherwise(F.element_at(F.split(p, "/"), -2))


def normal_path(path: Column | str) -> Column:
    """Forward slashes, one at a time, no leading `./` or `/` and no trailing slash."""
    p = F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), "^/|/$", "")
