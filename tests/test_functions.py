import pytest
from pyspark.sql import functions as F

from lodestrata.functions import filters, ids, paths
from lodestrata.sources.files import glob_matches, is_excluded


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_ids(spark):
    r = one(spark, a=ids.chunk_id(F.lit("p"), F.lit("a/b.md"), F.lit("A: b"), F.lit("0123456789")), b=ids.chunk_id(F.lit("p"), F.lit("f"), F.lit(""), F.lit("0123456789")), c=ids.point_id(F.lit("a")), n=ids.chunk_id(F.lit("p"), F.lit("f"), F.lit(None).cast("string"), F.lit("0123456789")))
    assert (r.a, r.b, r.n) == ("p:a/b.md:A_ b:01234567", "p:f:_:01234567", "p:f:_:01234567")
    assert r.c == "ca978112-ca1b-bdca-fac2-31b39a23dc4d"


def test_tokens_count_bytes(spark):
    r = one(spark, a=ids.index_tokens(F.lit("éééé")), b=ids.report_tokens(F.lit("x" * 5122)), c=ids.report_tokens(F.lit("x" * 5123)))
    assert (r.a, r.b, r.c) == (2, 2048, 2049)


@pytest.mark.parametrize("k,want", [(-1, 5), (0, 5), (7, 7), (21, 20), (None, 5)])
def test_clamp(spark, k, want):
    assert one(spark, k=ids.clamp_top_k(F.lit(k).cast("int"))).k == want


@pytest.mark.parametrize("path,language,module", [("X.TSX", "typescript", ""), ("Makefile", "text", ""), ("a/b/c.go", "go", "b"), (".gitignore", "text", "")])
def test_language_and_module(spark, path, language, module):
    r = one(spark, a=paths.detect_language(F.lit(path)), b=paths.extract_module(F.lit(path)))
    assert (r.a, r.b) == (language, module)


@pytest.mark.parametrize("path,want", [("./a//b.py", "a/b.py"), ("a\\b\\c.py", "a/b/c.py"), ("/a/./b/", "a/b"), ("a/b.py", "a/b.py"), ("..a/.b.py", "..a/.b.py")])
def test_normal_path(spark, path, want):
    assert one(spark, p=paths.normal_path(F.lit(path))).p == want


CASES = [
    ("outer.ts", ["out"], True), ("a/out/x.ts", ["out"], True), ("a/b/layout.ts", ["out"], False), ("x.ts", [".*"], True), ("node_modules", ["node_modules/"], False),
    ("p/node_modules/x.js", ["node_modules/"], True), ("a/b_test.go", ["*_test.go"], True), ("a/b.go", ["*_test.go"], False), ("a/x1.js", ["x[0-9].js"], True), ("a/x.js", ["x["], False), ("a.b", ["a?b"], True), ("a.js", [], False), ("q(1).js", ["q(1).js"], True),
]


@pytest.mark.parametrize("path,patterns,want", CASES)
def test_excluded(spark, path, patterns, want):
    column = filters.excluded(F.lit(path), F.array(*map(F.lit, patterns)).cast("array<string>"))
    assert one(spark, x=column).x is want
    parts = path.split("/")
    folders = [".", *("/".join(parts[: i + 1]) for i in range(len(parts)))]
    assert any(is_excluded(f, tuple(patterns)) for f in folders) is want


def test_excluded_nulls(spark):
    assert one(spark, x=filters.excluded(F.lit("a"), F.lit(None).cast("array<string>"))).x is False
    assert one(spark, x=filters.included(F.lit("a.PY"), F.array(F.lit(".py")))).x is True
    assert one(spark, x=filters.included(F.lit("a.py"), F.lit(None).cast("array<string>"))).x is False


def test_glob():
    assert glob_matches("a*b", "a\\*b") and not glob_matches("axb", "a\\*b") and not glob_matches("a", "a\\")
