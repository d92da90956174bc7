import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.operators import chunks as c
from lodestrata.operators import code_chunks as k

SCHEMA = "project_id string, file_path string, language string, module string, text string, extra int"


def files(spark, *rows):
    return spark.createDataFrame([("p", path, "text", "m", text, 1) for path, text in rows], SCHEMA)


def found(df):
    return [(r.symbol, r.symbol_type, r.start_line, r.end_line, r.token_count) for r in df.orderBy("file_path", "start_line").collect()]


def test_fixed_packing(spark):
    text = "\n".join(["a" * 8, "b" * 4, "c" * 4, "d" * 8])
    assert found(c.fixed(files(spark, ("d/x.tar.txt", text)), 2)) == [("x.tar.txt", "fragment", 1, 1, 2), ("x_tar", "fragment", 2, 3, 2), ("x_tar", "fragment", 4, 4, 2)]


def test_whole_empty_null_and_one_long_line(spark):
    df = files(spark, ("a.txt", ""), ("b.txt", None), ("c.txt", "x" * 5000), ("d.txt", "one\ntwo"))
    assert found(c.fixed(df)) == [("a.txt", "file", 1, 1, 0), ("c.txt", "fragment", 1, 1, 1250), ("d.txt", "file", 1, 2, 1)]


def test_empty_table(spark):
    none = files(spark, ("a.md", "x")).limit(0)
    for df in (c.fixed(none), c.markdown_sections(none), c.markdown_merged(none), k.code_chunks(none, "go")):
        assert df.count() == 0 and df.columns == c.CHUNK_COLUMNS


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é\t", max_size=30), min_size=1, max_size=40))
def test_fragments_join_to_the_text(spark, lines):
    text = "\n".join(lines)
    rows = sorted(c.fixed(files(spark, ("x.txt", text)), 5).collect(), key=lambda r: r.start_line)
    assert "\n".join(r.content for r in rows) == text
    assert all(sum(len(x.encode()) // 4 for x in r.content.split("\n")) <= 5 or r.start_line == r.end_line for r in rows if r.symbol_type == "fragment")


def test_markdown_sections(spark):
    df = files(spark, ("a.md", "intro\n# A\nx\n## B"), ("b.md", "#x\n####### y\n```\n# z\n```"), ("c.md", "## A\r\nt"), ("d.md", ""))
    assert [x[:4] for x in found(c.markdown_sections(df))] == [("(intro)", "heading", 1, 1), ("A", "heading", 2, 3), ("B", "heading", 4, 4), ("(intro)", "heading", 1, 3), ("z", "heading", 4, 5), ("A\r", "heading", 1, 2), ("(intro)", "heading", 1, 1)]


def merged_by_hand(sections, least):
    """(text, name) pairs folded from left to right."""
    rows, out = [list(s) for s in sections], []
    if len(rows) <= 1:
        return [tuple(r) for r in rows]
    for i, (text, name) in enumerate(rows):
        text = rows[i][0]
        small = len(text.encode()) // 4 < least
        if small and out:
            out[-1] = (out[-1][0] + "\n\n" + text, out[-1][1])
        elif small and i + 1 < len(rows):
            rows[i + 1][0] = text + "\n\n" + rows[i + 1][0]
        else:
            out.append((text, name))
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=1, max_size=9))
def test_markdown_merge(spark, sizes):
    sections = [(f"# h{i}\n" + "x" * n, f"h{i}") for i, n in enumerate(sizes)]
    rows = sorted(c.markdown_merged(files(spark, ("a.md", "\n".join(t for t, _ in sections))), 8).collect(), key=lambda r: r.start_line)
    assert [(r.content, r.symbol) for r in rows] == merged_by_hand(sections, 8)


SCRIPT = """
// adds two numbers
export function add(a, b) {
  return a + b;
}

/**
 * Doc
 */
@decorated
export class Cart<T> {
}
export class Basket extends Base {
  m() { return "}"; }
}

type Kind = 'a' | 'b';

export const go = async (x) => {
  return x;
};
export const typed = (n: string): string => { return n; };
function Button({ label }: P) {
  return 1;
}
"""


def test_typescript(spark):
    df = k.code_chunks(files(spark, ("s/m.ts", SCRIPT)), "typescript")
    assert [x[:4] for x in found(df)] == [("add", "function", 2, 5), ("Basket", "class", 13, 15), ("Kind", "type", 17, 17), ("go", "arrow_function", 19, 21), ("Button", "function", 23, 23)]


def test_typescript_fallback_and_default(spark):
    df = k.code_chunks(files(spark, ("a/c.ts", "const x = 1;\n"), ("a/e.ts", ""), ("a/k.ts", "export default class K {}")), "typescript")
    assert [x[:4] for x in found(df)] == [("a/c.ts", "file", 1, 2), ("a/e.ts", "file", 1, 1), ("K", "export_default", 1, 1)]


def test_pending_fold():
    sym = lambda n, size: k.Symbol(n, "function", 1, 1, "x" * size)
    assert [s.name for s in k.fold_pending([sym("a", 4), sym("b", 4), sym("C", 400)], 50, 800)] == ["C"]
    assert [s.name for s in k.fold_pending([sym("a", 4), sym("C", 3200), sym("d", 4)], 50, 800)] == ["a", "C", "d"]
    assert [s.name for s in k.fold_pending([sym("a", 4), sym("b", 4)], 50, 800)] == ["a+b"]


def test_php(spark):
    text = "<?php\nnamespace App\\M;\n\n#[Table]\nfinal class User\n{\n  function f() { return '}'; }\n}\n\n// note\nfunction helper($x) {\n}\ninterface I {\n}\n"
    rows = k.code_chunks(files(spark, ("m/User.php", text), ("m/e.php", "<?php\n")), "php").orderBy("file_path", "start_line").collect()
    assert [(r.symbol, r.symbol_type, r.start_line, r.end_line, r.module, r.language) for r in rows] == [("App\\M\\User", "class", 4, 8, "App\\M", "php"), ("helper", "function", 10, 12, "App\\M", "php"), ("I", "interface", 13, 14, "App\\M", "php"), ("m/e.php", "file", 1, 2, "m", "php")]
    assert rows[0].chunk_id.split(":")[2] == "User"


GO = 'package shop\n\nimport "os"\n\n// Kinds.\ntype (\n\tA struct{ x int }\n\tB interface{}\n)\n\n// Run runs\n// it.\nfunc Run(s string) error {\n\treturn nil // }\n}\n\nfunc (r *Tree) Cut() {}\nfunc (r Tree[K]) Grow() {}\n'


def test_go(spark):
    rows = found(k.code_chunks(files(spark, ("g/a.go", GO), ("g/b.go", "package x\nconst A = 1"), ("g/c.go", "package x\nfunc f( {")), "go"))
    assert [x[:4] for x in rows] == [("A", "struct", 5, 9), ("B", "interface", 5, 9), ("Run", "function", 11, 15), ("Tree.Cut", "method", 17, 17), ("Grow", "method", 18, 18), ("b.go", "file", 1, 2), ("c.go", "file", 1, 2)]


def test_go_fold():
    sym = lambda n, size: k.Symbol(n, "function", 1, 1, n * size)
    (one,) = k.fold_go([sym("f", 4), sym("G", 400), sym("h", 4)], 50)
    assert one.name == "G+1+1" and one.text.startswith("G") and one.text.endswith("f" * 4 + "\n\n" + "h" * 4)
    (all_small,) = k.fold_go([sym("f", 4), sym("g", 4)], 50)
    assert (all_small.name, all_small.kind) == ("f+g", "combined")


@pytest.mark.parametrize("path,want", [("a.GO", "go"), ("a.vue", "typescript"), ("a.markdown", "markdown"), ("a.blade.php", "php"), ("Makefile", "fixed")])
def test_dispatch(spark, path, want):
    assert files(spark, (path, "x")).select(c.strategy().alias("s")).first().s == want
