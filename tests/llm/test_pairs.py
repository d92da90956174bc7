"""Functions with documentation: overloads, repeated rows, bodies in the capture."""

from lodestrata.llm import docpairs

JAVA = """class A {
  /** Adds the two given numbers and returns their sum. */
  int add(int a, int b) { return a + b; }
  /** Adds the three given numbers and returns their sum. */
  int add(int a, int b, int c)
  {
    String s = "}";
    return a + b + c;
  }
}
"""
TS = """class A {
  // Computes the total of all given items at once.
  total(items: X[]): number
  {
    return 1;
  }
}
/** Doubles the given value and returns it to callers. */
const f = (x) => ({a: x});
"""


def test_overloads_are_pairs_of_their_own_and_repeated_rows_are_one(spark):
    rows = spark.createDataFrame([("1", "a/A.java", None, "file", JAVA), ("1", "a//A.java", "java", "file", JAVA), ("2", "b.ts", None, None, TS), ("3", "c.ts", None, None, None), ("4", "d.ts", None, None, "")], "point_id string, file_path string, language string, symbol_type string, content string")
    got = sorted((r.point_id, r.symbol, r.line) for r in docpairs.documented_functions(rows).collect())
    assert got == [("1", "A.add", 3), ("1", "A.add", 5), ("2", "A.total", 3), ("2", "f", 9)]
    assert sorted(map(tuple, docpairs.documented_symbols(rows).collect())) == [("1", "A.add"), ("2", "A.total"), ("2", "f")]


def test_one_pattern_captures_comment_signature_and_body():
    (_, doc, code, _), (_, _, other, _) = docpairs.pairs(JAVA, "java")
    assert doc.startswith("Adds the two") and code.endswith("{ return a + b; }") and other.endswith('String s = "}";\n    return a + b + c;\n  }')
    assert [p[2] for p in docpairs.pairs(TS, "script")][1] == "const f = (x) => ({a: x});"
