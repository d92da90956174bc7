"""Grammars on deep nesting and the exact place of the furthest failure."""

import pytest

from lodestrata.llm import syntax
from lodestrata.llm.peg import Codes, Grammar

OPEN = {"json": ("", "[", "1", "]", ""), "js": ("x = ", "[", "1", "]", ";"), "ts": ("x = ", "(", "1", ")", ";"), "py": ("x = ", "(", "1", ")", "\n"), "go": ("package a\nvar x = ", "(", "1", ")", "\n"), "java": ("class A { int x = ", "(", "1", ")", "; }"), "php": ("<?php $x = ", "[", "1", "]", ";")}


@pytest.mark.parametrize("language", OPEN)
@pytest.mark.parametrize("depth", [63, 66, 500, 20_000])
def test_nesting_is_judged_at_any_depth(language, depth):
    head, left, core, right, tail = OPEN[language]
    assert syntax.furthest_failure(head + left * depth + core + right * depth + tail, language) is None
    assert syntax.furthest_failure(head + left * depth, language) is not None
    assert syntax.furthest_failure(head + left * depth + core + right * (depth - 1) + tail, language) is not None


@pytest.mark.parametrize("language,text", [("js", "x = {};"), ("py", "x = {}\n"), ("go", "package a\nvar x = {}\n")])
def test_chains_without_brackets(language, text):
    unary = "not " if language == "py" else "!"
    assert syntax.furthest_failure(text.format(unary * 20_000 + "a"), language) is None
    assert syntax.furthest_failure(text.format(unary * 20_000), language) is not None


def test_the_furthest_failure_is_exact_inside_regular_rules():
    codes = Codes([], ["a", "b", "c", "d", "(", ")"])
    g = Grammar("file <- item EOF\nitem <- '(' item ')' / run\nrun <- 'a' 'b' 'c' / 'a' 'd'", codes)
    text = "".join(codes.of[x] for x in ["(", "a", "b", "d", ")"]) + "\0"
    assert g.parse(text) == (-1, 3)
    assert syntax.judge("x = 1\ny = [1,\n  2,\n  3 4]\n", "py") == (False, 4, "syntax error")
