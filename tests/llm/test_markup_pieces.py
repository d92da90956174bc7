"""Markup is cut between elements, of the least depth that does it."""

from lodestrata.llm.pieces import Packer, split, tokens_of


def test_elements_of_the_least_depth():
    row = "<li><a href='x > y'>entry</a><br>text of it</li>"
    text = "<ul class=\"a\">" + row * 40 + "</ul>\n<p>" + "word " * 30 + "</p>"
    pieces = split(text, 100, 0, False)
    assert "".join(text[b:e] for _, b, e in pieces) == text and all(tokens_of(len(text[s:e])) < 100 for s, _, e in pieces)
    assert all(text[b:e].startswith(("<li>", "<ul", "</ul>", "<p>")) for _, b, e in pieces)
    assert Packer("<a><b></b></a>", 4, False).elements(0, 14) == [(0, 3), (3, 14)]
    assert Packer("a <b> c", 4, False).elements(0, 7) == [(0, 7)]


def test_broken_markup_is_kept_whole():
    for text in ("<a><b></c></a></b>" * 30, "<" * 500, "<a " * 300, "<!-- " + "x" * 600, "<p>" * 400):
        pieces = split(text, 40, 5, False)
        assert "".join(text[b:e] for _, b, e in pieces) == text and all(tokens_of(len(text[s:e])) < 40 for s, _, e in pieces)
