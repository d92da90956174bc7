"""Alignment of records, pages by repetition, and what the quick tests of a line may leave out."""

import random

import numpy as np
import pytest

from lodestrata.llm import residue, slots

SCHEMA = "doc_id bigint, text string, language string, file_path string"


def found(spark, *texts):
    df = spark.createDataFrame([(i, t, None, "a.md") for i, t in enumerate(texts)], SCHEMA)
    return sorted(r.doc_id for r in residue.residue(df).collect())


def test_one_retained_default_among_filled_records(spark):
    filled = [f"Hello {a}, your {b} is ready." for a, b in (("Ada", "late order"), ("Finn", "kiln"), ("Mia Roth", "vault"))]
    assert found(spark, "Hello undefined, your order is ready.", *filled) == [0]
    assert found(spark, "Hello undefined, your order is ready.") == []


def test_copies_are_no_evidence(spark):
    text = "The reader said undefined in the second run of the day."
    assert found(spark, text, text, text + "\n") == []
    assert found(spark, text, "We moved the vault out of the kiln in the second year.", "All is well.") == []


def test_blanks_and_two_slots(spark):
    assert found(spark, "Dear , thank you for your interest in the kiln.", "Dear [Ürün Adı], thank you for your interest in the vault.") == [0, 1]
    assert found(spark, "Dear %s, thank you for your interest in the kiln.", "Dear {0}, thank you for your interest in the late vault.") == [0, 1]


def test_pages_that_repeat_but_for_ids(spark):
    page = "Upstream failure {0}\nTicket a{0}f\nRetry"
    assert found(spark, *(page.format(i) for i in (17, 204, 9)), "Other text.") == [0, 1, 2]
    assert found(spark, page.format(17), page.format(17), page.format(18)) == []


def test_messages_of_any_length(spark):
    long = "Fatal error: Uncaught E: " + "x" * 2000 + " in /srv/a.php:7\nStack trace:\n" + "\n".join(f"#{i} f()" for i in range(900))
    page = "<html><body><h1>503 Service Unavailable</h1>" + "<div></div>" * 400 + "</body></html>"
    body = '{"error": "' + "no answer " * 500 + '", "status": 502}'
    assert found(spark, long, page, body, body[:-1]) == [0, 1, 2, 3]


def test_quick_tests_reject_only_what_the_grammars_reject():
    rng = random.Random(4)
    parts = "error 404 the page site not found could be located access denied something went wrong session expired please enable javascript your text here lorem ipsum title subtitle coming soon placeholder test forbidden {{ x }} undefined [INSERT X] %s Dear , . : #".split(" ")
    parts += ["hier steht", "blindtext", "buraya metin", "aquí va el texto", "örnek metin", "platzhaltertext", "t.b.d.", "to be written", "content pending", "blah blah", "seite nicht gefunden", "bulunamadı", "no encontrada", "bad gateway", "too many requests", "are you a robot", "traceback (most recent call last)", "bir hata oluştu", "algo salió mal", "HTTP 500", "is gone", "down for maintenance", "thrown in /a on line 7"]
    for _ in range(4000):
        line = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))
        raw = line.encode()
        text, at = residue.fillings(raw, residue.marks_in(raw))
        own = residue.visible(raw)
        assert bool(at) == bool(residue.CERTAIN.search(own) or residue.DOUBTFUL.search(own)), line
        words = set(raw.translate(residue.TO_WORDS).split())
        bare = residue.content_of(own)
        if residue.ERROR.match(bare):
            assert not words.isdisjoint(residue.ERROR_KEYS) or residue.STATUS.match(raw), line
        if residue.FILLER.match(bare):
            assert not words.isdisjoint(residue.FILLER_KEYS), line


def test_filled_records_by_brute_force():
    lines = [b"Hello Ada, your late order is ready.", b"no such line", b"Hello Mia Roth, your kiln is ready."]
    _, at = residue.fillings(b"Hello undefined, your x is ready.", [b"undefined"])
    keys = [s[0] for s in slots.line_slots("Hello undefined, your x is ready.", at)]
    bits = np.zeros(slots.BITS // 8, np.uint8)
    for k in keys:
        bits[(k % slots.BITS) >> 3] |= 1 << (k % slots.BITS & 7)
    got = [r for r in slots.aligned_records(lines, bits) if r[0] in keys]
    assert {r[1] for r in got} == {slots.number(b"ada"), slots.number(b"mia roth")} and slots.aligned_records([], bits) == []


@pytest.mark.parametrize("text", ["", "   ", "\n\n", "x" * 100_000, "word " * 50_000])
def test_edges(text):
    assert residue.judge(text.encode())[0] in (None, "filler")


def test_variables_of_any_length():
    for text in ("Dear {{ %s }}, hello.", "Total ${%s}.", "By <%%= %s %%> today.", "On [INSERT %s HERE]."):
        assert residue.judge((text % ("name " * 60)).encode())[0] == "placeholder"
