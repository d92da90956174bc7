import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import mixing, tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def own():
    return tokens.encoder()


def split(own, text, size):
    return own.concatenate([own.leaf(text[i : i + size]) for i in range(0, len(text), size)]).ids


TEXT = st.text(alphabet=st.sampled_from(list("ab cAB'sltre\n\t 12é数🙂.,!-_ \u00a0\u200b\r")), max_size=120)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 17))
def test_concatenation_is_exact(text, size):
    own = tokens.encoder()
    whole = own.core.encode_ordinary(text)
    assert split(own, text, size) == whole
    assert own.encode(text) == whole


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcde", min_size=600, max_size=3000))
def test_long_unsplit_pieces(text):
    own = tokens.encoder()
    assert own.piece(text.encode()) == own.core.encode_single_piece(text.encode())
    assert split(own, text, 700) == own.core.encode_ordinary(text)


def test_runs_and_special_strings(own):
    rng = random.Random(1)
    for text in ("a" * 5000, " " * 5000 + "x", "=" * 3000, "ab" * 4000, "<|endoftext|> x", "".join(rng.choice("lorem'veé ") for _ in range(9000)), "\n" * 999 + " a"):
        assert split(own, text, 512) == own.core.encode_ordinary(text)


def test_encode_texts(spark):
    rows = [(1, "hello world", 1), (2, "", 2), (3, None, 3), (1, "hello world", 4), (4, "word " * 3000, 5), (None, "x", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = sorted(((r.doc_id or 0), r.ids) for r in tokens.encode_texts(df).collect())
    core = tokens.encoder().core
    assert out == sorted(((i or 0), core.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_allocation():
    got = mixing.allocate({"a": 100, "b": 1000}, [("a", 0.5, 2), ("b", 0.5, 3), ("none", 0.0, 1), ("missing", 0.2, 4)], 1100)
    assert got["a"][1] == 200 and got["missing"][1] == 0 and got["none"] == (0, 0)
    assert abs(got["b"][1] - 900) < 1


def test_mix(spark):
    rows = [(i, "big", "word " * (i % 9 + 1)) for i in range(600)] + [(1000 + i, "small", "word " * 5) for i in range(20)] + [(2000 + i, None, "word " * 5) for i in range(50)] + [(3000, "small", None), (3001, "big", "")]
    docs = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id bigint, source string, text string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.06, 3), ("zero", 0.0, 3), ("gone", 0.2, None), (None, 0.1, 2)], "source string, weight double, max_repeats int")
    selection, report = mixing.mix(docs, targets)
    chosen = selection.collect()
    assert len({r.doc_id for r in chosen}) == len(chosen)
    assert all(0 < r.copies <= (2 if r.source == "big" else 3) and r.tokens > 0 for r in chosen)
    total = sum(len(tokens.encoder().encode(t)) for _, _, t in rows if t)
    by = {r.source: r for r in report.collect()}
    weights = 0.5 + 0.06 + 0.2
    assert abs(by["big"].mixed_tokens - 0.5 / weights * total) <= 10
    assert by["zero"].mixed_tokens == by["gone"].mixed_tokens == 0 and by["gone"].capped
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in chosen}
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_larger_documents_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, "s", "word " * (1 if i % 2 else 16)) for i in range(2000)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("s", 0.3, 1), ("t", 0.7, 1)], "source string, weight double, max_repeats int")
    chosen = mixing.mix(docs, targets, size_power=0.5)[0].collect()
    long = sum(r.tokens > 4 for r in chosen)
    assert 2.5 < long / max(1, len(chosen) - long) < 6.5  # the inclusion odds differ by the root of the sizes


def test_odds_above_one_are_certain_and_the_rest_is_scaled(spark):
    from lodestrata.llm.mixing import certain_first

    sizes = [1000] + [10] * 400 + [40] * 50
    df = spark.createDataFrame([(i, "s", n) for i, n in enumerate(sizes)], "doc_id bigint, source string, tokens bigint")
    rest, power = 3500.0, 0.9
    first = rest / sum(n ** (1 + power) for n in sizes)
    factor = certain_first(df, {"s": (rest, first), "t": (0.0, 0.0)}, {"s": 1000}, power)["s"]
    odds = [min(1.0, factor * n**power) for n in sizes]
    assert first * 1000**power > 1 and abs(sum(p * n for p, n in zip(odds, sizes)) - rest) < 1e-6
