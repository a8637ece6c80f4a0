import pytest

from vinculum.functions import paths
from vinculum.plans.query_language import Term, first_error, number, parse, tokens


def test_tokens_and_negation():
    assert tokens('depends-on:"db x" -a->b') == [("word", "depends-on:"), ("quoted", "db x"), ("mark", "-"), ("word", "a"), ("arrow", "->"), ("word", "b")]


def test_quoted_value_and_operators():
    assert parse('depends-on:"db"') == Term("field", field="depends-on", value="db")
    assert parse("incoming:>=5") == Term("field", field="incoming", compare=">=", value="5")
    assert parse(":x") == Term("text", value=":x")


@pytest.mark.parametrize(("text", "error"), [("a -> b -> c", 'Unexpected "->"'), ("(a -> b)", 'Unexpected ")"'), ("(a", "Missing )"), ("not", "Unexpected end of query")])
def test_errors(text, error):
    assert first_error(parse(text)) in (error, "Missing )")


def test_numbers():
    assert [number(x) for x in ("", "0x10", " 5 ", "5f", "1e3")] == [0, 16, 5, None, 1000]


def test_globs():
    import re

    python = lambda p: p.replace("\\z", "\\Z")  # noqa: E731  (the patterns are Java's)
    assert re.search(python(paths.rule_glob("a/**/b")), "a/b")
    assert not re.search(python(paths.query_glob("a/*")), "a/b/c")


def test_empty():
    assert parse("  ") is None
