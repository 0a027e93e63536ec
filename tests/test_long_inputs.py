"""Inputs of a megabyte that once took the stack of the engine or quadratic time."""

import re
import time

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import code, symbols, tools

MB = 1 << 20


def one(spark, text, *columns):
    frame = spark.createDataFrame([(text,)], "text string")
    frame.select(F.length("text")).first()
    began = time.perf_counter()
    row = frame.select(*columns).first()
    assert time.perf_counter() - began < 8
    return row


@pytest.mark.parametrize("body", ["a" * MB, r"\"" * (MB // 2), r"\\" * (MB // 2), "a\\n" * (MB // 3)])
def test_long_literals(spark, body):
    text = f'class A {{ string x = "{body}"; string y = @"{body.replace(chr(92), "").replace(chr(34), chr(34) * 2)}"; /* {"*" * MB} */ }} // end'
    row = one(spark, text, code.blanked("text"), code.without_comments("text"))
    assert re.sub(r"\s+", " ", row[0]).strip() == "class A { string x = ; string y = ; }"
    assert row[1].endswith("}  ") and body in row[1] and "***" not in row[1]


def test_open_comments_and_strings(spark):
    row = one(spark, "class A { } " + "/* open " * (MB // 8), code.blanked("text"))
    assert row[0].strip() == "class A { }"
    assert one(spark, 'x = "open\nclass B { }', code.blanked("text"))[0] == 'x = "open\nclass B { }'


@pytest.mark.parametrize("argument", ["a" * MB, '"' + "a b " * (MB // 4) + '"', r"\"" * (MB // 2), '"' + r"\\\"" * (MB // 4) + '"', '"a"' * (MB // 3), "\\x" * (MB // 2)])
def test_long_arguments(spark, argument):
    row = one(spark, f"{argument} tail", T.F.size(tools.arguments(F.col("text"))), tools.arguments(F.col("text")))
    assert row[0] == 2 and row[1][1] == "tail" and len(row[1][0]) >= MB // 3 - 3


def test_arguments_by_rule(spark):
    """The routing rules of white space, quotes and escapes."""
    cases = {
        "a b": ["a", "b"], '"a b" c': ["a b", "c"], r'say \"hi\" x': ["say", '"hi"', "x"], r"a\\b": ["a\\b"], r"a\nb": ["a\\nb"], 'x"y z"w': ["xy zw"], '"open': None, '""': [], r'"a\"b" c': ['a"b', "c"],
        r'"c:\dir" e': ["c:\\dir", "e"], "  ": [],
    }
    for text, want in cases.items():
        assert spark.createDataFrame([(text,)], "text string").select(tools.arguments(F.col("text"))).first()[0] == want, text


@pytest.mark.parametrize("text,want", [
    ("<" * MB, "<" * MB), ("<script>" * (MB // 8), ""), ("a <b " * (MB // 5), None), ("<style>x" * (MB // 8) + "</style>end", "end"),
    ("<p>x</p>" * (MB // 8), None), ("<SCRIPT>a</Script>b<script>c", "b c"),
])
def test_markup_in_linear_time(spark, text, want):
    got = one(spark, text, T.html_to_text("text"))[0]
    if want is not None:
        assert got == want
    elif text.startswith("a <b"):
        assert len(got) > MB // 2


def test_markup_keeps_its_meaning(spark):
    def plain(t):
        for p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
            t = re.sub(p, " ", t)
        return re.sub(r"[ ]{2,}", " ", re.sub(r"[\r\n\t]+", " ", t)).strip()

    pieces = ["<script>", "</script>", "<style a>", "</STYLE>", "<b", ">", "<>", "x", " < ", "y>z", "</script", "<i>"]
    texts = ["".join(pieces[(i * k + k) % len(pieces)] for k in range(1, 9)) for i in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.html_to_text("text").alias("x")).collect()
    assert all(r.x == plain(r.text) for r in got)


@pytest.mark.parametrize("head", ["int /* {} */ y", "int {} Get()", "public void {}(int a)", "[A({})] int x"])
def test_declarations_in_linear_time(head):
    for filler in ("x" * MB, " " * MB, "x " * (MB // 2), "(" * MB, "[" * MB):
        began = time.perf_counter()
        found = symbols.declarations("class A { " + head.format(filler) + "; }")
        assert found[0].name == "A" and time.perf_counter() - began < 3


def test_fields_with_braces_are_fields():
    kinds = {d.name: d.kind for d in symbols.declarations("class A { int[] a = { 1 }; List<int> b = new List<int> { 1 }; int C { get; set; } = 1; int D => 1; [X(new[] { 1 })] int E; }")}
    assert kinds["a"] == kinds["b"] == "field" and kinds["C"] == kinds["D"] == "property"
