import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from skein.functions import python as P
from skein.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text", ["a\rb", "a\r\nb", "a\r\r\nb", "a\n", "", "x" * 501 + "\ny"])
def test_hashes(spark, text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n")
    assert one(spark, T.file_hash, text) == hashlib.sha256(lines.replace("\n", "\r\n").encode()).hexdigest()
    cut = "".join(x[:500] + "\n" for x in lines.split("\n"))
    assert one(spark, T.code_hash, text) == hashlib.sha256(cut.encode()).hexdigest()


def test_null_hash(spark):
    assert one(spark, T.code_hash, None) == "" and one(spark, T.file_hash, None) is None


def test_uuid5(spark):
    space = uuid.UUID(T.DOC_NAMESPACE)
    for i in range(40):
        name = f"https://h/r|/p/é{i}.cs"
        assert one(spark, lambda c: T.uuid5_hex(c, T.DOC_NAMESPACE), name) == uuid.uuid5(space, name).hex.upper()


@pytest.mark.parametrize("route,want", [
    ("/API/{id}//x/?q=1", "/api/{x}/x"), ("/", "/"), ("", ""), (None, ""), ("a\\b", "/a/b"), ("plain", "plain"), (" /A/ ", "/a"), ("///", "/"),
])
def test_routes(spark, route, want):
    assert one(spark, T.normalize_route, route) == want
    if not want:
        assert one(spark, lambda c: T.normalize_route(c, True), route) is None


def test_paths_and_keys(spark):
    assert one(spark, T.normalize_index_path, "./A\\B//c.cs") == "a/b/c.cs"
    assert one(spark, T.normalize_repo_url, " https://X/Y// ") == "https://x/y"
    assert one(spark, lambda c: T.chunk_id(c, F.lit(" "), F.lit("Z")), "Org") == "org:z"
    assert one(spark, T.table_safe, "a/b#c?") == "a_b_c_" and one(spark, T.table_safe, " ") == "_"
    with pytest.raises(Exception, match="empty part"):
        one(spark, lambda c: T.semantic_id(c, F.lit(""), F.lit("b")), "a")


@pytest.mark.parametrize("text,want", [("", 0), ("  \n", 0), (None, 0), ("word", 3), ("日本語", 5), ("see https://a.b/c", 5 + 8 + 2 + 2), ("!!!!", 1 + 2 + 2)])
def test_token_estimate(spark, text, want):
    assert one(spark, T.estimate_tokens, text) == want


@pytest.mark.parametrize("n", range(0, 14))
def test_truncate_utf8(spark, n):
    text = "aé日😀z"
    want = text.encode()[:n].decode(errors="ignore")
    assert one(spark, lambda c: T.truncate_utf8(c, n), text) == want


def test_small_functions(spark):
    assert one(spark, T.slugify, "  Hello,  World -- x ") == "hello-world-x"
    assert one(spark, T.normalize_question, " What `is`\n X ") == "what is x"
    assert [one(spark, T.parse_boolish, v) for v in ("TRUE", "0", "1", "no", None)] == [True, False, True, None, None]
    assert one(spark, T.applies_to, "Foo.bar and Baz qux. a Baz") == ["baz", "foo.bar"]
    assert one(spark, lambda c: T.slice_lines(c, 0, 2), "a\r\nb\nc") == "a\nb"
    assert one(spark, T.language_from_path, "x/Y.CS") == "csharp" and one(spark, T.language_from_path, "x") == "plaintext"
    assert one(spark, T.ddr_identifier, "abc-12") == "ABC-000012" and one(spark, T.ddr_identifier, "abcd-1") is None
    assert one(spark, T.is_test_path, "a\\tests\\b.cs") and not one(spark, T.is_test_path, "a/b.cs")
    assert [one(spark, T.batch_size, d, "int") for d in (3072, 1, 10**6)] == [28, 128, 8]
    assert [one(spark, T.method_kind, n) for n in ("AddX", "upsertY", "RemoveZ", "ValidateQ", "getAll", "Foo")] == ["Create", "Update", "Delete", "Validation", "Query", "Other"]
    assert one(spark, lambda c: T.combine_routes(c, F.lit("/b/")), "/a/") == "/a/b" and one(spark, lambda c: T.combine_routes(c, F.lit("")), "") == "/"
    assert one(spark, lambda c: T.endpoint_key(c, F.lit("GetAsync")), "DeviceController") == "DeviceController.Get"
    assert one(spark, lambda c: F.year(T.parse_iso_or_min(c)), "bad") == 1
    assert one(spark, lambda c: T.typed_check(c, "Number"), "1e3") is None and one(spark, lambda c: T.typed_check(c, "Date", True), " ") == "required"
    with pytest.raises(Exception, match="division"):
        one(spark, lambda c: T.calculate("div", c, F.lit(0.0)), 1.0, "double")


def test_html_and_json():
    assert P.dom_text("<ul><li>a<li>b</ul><script>x<p></script><p>c&amp;d") == "- a - b c&d"
    assert P.canonical('{"b":[{"Z":1,"a":2}],"A":1}') == '{"A":1,"b":[{"a":2,"Z":1}]}' and P.canonical(" no json ") == "no json"
    assert P.clean('{"t":"<p>hi</p>","auditHistory":[1],"n":3}') == '{"t": "hi", "n": 3}'
