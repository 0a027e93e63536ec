"""A table of one row group is one task of a scan; what follows must not be."""

import weakref

import pyarrow as pa
from pyspark.sql import functions as F

from skein.functions import python
from skein.operators import describe, members, symbols
from skein.plans import code_queries as code
from skein.plans import source_queries as source
from skein.plans import stream_queries
from skein.plans import text_queries as text
from skein.streaming import incremental


def one_row_group(spark, tmp_path, n=400):
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a line "), "id", F.lit('\nwith a "quote\n\\and more')).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source")
    )
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def tasks_with_rows(df):
    return len(df.groupBy(F.spark_partition_id()).count().collect())


def test_files_of_declared_types(spark, tmp_path):
    folder = one_row_group(spark, tmp_path)
    assert tasks_with_rows(code._models(spark, folder)) == 4


def test_blanked_keeps_places():
    text = 'a /* b\r\n c\n\n*/ "x\\"y" // z\n@"1\n2""3" \'c\' d'
    flat = symbols.blanked(text)
    assert [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(flat) if c == "\n"]
    assert len(flat) == len(text) and flat.split() == ["a", "d"]
    assert symbols.declarations("class A { int x; }", symbols.blanked("class A { int x; }")) == symbols.declarations("class A { int x; }")


def plan(df, optimized=False):
    made = df._jdf.queryExecution()
    return (made.optimizedPlan() if optimized else made.executedPlan()).toString()


def test_commands_and_scores_are_spread(spark, tmp_path):
    folder = one_row_group(spark, tmp_path, 20)
    for made in (source.command_routes, text.score_gate, text.score_sections):
        assert "RoundRobinPartitioning" in plan(made(spark, folder))


def test_pages_are_spread_and_keep_their_texts(spark, tmp_path):
    pages = spark.range(700).select(F.col("id").alias("page_id"), F.expr("if(id % 7 = 0, null, concat('<p>a &lt; ', id, '</p>'))").alias("html"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for made, none in ((text.html_text_unescaped, ""), (text.html_text_dom, None)):
        rows = made(spark, str(tmp_path))
        assert "RoundRobinPartitioning" in plan(rows)
        assert {r["page_id"]: r["text"] for r in rows.collect()} == {i: none if i % 7 == 0 else f"a < {i}" for i in range(700)}


def test_buckets_are_broadcast(spark):
    rows = spark.range(10).select(F.col("id").alias("doc_id"), incremental._bits("id").alias("bits"))
    placed = incremental._placed(rows, ["0", "10", "11"], "bits", "leaf")
    assert "BroadcastHashJoin" in plan(placed)
    assert all(r["bits"].startswith(r["leaf"]) for r in placed.collect()) and placed.count() == 10


def test_files_of_changes_grow_with_the_partitions(spark, tmp_path, monkeypatch):
    folder = one_row_group(spark, tmp_path)
    monkeypatch.setattr(stream_queries, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        stream_queries._changes(spark, folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list(tmp_path.glob("changes/*.parquet"))) == 16


def test_small_forms_of_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(-1, "<a>"), (-3, None), (None, "x"), (4, "y")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in source.small_forms(spark, str(tmp_path)).collect()}
    assert set(rows) == {-1, -3, None, 4}
    assert rows[-1]["html"] and rows[-1]["boolish"] is None and rows[-3]["ddr"] == "ABC-000997" and rows[None]["is_test"] is False


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    folder = one_row_group(spark, tmp_path, 20)
    files = code._files(spark, folder, code._CONTROLLER, code._action, "    }\n}\n", "src/{i}Controller.cs")
    everything = members.with_types(files).orderBy("path").collect()
    for asked in (describe.ENDPOINTS, describe.CLASSES, describe.INTERFACES, describe.ROUTES, describe.ENTITY_URLS, describe.HEADER_FIELDS):
        some = members.with_types(files, asked=asked)
        assert set(some.columns) == {"path", *asked.fields}
        for part, whole in zip(some.orderBy("path").collect(), everything, strict=True):
            part, whole = part.asDict(True), whole.asDict(True)
            kept = [{k: m[k] for k in asked.members} for m in whole["members"] if m["kind"] in asked.kinds]
            assert part == {k: whole[k] for k in part if k != "members"} | ({"members": kept} if "members" in part else {})


def test_header_fields_read_files_once(spark, tmp_path):
    folder = one_row_group(spark, tmp_path, 20)
    rows = code.header_fields(spark, folder)
    assert "MapInArrow" not in plan(rows)  # both sides of the join come from a table
    assert plan(code.controller_routes(spark, folder)).count("MapInArrow") == 1


def test_batches_are_let_go_before_the_next_is_read(monkeypatch):
    monkeypatch.setattr(python.F, "arrow_udf", lambda f, _: lambda c: f)
    refs, gone = [], []

    def batches():
        for _ in range(3):
            made = [pa.array(["a", None])]
            refs.append(weakref.ref(made[0]))
            yield made.pop()
            gone.append(refs[-1]() is None)

    assert [x.to_pylist() for x in python._each(str.upper, "x")(batches())] == [["A", None]] * 3
    assert gone == [True] * 3
