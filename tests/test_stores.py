"""The content store, the point sink, filters, read-through answers and the loop guard, by rule."""

import json

import pytest
from pyspark.sql import functions as F

from skein.operators import ingest, retrieval, sessions
from skein.sources import content, points


def test_contents_are_kept_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    frame = lambda rows: spark.createDataFrame(rows, "key string, content string")
    assert [r.found for r in content.get(frame([("a", None)]).select("key"), root).collect()] == [False]
    content.put(frame([("a", "one"), ("b", "one"), ("c", None), ("d", "")]), root)
    content.put(frame([("a", "one"), ("b", "two"), ("b", "two")]), root)
    content.put(frame([("b", "two")]), root)
    blobs = spark.read.parquet(f"{root}/blobs").collect()
    assert sorted(r.content for r in blobs) == ["", "one", "two"]
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("x", 5), (None, 6), ("a", 7)], "key string, content_id int")
    got = {r.content_id: (r.key, r.found, r.content) for r in content.get(asked, root).collect()}
    assert got == {1: ("a", True, "one"), 2: ("b", True, "two"), 3: ("c", True, None), 4: ("d", True, ""), 5: ("x", False, None), 6: (None, False, None), 7: ("a", True, "one")}
    with pytest.raises(Exception, match="needs a key"):
        content.put(frame([(None, "x")]), root)
    plan = content.get(asked, root)
    assert plan.columns == ["key", "content_id", "found", "hash", "content"]


class Folder:
    """Refuses large requests, is busy at times and fails one task once."""

    def __init__(self, root, most=50, fail_on=None):
        self.root, self.most, self.fail_on, self.calls = root, most, fail_on, 0

    def upsert(self, rows):
        import os
        import uuid

        self.calls += 1
        if len(rows) > self.most:
            raise points.TooLarge
        if self.calls % 5 == 3:
            raise points.Busy
        if self.fail_on is not None and any(r["id"] == self.fail_on for r in rows) and not os.path.exists(f"{self.root}/failed"):
            open(f"{self.root}/failed", "w").close()
            raise OSError("the connection is lost")
        with open(f"{self.root}/{uuid.uuid4().hex}.json", "w") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows))


def stored(root):
    rows = [json.loads(x) for p in root.glob("*.json") for x in p.read_text().splitlines()]
    return rows, {r["id"]: r for r in rows}


def test_points_are_neither_lost_nor_doubled(spark, tmp_path):
    rows = spark.range(1000).repartition(3).select("id", F.array(F.lit(0.5)).alias("vector"), F.struct(F.lit("p").alias("name")).alias("payload"))
    root = str(tmp_path)
    with pytest.raises(Exception, match="connection is lost"):
        points.upsert(rows, lambda: Folder(root, fail_on=777), 64, wait=0)
    points.upsert(rows, lambda: Folder(root, fail_on=777), 64, wait=0)
    sent, kept = stored(tmp_path)
    assert set(kept) == set(range(1000)) and kept[5] == {"id": 5, "vector": [0.5], "payload": {"name": "p"}} and 1000 <= len(sent) <= 2000
    points.upsert(rows.where("id < 0"), lambda: Folder(root), 64)


def test_batches_are_halved_and_bounded():
    class Store:
        def __init__(self, most):
            self.most, self.sizes, self.got = most, [], []

        def upsert(self, rows):
            self.sizes.append(len(rows))
            if len(rows) > self.most:
                raise points.TooLarge
            self.got += rows

    for most, n in ((1, 40), (7, 100), (200, 300), (16, 0)):
        store = Store(most)
        sent = points.send(iter([{"id": i} for i in range(n)]), store, 128)
        assert [r["id"] for r in store.got] == list(range(n)) and sent.points == n and sent.batches == sum(s <= most for s in store.sizes)
    with pytest.raises(points.TooLarge):
        points.send(iter([{"id": 1}]), Store(0), 128)

    class Down(Store):
        def upsert(self, rows):
            raise points.Busy

    with pytest.raises(points.Busy):
        points.send(iter([{"id": 1}]), Down(1), 8, tries=3, wait=0)
    assert [points.batch_points(d) for d in (1, 1536, 1_000_000)] == [128, 55, 8]


def test_filters_of_any_depth(spark, tmp_path):
    rows = [(1, "red box", ["a", "b"], 5.0), (2, "blue box", [], 7.0), (3, None, None, None), (4, "red lid", ["ab"], 9.0)]
    spark.createDataFrame(rows, "id int, name string, tags array<string>, size double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = lambda spec: sorted(r.id for r in df.where(retrieval.compiled_filter(spec, dict(df.dtypes))).collect())
    key = lambda k, **m: {"key": k, "match": m}
    assert found({}) == [1, 2, 3, 4] and found({"must": []}) == [1, 2, 3, 4]
    assert found({"must": [key("name", text="red")], "must_not": [key("tags", value="a")]}) == [4]
    assert found({"should": [key("id", value=2), {"must": [key("tags", any=["b", "ab"]), {"key": "size", "range": {"gte": 5, "lt": 9}}]}]}) == [1, 2]
    assert found({"must_not": [{"must_not": [key("tags", text="b")]}]}) == [1, 4]
    assert found({"must_not": [key("name", text="red")]}) == [2, 3] and found({"must": [key("id", **{"except": [1, 2]})]}) == [3, 4]
    for wrong in ({"key": "no", "match": {"value": 1}}, {"key": "id"}, {"key": "id", "match": {"like": 1}}, {"must": [], "and": []}, {"key": "id", "range": {"min": 1}}):
        with pytest.raises(ValueError):
            retrieval.compiled_filter(wrong, dict(df.dtypes))
    plan = df.where(retrieval.compiled_filter({"must": [key("id", any=[1, 4]), {"must": [{"key": "size", "range": {"gt": 6}}]}]}, dict(df.dtypes)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(size,6.0)" in plan and "In(id, [1,4])" in plan


def test_read_through(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, value string")
    asked = frame([("A", ""), ("a", ""), (" ", ""), (None, ""), ("b", ""), ("C", ""), ("d", ""), ("e", "")])
    got = ingest.read_through(asked.select("id"), frame([("a", "cached"), ("b", " "), ("z", "no")]), frame([("A", "stored"), ("B", "from store"), ("D", None)]))
    assert sorted((r.id, r.outcome, r.value) for r in got.collect()) == [("A", "cached", "cached"), ("C", "missing", None), ("b", "stored", "from store"), ("d", "stored", None), ("e", "missing", None)]
    assert [(r.id, r.value) for r in ingest.cache_fills(got).collect()] == [("b", "from store")] and sorted(r.id for r in ingest.failures(got).collect()) == ["C", "e"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # of one aggregate; none for a join


def test_no_action_before_the_first_result(spark):
    rows = [("s", i, "run", a) for i, a in enumerate(['{"x":1,"y":2}', '{ "y": 2, "x": 1 }', '{"x":1,"y":2}', None, '{"y":2,"x":1}', '{"x":2}', '{"x": 2}'])] + [("t", 1, "run", "{}"), ("t", 2, "run", "{}"), ("t", 3, "run", "{ }")]
    calls = spark.createDataFrame(rows, "s string, n int, tool string, args string")
    got = sessions.loop_guard(calls, "s", ["n"], sessions.call_signature("tool", "args"), result=F.col("args").isNull()).collect()
    assert [r.action for r in sorted((r for r in got if r.s == "s"), key=lambda r: r.n)] == ["none", "none", "none", "none", "suppress", "none", "warn"]
    assert {r.action for r in got if r.s == "t"} == {"none"}
    assert [r.nth for r in sorted((r for r in got if r.s == "t"), key=lambda r: r.n)] == [1, 2, 3]
