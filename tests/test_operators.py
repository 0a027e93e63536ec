import pytest
from pyspark.sql import functions as F

from skein.operators import catalog, chunks, code, ingest, retrieval, scoring, sessions
from skein.operators.retrieval import Condition
from skein.sources import files
from skein.streaming import incremental, sse


def test_scores(spark):
    good = "The Device manager will provision each Device and register it. It keeps an Alert for every device that fails. Each alert names the device."
    rows = [(1, good), (2, "Device stuff."), (3, "  \n "), (4, None)]
    out = {r.id: r for r in scoring.score_sections(spark.createDataFrame(rows, "id int, text string"), ["Device", "Alert"]).collect()}
    assert out[1].composite > 70 and out[1].category in ("Good", "Excellent") and out[1].matched_models == ["Device", "Alert"]
    assert out[2].clarity < 80 and "VeryShortText" in out[2].flags
    for i in (3, 4):
        assert (out[i].composite, out[i].category, out[i].flags) == (0.0, "Reject", ["EmptyText"])


def test_filters(spark):
    rows = [(1, "A", ["x"]), (2, "b", ["y", "z"]), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, k string, tags array<string>")
    ids = lambda *c: sorted(r.id for r in df.where(retrieval.scope_filter(c, dict(df.dtypes))).collect())
    assert ids(Condition("k", "IsEquals", ["A ", "a", ""])) == [1] and ids(Condition("k", "NotEquals", ["A"])) == [2]
    assert ids(Condition("tags", "Contains", ["z", "q"])) == [2] and ids(Condition("tags", "DoesNotContain", ["z"])) == [1]
    assert retrieval.scope_filter([Condition("k", "IsEquals", [" ", None])]) is None
    with pytest.raises(ValueError, match="unknown operator"):
        retrieval.scope_filter([Condition("k", "Like", ["a"])])


def test_diverse_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.5, "P"), (2, 0.5, "p"), (3, 0.9, None), (4, 0.1, "q")], "vec_id int, score double, k string")
    assert [(r.vec_id, r["rank"]) for r in retrieval.diverse(df, F.col("k")).orderBy("rank").collect()] == [(1, 1), (4, 2)]
    assert retrieval.fetch_limit() == 24 and retrieval.fetch_limit(1) == 12 and retrieval.fetch_limit(99) == 50


def test_ingest_plan(spark):
    found = spark.createDataFrame([("A.cs", "h1"), ("b\\c.cs", "h2"), ("n.cs", "h3")], "path string, content_hash string")
    index = spark.createDataFrame([("a.CS", "1", "h1", None), ("./b/c.cs", "2", "x", "full"), ("gone.cs", "3", "y", None)], "path string, doc_id string, content_hash string, reindex string")
    plan = {r.path: (r.action, r.hash_changed) for r in ingest.plan_ingest(found, index).collect()}
    assert plan == {"A.cs": ("chunk", False), "b\\c.cs": ("full", True), "n.cs": ("full", False), "gone.cs": ("delete", False)}
    assert {r.path: r.action for r in ingest.plan_ingest(found, index, True).collect()}["A.cs"] == "skip"
    assert [r.doc_id for r in ingest.plan_deletes(found, index).collect()] == ["3"]


@pytest.mark.parametrize("budget,overlap", [(20, 0), (20, 2), (60, 6), (4096, 6)])
def test_packing_invariants(budget, overlap):
    text = "\n".join(f"line {i} with some words, and {i * 7}" if i % 5 else "" for i in range(60)) + "\n" + "x" * 3000
    parts = list(chunks.pack_lines(text, budget, overlap))
    lines = text.split("\n")
    assert parts[0][0] == 1 and {k for a, b, _ in parts for k in range(a, b + 1)} == set(range(1, len(lines) + 1))
    for (a, b, c), (a2, _, _) in zip(parts, parts[1:]):
        assert 1 <= a <= b and c and a2 <= b + 1
        assert a == b or sum(chunks.estimate(x) + 1 for x in c.split("\n")) <= budget


def test_line_estimate_is_the_column(spark):
    from skein.functions.text import estimate_tokens

    lines = ["", " ", "plain words", "日本 x", "go to https://a.example/path?q=1 now!", "{};;()", "é à ü", "www.X.org"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r.n for r in df.select(estimate_tokens("t").alias("n")).collect()] == [chunks.estimate(x) for x in lines]


def test_windows_and_sections(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "abc")], "id int, text string")
    rows = [(r.id, r.part, r.total, r.chunk) for r in chunks.fixed_windows(df, 4, 1).orderBy("id", "part").collect()]
    assert rows == [(1, 1, 3, "abcd"), (1, 2, 3, "defg"), (1, 3, 3, "ghij"), (3, 1, 1, "abc")]
    assert chunks.fixed_windows(df, 4, 4).where("id = 1").count() == 3 and chunks.section_sizes() == (26000, 1024)
    md = spark.createDataFrame([(1, "intro\n### A\nx\n### B b\ny")], "id int, text string")
    assert [(r.section, r.header) for r in chunks.markdown_sections(md).collect()] == [(0, ""), (1, "A"), (2, "B b")]
    sized = spark.createDataFrame([("g", i, t) for i, t in enumerate([5, 5, 3, 9, 1])], "g string, i int, t int")
    assert [r.section for r in chunks.packed_sections(sized, "g", "i", F.col("t"), 10).orderBy("i").collect()] == [1, 1, 2, 3, 3]


@pytest.mark.parametrize("to,want", [(0, [2, 1, 3, 4]), (1, [2, 1, 3, 4]), (3, [1, 3, 2, 4]), (99, [1, 3, 4, 2])])
def test_move(spark, to, want):
    df = spark.createDataFrame([("l", i, i * 10) for i in range(1, 5)], "l string, id int, ord int")
    out = sessions.move_item(df, "l", "ord", F.col("id") == 2, to).orderBy("new_order").collect()
    assert [r.id for r in out] == want and [r.new_order for r in out] == [10, 20, 30, 40]


def test_sessions(spark):
    calls = spark.createDataFrame([("a",), ("b",), ("b",)], "call_id string")
    results = spark.createDataFrame([("b",), ("c",)], "call_id string")
    assert {r.call_id: r.status for r in sessions.reconcile_calls(calls, results).collect()} == {"a": "missing", "b": "duplicate", "c": "unexpected"}
    chapters = spark.createDataFrame([("x",), ("y",)], "chapter_id string")
    assert {r.chapter_id: r.place for r in sessions.reorder_chapters(chapters, ["y", "x"]).collect()} == {"y": 1, "x": 2}
    with pytest.raises(Exception, match="ids differ"):
        sessions.reorder_chapters(chapters, ["y"]).collect()
    facts = spark.createDataFrame([("k1", True, True), ("k2", False, True)], "fact_id string, requires_resolution boolean, is_active boolean")
    assert {r.fact_id: r.is_active for r in sessions.evict_facts(facts, ["k2"]).collect()} == {"k1": True, "k2": False}
    with pytest.raises(Exception, match="needs resolution"):
        sessions.evict_facts(facts, ["k1"]).collect()
    with pytest.raises(ValueError):
        sessions.recall_notes(facts)


def test_lookup(spark):
    q = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3"), (4, "h4")], "question_id int, question_hash string")
    e = spark.createDataFrame([(1, "h1", None, "Yes", "A", None, None, True), (2, "h2", "a", None, "B", "s", "low", True), (3, "h2", "b", None, "C", None, None, True),
                               (4, "h3", "x", None, "D", None, None, False), (5, "h4", " ", "hidden", "E", None, None, True)],
                              "entry_id int, question_hash string, model_answer string, human_answer string, identifier string, source_ref string, confidence string, is_active boolean")
    out = {r.question_id: (r.status, r.answer, r.source_ref, r.confidence) for r in catalog.authoritative_lookup(q, e).collect()}
    assert out == {1: ("Answered", "Yes", "ref:A", "high"), 2: ("Conflict", None, None, None), 3: ("NotFound", None, None, None), 4: ("Answered", " ", "ref:E", "high")}


def test_code(spark):
    text = '// class No\nclass Yes { string s = "class Str"; /* enum E */ interface IIn {} }'
    df = spark.createDataFrame([("src/Yes.cs", text)], "path string, text string")
    assert [(r.symbol_kind, r.symbol) for r in code.symbols(df).collect()] == [("class", "Yes"), ("interface", "IIn")]
    bad = spark.createDataFrame([("", "x", "replace", 3, 2, None, 0, 0), ("a", "0" * 64, "insert", None, None, 0, 1, None)],
                                "path string, original_sha256 string, operation string, start_line int, end_line int, after_line int, n_new int, n_match int")
    got = [r.errors for r in code.validate_patches(bad).collect()]
    assert got[0] == ["missing path", "bad hash", "range is wrong"] or "range is wrong" in got[0]
    assert got[1] == []


def test_files(spark, tmp_path):
    for name, body in {"a/one.cs": "x", "a/bin/two.dll": "y", "b.resx": '<root><data name="K"><value>1</value></data><data name="K"><value>2 &amp; 3</value></data><data name="C" xml:space="preserve"><value><![CDATA[<b>]]></value><comment>it&apos;s &#65;</comment></data></root>'}.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(body)
    (tmp_path / "r/big.txt").write_text("z" * 60_000)
    root = str(tmp_path / "r")
    assert sorted(r.relative for r in files.discover(spark, root).collect()) == ["a/one.cs", "b.resx"]
    assert [r.relative for r in files.discover(spark, root, ["**/*.CS"], ["b*"]).collect()] == ["a/one.cs"]
    entries = files.resx_entries(files.discover(spark, root, ["**/*.resx"])).collect()
    assert sorted((r.key, r.value, r.comment) for r in entries) == [("C", "<b>", "it's A"), ("K", "2 & 3", None)]
    rows = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "id int, t string")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(files.read_csv(spark, str(tmp_path / "csv"), "id int, t string").collect()) == sorted(rows.collect())
    files.write_archive(rows, str(tmp_path / "arc"))
    assert sorted(files.read_archive(spark, str(tmp_path / "arc"), "id int, t string").collect()) == sorted(rows.collect())
    turns = spark.createDataFrame([("o", "s", "hi")], "org string, session string, text string")
    files.append_transcript(turns, str(tmp_path / "log"))
    files.append_transcript(turns, str(tmp_path / "log"))
    schema = "org string, session string, text string"
    assert files.restore_transcript(spark, str(tmp_path / "log"), schema, "o", "s").count() == 2
    with pytest.raises(Exception, match="another session"):
        files.restore_transcript(spark, str(tmp_path / "log"), schema, "o", "t").collect()
    assert files.load_state(spark, str(tmp_path / "none"), "a int").count() == 0


def test_capped_record(spark):
    rows = [(1, "in", "a" * 50), (2, "i" * 500, "é" * 400), (3, "in", None), (4, "i" * 30, '"' * 300)]
    out = files.capped_record(spark.createDataFrame(rows, "id int, instructions string, answer string"), 200)
    got = {r.id: r for r in out.withColumn("n", F.octet_length(F.to_json(F.struct("id", "instructions", "answer")))).collect()}
    assert got[1].answer == "a" * 50 and got[3].answer is None and all(r.n <= 200 for r in got.values())
    assert got[2].answer == " [truncated]" and got[2].instructions.endswith("[truncated]")


LINES = ["event: response.output_text.delta", 'data: {"delta":"a"}', "", 'data: {"type":"response.output_text.delta","delta":{"text":"b"}}', "",
         'data: {"type":"x.output_text.delta","output_text":{"delta":{"text":"c"}}}', "event: response.completed", 'data: {"response":{"id":"r1"}}', "", "data: [DONE]", "data: late"]


def test_stream_of_events(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(LINES)] + [("t", 0, "data: open")], "stream_id string, n long, line string")
    evts = sse.events(df)
    assert {r.stream_id: r.text for r in sse.assembled(evts).collect()} == {"s": "abc", "t": ""}
    assert {r.stream_id: r.response for r in sse.completed(evts).collect()} == {"s": '{"id":"r1"}', "t": None}


def test_events_split_across_batches(spark, tmp_path):
    """Batches that cut an event in two give the events of the whole."""
    schema = "stream_id string, n long, line string"
    for k, part in enumerate([LINES[:1], LINES[1:4], LINES[4:]]):
        start = [0, 1, 4][k]
        spark.createDataFrame([("s", start + i, x) for i, x in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sse.stream_events(source).writeStream.format("memory").queryName("evts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    whole = sse.events(spark.createDataFrame([("s", i, x) for i, x in enumerate(LINES)], schema))
    assert sorted(spark.table("evts").collect()) == sorted(whole.collect())


def test_follow_changes(spark, tmp_path):
    schema = "doc_id long, seq long, deleted boolean, body string"
    batches = [[(1, 1, False, "a"), (2, 2, False, "b"), (1, 3, False, "a2")], [(2, 4, True, None), (3, 5, False, "c")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.follow_changes(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.doc_id, r.body) for r in incremental.current_state(spark, str(tmp_path / "out"), schema).collect()) == [(1, "a2"), (3, "c")]


def test_follow_changes_splits_full_buckets(spark, tmp_path):
    """Buckets stay under their limit at several sizes of the state, and a small batch rewrites few of them."""
    schema, out, most = "doc_id long, seq long, deleted boolean, body string", str(tmp_path / "out"), 40
    state, seq, buckets = {}, 0, []
    for n, ids in enumerate([range(30), range(30, 300), (5, 60, 7), range(300, 1500), (1, 2, 7), (7,)]):
        rows = []
        for i in ids:
            seq += 1
            gone = i == 7 and n in (2, 5)
            rows.append((i, seq, gone, None if gone else f"{i}.{n}"))
            state[i] = None if gone else f"{i}.{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.follow_changes(source, out, str(tmp_path / "cp"), most_rows=most).awaitTermination()
        got = {r.doc_id: r.body for r in incremental.current_state(spark, out, schema).collect()}
        assert got == {k: v for k, v in state.items() if v is not None}
        live = incremental._directory(incremental._versions(spark, out))
        sizes = [spark.read.schema(schema).parquet(f"{out}/v={v}/b=x{b}").where("NOT deleted").count() for b, v in live.items()]
        assert max(sizes) <= most and sum(2.0 ** -len(b) for b in live) == 1  # the buckets part all hashes
        buckets.append(len(live))
        assert n not in (2, 4, 5) or sum(v == n for v in live.values()) <= 3
    assert buckets[0] == 1 and buckets[1] >= 300 // most and buckets[-1] >= 1500 // most and buckets == sorted(buckets)
    # a batch that is tried again gives the same table: its own version and what it was made from are still there
    assert all(len(v) <= 2 for v in incremental._versions(spark, out).values())


def test_directory_of_split_buckets():
    assert incremental._directory({"": [0], "0": [1, 3], "1": [1], "10": [2], "11": [2]}) == {"0": 3, "10": 2, "11": 2}
    assert incremental._directory({"": [0], "0": [1], "1": [1]}, before=1) == {"": 0}
    assert incremental._split({"00": 5, "01": 5, "11": 2}, "", 5, 2) == ["00", "01", "1"] and incremental._split({"00": 9}, "", 5, 2) == ["00", "01", "1"]


def test_places_and_lags_in_large_groups(spark):
    from pyspark.sql import Window

    from skein.operators import ranks

    rows = [("hot" if i % 3 else None, (i * 7919) % 1000 // 2, i) for i in range(900)] + [("one", 5, -1)]
    df = spark.createDataFrame(rows, "g string, k int, `row` int").withColumn("p", F.lit(1))
    w = Window.partitionBy("g").orderBy("k", "row")
    want = df.select("*", F.row_number().over(w).cast("long").alias("place"), F.count("*").over(Window.partitionBy("g")).alias("n"), F.lag("k").over(w).alias("before"))
    got = ranks.with_previous(ranks.with_place(df, ["g"], ["k", "row"], total="n"), ["g"], ["k", "row"], "k", "before")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ranks.with_place(df.where("1 = 0"), ["g"], ["k"]).count() == 0
    down = {r.row: r.place for r in ranks.with_place(df, [], ["-k", "-row"]).collect()}
    order = sorted(rows, key=lambda r: (-r[1], -r[2]))
    assert all(down[r[2]] == n for n, r in enumerate(order, 1))


def test_split_needs_no_limit_of_the_share(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 10)
    plan = sessions.split_ordinal(df, ["k", "id"])._jdf.queryExecution().toString()
    assert "offset=799" not in plan and "limit=800" not in plan
    assert sessions.split_ordinal(df, ["k", "id"]).where("part = 'train'").count() == 800
    assert sessions.split_ordinal(df.where("id < 0"), ["k", "id"]).count() == 0


def test_slugs_are_unique(spark):
    names = ["a", "a", "a 2", "a", "A", "a-2-2", "", " ", "item", "b"] * 3
    items = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(names)], "i int, name string, list int")
    for scope in (None, "list"):
        taken, want = {}, {}
        for i, n in enumerate(names):
            own = taken.setdefault(i % 2 if scope else 0, set())
            base = n.strip().lower().replace(" ", "-") or "item"
            slug, k = base, 2
            while slug in own:
                slug, k = f"{base}-{k}", k + 1
            own.add(slug)
            want[i] = slug
        assert {r.i: r.slug for r in sessions.unique_slugs(items, "name", "i", scope).collect()} == want


def test_chunks_keep_rows_without_a_key(spark):
    rows = [(1, "a\nb"), (None, "c"), (None, None), (3, ""), ((1 << 62) + 1, "d")]
    got = chunks.greedy_chunks(spark.createDataFrame(rows, "k long, text string"), "k").collect()
    assert sorted((r.k is not None, r.k or 0, r.chunk) for r in got) == [(False, 0, "c"), (True, 1, "a\nb"), (True, (1 << 62) + 1, "d")]


def test_symbols_of_source(spark):
    from skein.operators import symbols

    code_text = """// license
using System;
using A.B;

namespace X.Y;

/* class Fake */
[Attr("class No")]
public abstract class Outer<T> : Base where T : new()
{
    public const string S = "enum Nope { }";
    public event Action Changed;
    public int P => 3;
    public string Q { get; set; } = "x";
    public Outer(int a) : base(a) { if (a > 0) { Run(); } }
    public static T Make<T>(Func<int, (int, int)> f) where T : class => default;
    public interface IInner { void Go(); }
    private enum Kind { A, B }
    record Pair(int L, int R);
}
struct Last { }
"""
    found = [(d.kind, d.name) for d in symbols.declarations(code_text)]
    assert found == [
        ("namespace", "X.Y"), ("class", "Outer"), ("field", "S"), ("event", "Changed"), ("property", "P"), ("property", "Q"), ("method", "Outer"), ("method", "Make"),
        ("interface", "IInner"), ("method", "Go"), ("enum", "Kind"), ("record", "Pair"), ("struct", "Last"),
    ]
    split = {s[1]: s for s in symbols.split_symbols(code_text)}
    assert split["IInner"][2:5] == ("X.Y", "Outer", "X.Y.Outer.IInner") and "enum Kind" not in split["Outer"][5] and "public int P" in split["Outer"][5]
    assert split["Outer"][5].startswith("using System;\nusing A.B;\n\nnamespace X.Y\n{\n")
    parts = list(symbols.symbol_chunks(code_text, 4096, 0))
    assert parts[0][0] == "file" and "license" in parts[0][4] and [p[1] for p in parts if p[0] == "method"] == ["Outer", "Make", "Go"]
    lines = code_text.split("\n")
    bare = [(a, b, t.split("\n", 1)[1] if k == "method" else t) for k, _, a, b, t in parts[1:]]  # a method's first line says which it is
    assert all("\n".join(lines[a - 1 : b]).startswith(t) for a, b, t in bare)
    long = "class C {\n" + "\n".join(f"  int f{i}() {{ return {i}; }}" for i in range(300)) + "\n}"
    got = symbols.with_symbol_chunks(spark.createDataFrame([("p", long), (None, " "), ("q", None), ("r", "no code")], "path string, text string"), 200).collect()
    assert {r.path for r in got} == {"p"} and all(r.tokens <= 230 for r in got) and len([r for r in got if r.symbol_kind == "method"]) == 300
    assert list(symbols.declarations("class A { void B() {")) and not list(symbols.declarations("}}}{{"))


def test_top_k_of_each_query(spark, monkeypatch):
    from skein.operators import retrieval as V

    monkeypatch.setattr(V, "POINT_BLOCK", 7)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rows = [(i, i % 4, [float((i * 7 + j * j) % 5) for j in range(6)]) for i in range(40)] + [(40, 1, [0.0] * 6), (41, None, None), (42, 1, [1.0])]
    points = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    queries = points.where("vec_id % 5 = 0 AND vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for k in (4, 50):
        got = V.top_k_each(points, queries, k).collect()
        for q in queries.collect():
            want = V.top_k(V.with_score(points.where("vec_id < 41"), q.q), k).collect()
            own = sorted((r for r in got if r.query_id == q.query_id), key=lambda r: (r.score is None, -(r.score or 0), r.vec_id))[: len(want)]
            assert [(r.vec_id, r.label, r.score) for r in own] == [(r.vec_id, r.label, r.score) for r in want]
        assert len(got) == 8 * min(k, 43)


def test_lookups_meet_whole_tables(spark, tmp_path):
    from skein.plans.relational_queries import R

    assert all("% 97" not in R.sql[q] and "% 10" not in R.sql[q] for q in ("authoritative_lookup", "authoritative_lookup_whole", "missing_ids"))
    spark.createDataFrame([(i, "src1", "en") for i in range(50)], "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,)], "item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i,) for i in range(20)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, 1), (6, 40)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert [r.matches for r in R.queries["authoritative_lookup_whole"](spark, str(tmp_path)).collect()] == [50]
    assert sorted(r.l_partkey for r in R.queries["missing_ids_whole"](spark, str(tmp_path)).collect()) == [i for i in range(20) if i != 5]


def test_packed_sections_keep_every_row(spark):
    rows = [(None, 1, 6), (None, 2, 6), ("g", None, 4), ("g", 1, 4), ("g", 1, 4), ("g", 2, None), ("h", 1, 99)]
    df = spark.createDataFrame(rows, "g string, i int, t int")
    got = [(r.g, r.i, r.t, r.section) for r in chunks.packed_sections(df, "g", "i", F.col("t"), 10).collect()]
    want = [(None, 1, 6, 1), (None, 2, 6, 2), ("g", None, 4, 1), ("g", 1, 4, 1), ("g", 1, 4, 2), ("g", 2, None, 2), ("h", 1, 99, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sample_labels_keep_null_sources(spark, tmp_path):
    from skein.plans.relational_queries import R

    spark.createDataFrame([(1, None), (2, None), (3, "a")], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = R.queries["sample_labels"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.quality, r.labelled_in_source) for r in got) == [(1, 1, 1), (2, None, 1), (3, 0, 1)]
