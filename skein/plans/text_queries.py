"""Queries over text functions, scores and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import python as P
from ..functions import text as T
from ..operators import chunks, scoring
from .registry import Registry, read, spread

R = Registry()
_W, _C = T.WHITE, T.WORD


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{_W}]+|[{_W}]+$', '', 'g')"


MODELS = ["the", "anon", "enre"]


def _tokens(c: str) -> str:
    t = _trim(c)
    return f"""CASE WHEN coalesce({t} = '', true) THEN 0 ELSE greatest(
      ceil((length({c}) - len(regexp_extract_all({c}, '[{T.CJK}]'))) / 4.0) + len(regexp_extract_all({c}, '[{T.CJK}]'))
        + coalesce(list_sum(list_transform(regexp_extract_all({c}, '{T.URL}'), lambda u: greatest(8, ceil(length(u) / 3.0)))), 0)
        + ceil(len(regexp_extract_all({c}, '[^{_C}{_W}]')) / 3.0),
      ceil(len(regexp_extract_all({c}, '[{_C}]+')) * 0.7::DOUBLE)) + 2 END::BIGINT"""


@R.add("text_estimate_tokens", f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def text_estimate_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@R.add("hash_crlf", r"SELECT doc_id, sha256(regexp_replace(text, '\r\n|\r|\n', chr(13) || chr(10), 'g')) AS hash FROM documents")
def hash_crlf(spark, d):
    return read(spark, d, "documents").select("doc_id", T.file_hash("text").alias("hash"))


@R.add("hash_code", r"""SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE sha256(list_aggregate(list_transform(
    string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)), lambda x: substr(x, 1, 500) || chr(10)), 'string_agg', '')) END AS hash,
    octet_length(encode(text))::BIGINT AS n_bytes FROM documents""")
def hash_code(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", T.code_hash("text").alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))


_NS = T.DOC_NAMESPACE.replace("-", "")


@R.add("doc_id_uuid5", f"""WITH n AS (SELECT doc_id, 'https://host/repo|' || lower('/' || source || '/docs/' || doc_id || '.MD') AS name FROM documents),
  h AS (SELECT doc_id, sha1(unhex('{_NS}') || encode(name)) AS h FROM n)
  SELECT doc_id, upper(substr(h, 1, 12) || '5' || substr(h, 14, 3)
    || substr('89AB', ((('0x' || substr(h, 17, 1))::INTEGER) % 4 + 1), 1) || substr(h, 18, 15)) AS uid FROM h""")
def doc_id_uuid5(spark, d):
    path = F.concat(F.lit("docs//"), F.col("doc_id"), F.lit(".MD"))
    return read(spark, d, "documents").select("doc_id", T.doc_id(F.lit("https://HOST/repo/"), F.col("source"), path).alias("uid"))


@R.add("normalize_route", rf"""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(
      {_trim("url")}, '(?s)\?.*$', ''), '\', '/'), '/+', '/', 'g'), '\{{[^}}]+\}}', '{{x}}', 'g'), '(.)/+$', '\1') AS r FROM pages)
  SELECT page_id, lower(CASE WHEN NOT starts_with(r, '/') AND contains(r, '/') THEN '/' || r ELSE r END) AS route FROM r""")
def normalize_route(spark, d):
    return read(spark, d, "pages").select("page_id", T.normalize_route("url").alias("route"))


_SLUG = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_trim('p_name')}), '[{_W}]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@R.add("slugify", f"SELECT p_partkey, {_SLUG} AS slug FROM part")
def slugify(spark, d):
    return read(spark, d, "part").select("p_partkey", T.slugify("p_name").alias("slug"))


@R.add("normalize_question", rf"""WITH q AS (SELECT item_id, lower(regexp_replace(replace({_trim("text")}, '`', ''), '[{_W}]+', ' ', 'g')) AS question FROM benchmark)
  SELECT item_id, question, sha256(question) AS hash FROM q""")
def normalize_question(spark, d):
    out = read(spark, d, "benchmark").select("item_id", T.normalize_question("text").alias("question"))
    return out.withColumn("hash", T.sha256_hex("question"))


@R.add("applies_to", rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text,
    '[{_C}]+(?:\.[{_C}]+)*'), lambda x: regexp_matches(x, '{T.APPLIES}')), lambda x: lower(x))))[1:50], ',') AS tokens FROM documents""")
def applies_to(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(T.applies_to("text"), ",").alias("tokens"))


@R.add("html_text_regex", rf"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'),
      '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
  SELECT page_id, {_trim(f"regexp_replace(regexp_replace(t, '[' || chr(13) || chr(10) || chr(9) || ']+', ' ', 'g'), '[{_W}]{{2,}}', ' ', 'g')")} AS text FROM s""")
def html_text_regex(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_to_text("html").alias("text"))


@R.add("html_text_unescaped")
def html_text_unescaped(spark, d):
    return spread(read(spark, d, "pages").select("page_id", "html")).select("page_id", P.unescape_html(T.html_to_text("html")).alias("text"))


@R.add("html_text_dom")
def html_text_dom(spark, d):
    return spread(read(spark, d, "pages").select("page_id", "html")).select("page_id", P.html_text_dom("html").alias("text"))


@R.add("canonical_json")
def canonical_json(spark, d):
    return read(spark, d, "events").select("event_id", P.canonical_json("props").alias("canonical"))


@R.add("language_from_path", r"""WITH e AS (SELECT page_id, lower(regexp_extract(url, '\.([^./\\]+)$', 1)) AS e FROM pages)
  SELECT page_id, CASE e WHEN 'cs' THEN 'csharp' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python'
    WHEN 'html' THEN 'html' WHEN 'css' THEN 'css' WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml' WHEN 'sql' THEN 'sql' ELSE 'plaintext' END AS language FROM e""")
def language_from_path(spark, d):
    return read(spark, d, "pages").select("page_id", T.language_from_path("url").alias("language"))


@R.add("storage_keys", """SELECT doc_id, CASE WHEN coalesce(trim(source) = '', true) THEN '_' ELSE translate(source, '/\\#?', '____') END AS safe,
    coalesce(source, '') || '|' || coalesce(lang, '') AS partition_key, lower(concat_ws(':', source, lang, doc_id::VARCHAR)) AS chunk_id,
    least(greatest(floor(2500000 / (28 * (doc_id % 3072 + 1) + 2000.0)), 8), 128)::INTEGER AS batch FROM documents""")
def storage_keys(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(
        "doc_id", T.table_safe("source").alias("safe"), T.joined_key("source", "lang").alias("partition_key"),
        T.chunk_id("source", "lang", F.col("doc_id").cast("string")).alias("chunk_id"), T.batch_size(F.col("doc_id") % 3072 + 1).alias("batch"),
    )


@R.add("truncate_utf8", """WITH h AS (SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE left(text, list_max(list_filter(range(250, 1001), lambda n: strlen(left(text, n)) <= 1000))) END AS head FROM documents)
  SELECT doc_id, head, strlen(head)::INTEGER AS n_bytes FROM h""")
def truncate_utf8(spark, d):
    out = read(spark, d, "documents").select("doc_id", T.truncate_utf8("text", 1000).alias("head"))
    return out.withColumn("n_bytes", F.octet_length("head"))


@R.add("slice_lines", """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM documents""")
def slice_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", T.slice_lines("text", 2, 4).alias("lines"))


def _has(model: str) -> str:
    return f"regexp_matches(lower(t), '(?:^|[^{_C}]){model}(?:[^{_C}]|$)')"


_SCORES = f"""
WITH a AS (SELECT doc_id, lang, coalesce({_trim("text")}, '') AS t FROM documents),
b AS (SELECT *, length(t) AS n, len(string_split(t, chr(10))) AS lines, greatest(len(regexp_extract_all(t, '[.!?]')), 1) AS sent,
    len(regexp_extract_all(t, '[{{}};()\\[\\]<>]')) AS code, list_filter(regexp_split_to_array(t, '[{_W}]+'), lambda x: x <> '') AS toks,
    [m for m in [{", ".join(f"CASE WHEN {_has(m)} THEN '{m}' END" for m in MODELS)}] if m IS NOT NULL] AS models FROM a),
c AS (SELECT *, list_filter(list_transform(toks, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: length(x) >= 4) AS words,
    len(list_filter(toks, lambda x: regexp_matches(x, '//|/\\*|\\*/|\\p{{Nd}}|;|=>|namespace|class'))) AS noisy,
    len(list_filter(toks, lambda x: list_contains(['provision', 'register', 'embed', 'index'], lower(x)))) > 0 AS verb,
    len(list_filter(toks, lambda x: list_contains(['manager', 'service', 'tool', 'primitive'], lower(x)))) > 0 AS role FROM b),
d AS (SELECT *, CASE WHEN len(words) > 0 THEN len(list_distinct(words))::DOUBLE / len(words) END AS ratio,
    CASE WHEN len(toks) > 0 THEN noisy::DOUBLE / len(toks) END AS nr, CASE WHEN n > 0 THEN code::DOUBLE / n END > 0.15 AS coded FROM c),
e AS (SELECT *, CASE WHEN n > 0 THEN greatest(100.0 - CASE WHEN n < 40 THEN 40.0 ELSE 0 END - CASE WHEN sent <= 1 AND n > 120 THEN 15.0 ELSE 0 END
      - CASE WHEN lines = 1 AND n > 120 THEN 10.0 ELSE 0 END - CASE WHEN coded THEN 25.0 ELSE 0 END, 0)::DOUBLE END AS clarity,
    CASE WHEN n > 0 THEN CASE WHEN ratio IS NULL THEN 60.0 WHEN ratio > 0.7::DOUBLE THEN 55.0 WHEN ratio > 0.4::DOUBLE THEN 75.0 ELSE 90.0 END::DOUBLE END AS cohesion,
    CASE WHEN n > 0 THEN CASE len(models) WHEN 0 THEN 40.0 WHEN 1 THEN 80.0 ELSE 95.0 END::DOUBLE END AS anchoring,
    CASE WHEN n > 0 THEN (1.0::DOUBLE - nr) * 100.0::DOUBLE END AS noise,
    CASE WHEN n > 0 THEN (40.0 + CASE WHEN n >= 80 THEN 15 ELSE 0 END + CASE WHEN n >= 160 THEN 15 ELSE 0 END + CASE WHEN sent >= 2 THEN 10 ELSE 0 END
      + CASE WHEN len(models) > 0 THEN 10 ELSE 0 END + CASE WHEN verb THEN 10 ELSE 0 END)::DOUBLE END AS coverage,
    CASE WHEN n > 0 THEN (50.0 + CASE WHEN verb THEN 15 ELSE 0 END + CASE WHEN role THEN 15 ELSE 0 END)::DOUBLE END AS alignment FROM d),
f AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(greatest(clarity * 0.25::DOUBLE + cohesion * 0.25::DOUBLE + anchoring * 0.2::DOUBLE + noise * 0.1::DOUBLE
      + coverage * 0.1::DOUBLE + alignment * 0.1::DOUBLE, 0), 100) END AS composite FROM e),
s AS (SELECT *, CASE WHEN composite >= 85 THEN 'Excellent' WHEN composite >= 70 THEN 'Good' WHEN composite >= 60 THEN 'Fair' WHEN composite >= 40 THEN 'Poor' ELSE 'Reject' END AS category,
    CASE WHEN n = 0 THEN 'EmptyText' ELSE concat_ws(',', CASE WHEN n < 40 THEN 'VeryShortText' END, CASE WHEN sent <= 1 AND n > 120 THEN 'SingleLongSentence' END,
      CASE WHEN lines = 1 AND n > 120 THEN 'SingleLineBlock' END, CASE WHEN coded THEN 'CodeLikeStructure' END, CASE WHEN ratio IS NULL THEN 'NoContentWords' END,
      CASE WHEN ratio > 0.7::DOUBLE THEN 'HighWordDiversity' END, CASE WHEN len(models) = 0 THEN 'NoDomainModelsDetected' END, CASE WHEN nr > 0.3::DOUBLE THEN 'HighNoise' END,
      CASE WHEN coverage < 60 THEN 'LowCoverage' END, CASE WHEN alignment < 60 THEN 'LowQueryAlignment' END) END AS flags FROM f)
"""
_DIMS = list(scoring.WEIGHTS)


@R.add("score_sections", _SCORES + f"SELECT doc_id, {', '.join(f'round({k}, 6) AS {k}' for k in _DIMS)}, round(composite, 6) AS composite, category, flags, array_to_string(models, ',') AS models FROM s")
def score_sections(spark, d):
    out = scoring.score_sections(spread(read(spark, d, "documents")), MODELS)
    return out.select(
        "doc_id", *[F.round(k, 6).alias(k) for k in _DIMS], F.round("composite", 6).alias("composite"), "category",
        F.array_join("flags", ",").alias("flags"), F.array_join("matched_models", ",").alias("models"),
    )


@R.add("score_gate", _SCORES + "SELECT lang, CASE WHEN composite >= 60 THEN 'Accepted' ELSE 'RejectedLowScore' END AS gate, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def score_gate(spark, d):
    out = scoring.score_sections(spread(read(spark, d, "documents")), MODELS)
    return out.groupBy("lang", scoring.publish_gate("composite").alias("gate")).agg(F.count("*").alias("n"))


@R.add("match_models", f"WITH a AS (SELECT doc_id, {_trim('text')} AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS model FROM a WHERE {_has(m)}" for m in MODELS))
def match_models(spark, d):
    t = T.trim_white("text")
    hits = F.array_compact(F.array(*[F.when(scoring.model_in_text(t, m), F.lit(m)) for m in MODELS]))
    return read(spark, d, "documents").select("doc_id", F.explode(hits).alias("model"))


@R.add("type_token_ratio", f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[{_C}]+'), lambda x: lower(x)) AS w FROM documents)
  SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct, round(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 6) AS ratio FROM w""")
def type_token_ratio(spark, d):
    w = read(spark, d, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(f"([{_C}]+)"), F.lit(1)), lambda x: F.lower(x)).alias("w"))
    n, k = F.size("w"), F.size(F.array_distinct("w"))
    return w.select("doc_id", n.cast("long").alias("n_words"), k.cast("long").alias("n_distinct"), F.round(F.try_divide(k.cast("double"), n), 6).alias("ratio"))


@R.add("chunks_fixed", """WITH a AS (SELECT doc_id, text, greatest(ceil((length(text) - 400) / 300.0), 0)::INTEGER + 1 AS total FROM documents WHERE length(text) > 0),
  b AS (SELECT *, unnest(range(1, total + 1))::INTEGER AS part FROM a)
  SELECT doc_id, part, total, ((part - 1) * 300 + 1)::INTEGER AS start, length(substr(text, (part - 1) * 300 + 1, 400))::INTEGER AS n_chars, md5(substr(text, (part - 1) * 300 + 1, 400)) AS hash FROM b""")
def chunks_fixed(spark, d):
    out = chunks.fixed_windows(read(spark, d, "documents").select("doc_id", "text"), 400, 100)
    return out.select("doc_id", "part", "total", "start", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("hash"))


@R.add("chunk_line_offsets", """WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
  b AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS line FROM a)
  SELECT doc_id, line::INTEGER AS line, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char,
    length(x)::INTEGER AS n_chars FROM b""")
def chunk_line_offsets(spark, d):
    return chunks.line_offsets(read(spark, d, "documents"), "doc_id")


@R.add("chunks_greedy")
def chunks_greedy(spark, d):
    out = chunks.greedy_chunks(read(spark, d, "documents"), "doc_id", budget=256)
    return out.withColumn("hash", F.md5(F.col("chunk").cast("binary"))).drop("chunk")


@R.add("markdown_sections", f"""WITH p AS (SELECT page_id, string_split(regexp_replace(html, '(?i)<p>', chr(10) || '### ', 'g'), chr(10) || '### ') AS l FROM pages),
  b AS (SELECT page_id, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i > 1 THEN '### ' ELSE '' END || l[i] || CASE WHEN i < len(l) THEN chr(10) ELSE '' END), lambda x: regexp_matches(x, '[^{_W}]')) AS b FROM p),
  u AS (SELECT page_id, unnest(b) AS body, unnest(range(0, len(b))) AS section FROM b)
  SELECT page_id, section::INTEGER AS section, trim(regexp_extract(body, '^###[ \\t]+([^\\n]*)', 1)) AS header, length(body)::INTEGER AS n_chars FROM u""")
def markdown_sections(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.regexp_replace("html", r"(?i)<p>", "\n### ").alias("text"))
    return chunks.markdown_sections(pages).select("page_id", "section", "header", F.length("body").alias("n_chars"))


@R.add("packed_sections", f"""WITH RECURSIVE a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
  u AS (SELECT doc_id, unnest(l) AS t, unnest(range(0, len(l))) AS line FROM a), n AS (SELECT doc_id, line, {_tokens('t')} AS tokens FROM u),
  f AS (SELECT doc_id, line, 1 AS section, tokens AS used FROM n WHERE line = 0 UNION ALL
    SELECT n.doc_id, n.line, CASE WHEN used > 0 AND used + tokens > 6500 THEN section + 1 ELSE section END, CASE WHEN used > 0 AND used + tokens > 6500 THEN tokens ELSE used + tokens END
    FROM f JOIN n ON n.doc_id = f.doc_id AND n.line = f.line + 1)
  SELECT doc_id, line::INTEGER AS line, section::INTEGER AS section FROM f""")
def packed_sections(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    rows = lines.select("doc_id", "line", T.estimate_tokens("text").alias("tokens"))
    return chunks.packed_sections(rows, "doc_id", "line", F.col("tokens")).select("doc_id", "line", "section")


@R.add("section_parts", """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS part, count(*) OVER (PARTITION BY source)::BIGINT AS total FROM documents""")
def section_parts(spark, d):
    return chunks.part_totals(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")
