"""Token counts against the libraries themselves."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import token_counts as T
from skein.llm.tokens import encoder, parts_of, tokenizer_path

from .conftest import ROWS, prose
from .test_tokens_packing import PIECES

tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def library(name):
    """Tokens of a whole text by one plain call."""
    path = tokenizer_path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    whole = tokenizers.Tokenizer.from_file(path)
    return lambda t: len(whole.encode(t, add_special_tokens=False).ids)


PLAIN = {n: library(n) for n in FILES}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, "a b", "word word ", "x1 2y"]), max_size=30).map("".join), min_size=1, max_size=5), st.integers(1, 40))
def test_counts_of_split_texts(texts, most):
    for n in FILES:
        sizes, tokens = T.count_array(pa.array([*texts, None, ""]), encoder(tokenizer_path(n)), most)
        assert tokens.tolist() == [PLAIN[n](t) for t in texts] + [0, 0]
        assert sizes.tolist() == [len(t.encode()) for t in texts] + [0, 0]


@given(st.lists(st.sampled_from([b"a", b" ", b"  ", b"b1", b", ", b"\xc3\xa9"]), max_size=60).map(b"".join), st.integers(1, 20))
def test_parts_make_the_text(text, most):
    parts = list(parts_of(text, most))
    assert b"".join(parts) == text
    assert all(p[0] == 0x20 and p[1:2].isalnum() for p in parts[1:])
    longer = [p for p in parts if len(p) > most]
    assert all(not any(p[i - 1 : i].isalnum() and p[i + 1 : i + 2].isalnum() for i in range(1, most + 1) if p[i : i + 1] == b" ") for p in longer)


def test_groups_balance_bytes():
    sizes = np.array([1] * 500 + [300_000] + [10] * 5000)
    groups = T.byte_groups(sizes, 100_000)
    assert [a for a, _ in groups] == [0, *[b for _, b in groups[:-1]]] and groups[-1][1] == len(sizes)
    assert sum(sizes[a:b].sum() > 200_000 for a, b in groups) == 1
    assert T.byte_groups(np.zeros(0)) == [] and T.byte_groups(np.zeros(3)) == [(0, 3)]


@pytest.mark.parametrize("name", FILES)
def test_documents(spark, docs, none, name):
    rows = T.count_tokens(docs.withColumnRenamed("size", "n_tokens"), tokenizer_path(name), limit=100)
    assert rows.columns == ["doc_id", "text", "lang", "source", "block", "score", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect())
    want = [(PLAIN[name](t or ""), len((t or "").encode())) for _, t, *_ in ROWS]
    assert got == sorted((str(r[0]), b, n, n > 100) for r, (n, b) in zip(ROWS, want))
    assert T.count_tokens(none, tokenizer_path(name)).count() == 0


def test_only_text_and_long_texts(spark):
    long = " ".join([prose(3, 20_000), "<|endoftext|>", "x" * 5000, prose(4, 200_000)])
    rows = T.count_tokens(spark.createDataFrame([(long,), (None,)], "text string"), tokenizer_path(FILES[0])).collect()
    assert sorted(r.n_tokens for r in rows) == [0, PLAIN[FILES[0]](long)]
    assert len(long.encode()) > T.BATCH


def test_query_counts_whole_table(spark):
    rows = T.op11_token_counts(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len((r.text or "").encode()), PLAIN[FILES[0]](r.text or "")) for r in table}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(table)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
