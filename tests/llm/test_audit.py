"""The filter audit against loops over all rows and orders."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import audit as A

from .brute import words_of
from .conftest import BASE, ROWS, prose

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(row, rows):
    t = row[1] or ""
    w, upper = words_of(t), len(re.findall("[A-Z]", t))
    repeat = any((o[1] or "") == t and None not in (o[0], row[0]) and o[0] < row[0] for o in rows)
    tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 2 * len(t), bool(re.search("[#$%&*|]", t)), repeat)
    return {f for f, x in zip("ABCDE", tests) if x}


def audited(rows, labels, filters="ABCDE", of=fails):
    """{(part, order, step): counts} by going through each order row by row."""
    out, totals = {}, {}
    for part in {r[2] or "" for r in rows}:
        own = [(of(r, rows), labels.get(r[0], (0, 0)) if r[0] is not None else (0, 0)) for r in rows if (r[2] or "") == part]
        for order in map("".join, itertools.permutations(filters)):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = [x for x in own if f in x[0]]
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(x[0] == {f} for x in own),
                    sum(x[1][0] for x in gone), sum(x[1][1] for x in gone),
                ]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in (*NAMES, "shapley")) for r in rows}
    assert len(got) == len(rows)
    return got


def labelled(spark, pairs):
    return spark.createDataFrame([(*p, "x") for p in pairs], "doc_id long, quality int, toxic int, source string")


def check(spark, rows, pairs):
    labels = {}
    for i, q, t in pairs:
        g, x = labels.get(i, (0, 0))
        labels[i] = (max(g, int(q == 1)), max(x, int(t == 1)))
    docs = spark.createDataFrame([(*r, 7, "p", "n") for r in rows], "doc_id long, text string, source string, n int, part string, mask string")
    assert found(A.audit(A.document_cells(docs.repartition(3), labelled(spark, pairs)))) == audited(rows, labels)


def test_awkward_rows(spark):
    rows = [(i, t, s) for i, t, _, s in ROWS]
    rows += [(20, BASE, "a"), (20, BASE, "c"), (21, BASE, "a"), (None, BASE, "a"), (None, "A#", "a"), (None, "A#", None), (5, prose(5, 250), "c"), (30, None, ""), (31, "", "a")]
    check(spark, rows, [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, None, 1), (12, 1, 0), (21, 0, 1), (31, 1, 1), (99, 1, 1), (None, 1, 1)])


def test_copies_across_parts_and_ids(spark):
    texts = [prose(i, 260) + ("#" if i % 2 else "") + " ABC" * (9 * (i % 3)) for i in range(6)] + ["x y " * 200, "Q" * 30]
    rows = [(i % 40, texts[(i * 7) % 8], "st"[i % 2]) for i in range(120)] + [(1000 + i, texts[0], "s") for i in range(200)]
    check(spark, rows, [(i, i % 2, int(i % 3 == 0)) for i in range(0, 1100, 3)])


def test_empty_table(spark, none):
    assert A.audit(A.document_cells(none, labelled(spark, []))).count() == 0


@pytest.mark.parametrize("filters", ["x", "ba", "pqrs"])
def test_any_filters(spark, filters):
    """Cells of other filters than those of the query."""
    masks = [(f"p{i % 2}", i % (1 << len(filters)), 1 + i, i % 3, i % 2) for i in range(40)]
    cells = spark.createDataFrame(masks, "part string, mask int, n long, good long, toxic long")
    cells = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    got = found(A.audit(cells, filters))
    bit = {f: 1 << i for i, f in enumerate(filters)}
    for (part, order, step), counts in got.items():
        own, before = bit[order[step - 1]], sum(bit[f] for f in order[: step - 1])
        of = [m for m in masks if m[0] == part]
        gone = [m for m in of if m[1] & own and not m[1] & before]
        assert counts[0] == sum(m[2] for m in of if not m[1] & (own | before))
        assert counts[1] == sum(m[2] for m in gone) and counts[4:6] == (sum(m[3] for m in gone), sum(m[4] for m in gone))
    assert len(got) == 2 * len(filters) * len(list(itertools.permutations(filters)))


def test_refuses_other_filters(spark):
    for filters in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            A.audit(spark.range(0), filters)
