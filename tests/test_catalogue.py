"""Each registered query against its SQL, over the smallest tables."""

from pathlib import Path

import pytest

from skein.plans import catalogue

SMALLEST = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not SMALLEST.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    rows = catalogue.QUERIES[name](spark, str(SMALLEST))
    if name not in catalogue.ORACLE_SQL:
        assert rows.count() > 0
        return
    with duckdb.connect() as con:
        for t in SMALLEST.glob("*.parquet"):
            con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
        want = con.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(rows.columns)
        order = sorted(names)
        key = lambda r: [(x is not None, str(x)) for x in r]
        theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in want.fetchall()), key=key)
    ours = sorted(([plain(r[c]) for c in order] for r in rows.collect()), key=key)
    assert ours == theirs
