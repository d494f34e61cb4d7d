"""Every query with SQL gives the SQL's rows; the others give rows."""

import duckdb
import pytest

from seqloom.plans.registry import FLAGSHIP, QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    there = [c[0] for c in cursor.description]
    assert sorted(there) == names
    assert got == sorted((tuple(plain(r[there.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)


def test_next_bit_checks_are_whole(spark):
    rows = QUERIES["next_bit_checks"](spark, DATA).collect()
    grid = {(m, w, d) for m in ("bit", "block") for w in (8, 16, 32) for d in ("fwd", "bwd")}
    for clip in {r["clip"] for r in rows}:
        own = [r for r in rows if r["clip"] == clip]
        assert len(own) == 12 and {(r["mode"], r["w"], r["dir"]) for r in own} == grid
    assert rows and all(r["delta"] is not None and r["n_test"] >= 200 for r in rows)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
