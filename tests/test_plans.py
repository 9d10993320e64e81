"""Every registered query with an oracle gives the oracle's rows."""

import math

import pytest

from chunkloom.plans import REGISTRY
from tests.conftest import SF


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return v

    return sorted((tuple(str(value(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if e.sql])
def test_query_matches_its_oracle(spark, duck, name):
    entry = REGISTRY[name]
    got = entry.run(spark, SF)
    want = duck.execute(entry.sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if not e.sql])
def test_query_without_oracle_runs(spark, name):
    assert REGISTRY[name].run(spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).collect()[0]
    assert row["n_files"] == 200 and row["logical_bytes"] >= row["unique_bytes"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down(spark):
    """A two-column plan reads two columns; a filter reaches the scan."""
    plan = REGISTRY["owner_isolation"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan
    assert "lang" not in plan


def every_text():
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: len(r["text"].encode()) for r in rows if r["text"] is not None}


def test_gzip_files_of_several_members(spark):
    import gzip

    got = {r["id"]: (r["members"], r["plain_size"]) for r in REGISTRY["gzip_members"].run(spark, SF).collect()}
    texts = every_text()
    assert {k: n for k, (_, n) in got.items()} == texts and gzip.decompress(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"
    assert sum(m > 1 for m, _ in got.values()) > len(got) // 4


def mixed_meta(spark):
    """chunk -> (base, ref_count, stored_size)."""
    from chunkloom.sources.catalog import chunk_meta

    return {r["chunk"]: (r["base"], r["ref_count"], r["stored_size"]) for r in chunk_meta(spark, SF).collect()}


def test_dead_deltas_release_their_bases(spark):
    meta = mixed_meta(spark)
    dead = todo = {c for c, (_, n, _) in meta.items() if n == 0}
    while todo:
        todo = {meta[c][0] for c in todo if meta[c][0] in meta and meta[meta[c][0]][1] <= 1} - dead
        dead = dead | todo
    got = [r["chunk"] for r in REGISTRY["cascade_to_bases"].run(spark, SF).collect()]
    assert sorted(got) == sorted(dead) and len(dead) > sum(n == 0 for _, n, _ in meta.values())


def test_cascades_have_no_depth_limit(spark):
    from chunkloom.plans.maintenance import _dead

    chain = spark.createDataFrame([(i, i - 1 if i else None, 0 if i == 14 else 1) for i in range(15)] + [(20, 21, 0), (21, 20, 1)], "chunk long, base long, ref_count long")
    assert sorted(r["chunk"] for r in _dead(chain).collect()) == [*range(15), 20, 21]


def test_zombies(spark):
    meta = mixed_meta(spark)
    kids = {}
    for base, _, size in meta.values():
        if base is not None:
            kids.setdefault(base, []).append(size)
    want = {(c, len(k)) for c, k in kids.items() if c in meta and c % 8 == 3 and meta[c][1] == len(k)}
    assert {tuple(r) for r in REGISTRY["zombie_chunks"].run(spark, SF).select("chunk", "kids").collect()} == want != set()
    grown = {(c, meta[c][0], n, sum(s // 8 for s in kids[c]), meta[c][2]) for c, n in want}
    want = {r for r in grown if r[3] < r[4]}
    assert {tuple(r) for r in REGISTRY["zombie_rescue"].run(spark, SF).select("chunk", "onto", "children", "growth", "freed").collect()} == want != set()
