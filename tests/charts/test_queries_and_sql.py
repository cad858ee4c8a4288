"""Queries against their SQL on tables with what the small test tables lack."""

import duckdb
import pytest
from skeinframe.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", ["a14_nearest_cluster", "a14_vote_cells"])
def test_white_pixels(spark, tmp_path, name):
    """Plain white belongs to no cluster, whatever lies near."""
    rows = [(i, [0.1 * ((p * (i + 3)) % 11) - 0.5 if p % 5 else 0.5 + 0.001 * i for p in range(64)]) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if name == "a14_nearest_cluster":
        assert {x[2] for x in want} > {-1}


def test_collisions_of_copies(spark, tmp_path):
    """All pairs of one brand's threads, of one colour too: not only those with the colour's first thread."""
    keys = [*range(256)] + [3 + 256 * i for i in range(1, 12)] + [256 * (20 + i) + k for k in range(256) for i in range(2)]
    rows = [(k, f"thread {k}", "Brand#1", "SMALL") for k in keys] + [(100_003 + 256 * i, "x", "Brand#2", "LARGE") for i in range(9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["j6_thread_collisions"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['j6_thread_collisions']})").fetchall()
    found = list(map(tuple, got.collect()))
    assert sorted(found) == sorted(want)
    same = {(x[1], x[2]) for x in found if x[0] == "brand#1" and x[3] == 0}
    assert same == {(str(a), str(b)) for a in keys for b in keys if a < b and (a - b) % 256 == 0}
    assert sum(x[0] == "brand#2" for x in found) == 9 * 8 // 2 and max(x[3] for x in found) > 0
