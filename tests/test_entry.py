"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(int(v)) if "bool" in type(v).__name__ else str(v)


def same_rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert len(oracles) >= 0.9 * len(queries) - 6


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["trip_id", "seq", "label", "kept"] and df.count() == 500


#: Queries of the library itself; those of other subpackages have tests of their own.
OWN = list(entry.catalog.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, duck, name):
    assert same_rows(entry.queries()[name](spark, SF).toPandas()) == same_rows(duck.execute(entry.oracle_sql()[name]).df())


def test_pairs_are_found(spark):
    """Of every layer, so that the comparisons above are of something."""
    queries = entry.queries()
    for name in ("j3_hash_pairs", "d11_cosine_pairs", "j12_strict_gray_pairs"):
        assert queries[name](spark, SF).count() > 10
    found = {r.source for r in queries["j13_pair_evidence"](spark, SF).select("source").distinct().collect()}
    assert found == {"hash", "tiered", "gray"}


@pytest.mark.parametrize("kind", ["fade", "crossfade"])
def test_every_segment_has_a_transition(spark, kind):
    n = entry.queries()["n2_segment_boundaries"](spark, SF).count()
    assert entry.queries()[f"n8_{kind}_transitions_whole"](spark, SF).count() == n > entry.queries()[f"n8_{kind}_transitions"](spark, SF).count()


def test_segments_are_chosen(spark):
    """Videos of every kind of target and plan, fewer segments than there are candidates, and neighbours of like score."""
    queries, d = entry.queries(), "/root/testdata/sf0.01"
    assert {r.target for r in queries["n5_target_durations"](spark, d).collect()} == {0.0, 60.0, 300.0}
    chosen, possible, alone = ({tuple(r) for r in queries[n](spark, d).collect()} for n in ("n6_segment_selection", "n6_segment_candidates", "f9_filled_to_target"))
    assert chosen < possible and len(chosen) < 0.6 * len(possible)
    assert not alone <= chosen  # neighbours that are drawn in take the place of better ones
    assert {r.plan for r in queries["n7_edit_plans"](spark, d).collect()} == {"keep", "compile", "error"}
    assert queries["d18_adjacent_segments"](spark, d).count() > 1000


SEGMENTS = """n11_upserted_segments n16_videos_kept_whole n10_reselected_all s6_edited_videos n15_videos_after_proxy n6_segment_selection
n7_edit_plans s6_edited_to_target s7_segments_by_sql b10_segment_details b6_segment_rows_defaults""".split()


@pytest.mark.parametrize("name", SEGMENTS)
def test_no_task_holds_all_segments(spark, name):
    """A table whose file is small is broadcast in joins, and is then whole in every task; a video's rows lie in a task of their own number."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "REPARTITION_BY_NUM" in plan


def test_pictures_are_few_in_a_task(spark, tmp_path, monkeypatch):
    """However many there are, so that no task's time or batch grows with the table."""
    from winnow.sources import adapters

    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(adapters, "PICTURES", 50, raising=False)
    got = adapters.pictures(spark, str(tmp_path), 4, 4, 3)
    assert got.rdd.getNumPartitions() == 10
    assert max(got.rdd.glom().map(len).collect()) < 100
