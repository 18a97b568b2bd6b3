"""Every registered image and catalog query: those with SQL against DuckDB, the others for shape and errors."""

import hashlib

import duckdb
import pytest

from sheetspark.operators import images
from sheetspark.queries import ORACLES, QUERIES
from sheetspark.sources import synthetic

FEW = {"a10_sharpest_tilt", "a11_suggest_straightening"}  # on some images only, as their SQL takes long


@pytest.mark.parametrize("name", sorted(set(ORACLES) - FEW))
def test_query_equals_sql(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(FEW))
def test_query_equals_sql_on_some_images(name, spark, sf, tmp_path, same):
    spark.read.parquet(f"{sf}/pages.parquet").where("page_id < 12").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    few = duckdb.connect()
    few.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(QUERIES[name](spark, str(tmp_path)), few.sql(ORACLES[name]))


def test_acts_on_pictures_do_something(spark, sf):
    """Each of these would fail if its act returned what it was given."""
    rows = QUERIES["p9_p22_resize"](spark, sf).collect()
    assert all((r["width"], r["height"], r["small_width"], r["small_height"]) == (450, 600, 400, 533) for r in rows)
    assert len({r["digest"] for r in rows}) > 20
    assert all(r["rebuilt_bytes"] < 0.9 * r["bytes"] for r in QUERIES["h1_rebuilt_tables"](spark, sf).collect())
    best = {r["image_id"]: hashlib.md5(r["jpeg"]).hexdigest() for r in images.encode(synthetic.photos(synthetic.image_ids(spark, sf)), 85, keep=["image_id"]).collect()}
    assert {r["image_id"]: r["digest"] for r in QUERIES["h1_rebuilt_tables"](spark, sf).collect()} == best


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    if "error" in rows[0].asDict():
        assert all(r["error"] is None for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_optional_modules(spark, monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def missing(name, *rest):
        if name in ("sheetspark.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(name=name)
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert set(entry.queries()) == set(QUERIES)
