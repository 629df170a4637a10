"""Every query of the catalogue at the smallest scale; those with SQL must agree with it."""

import pytest

from gramtrail.plans.catalogue import ORACLES, QUERIES

from .conftest import DATA, agree


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    if name in ORACLES:
        agree(df, duck, ORACLES[name])
    else:
        assert df.columns and df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 78
    assert set(e.oracle_sql()) <= set(e.queries())


def test_content_hashes(spark):
    """FNV-1a byte by byte, where SQL is too slow on whole tables."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.fnv for r in QUERIES["content_fnv"](spark, str(DATA)).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:60]:
        h = 0xCBF29CE484222325
        for b in (texts[i] or "").encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        assert texts[i] is None or got[i] == f"{h:016x}"
