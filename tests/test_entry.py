import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names_of_queries_and_sql():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.entity_f1 <= r.entity_partial_f1 <= 1 for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["e2_exact_entity_scores", "g16_headroom", "r1_split", "e13_documents_from_sentences", "g53_tagged_audit"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    mine, theirs = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    as_rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert as_rows(mine) == as_rows(theirs)
