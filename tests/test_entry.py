"""The driver's contract."""

import __spark_entry__ as entry
import duckdb
import pytest
from siftline.plans import queries


def test_names_and_sql():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(queries.QUERIES) > 50
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", ["all_findings", "ignored_counts", "tagger_confirms", "findings_cube", "stream_first_seen", "lateral_scan", "crypto_findings", "suppress_by_rule_table", "confirm_by_overlap"])
def test_against_sql(spark, name, tmp_path):
    rows = [(1, "mail a@b.org 8.8.8.8\nssn 123-45-6789", "en", "s"), (2, None, "de", "s"), (3, "clean", None, "t"), (4, "http://a.example.com/x a@b.org 17VZNX1SN5NtKa8UQFxwQbFeFc3iqRYhem 17VZNX1SN5NtKa8UQFxwQbFeFc3iqRYhen", "en", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity_type", "n", "n_files"]
