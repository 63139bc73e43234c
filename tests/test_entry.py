import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from biblioflow.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
CHEAP = ("parse_apa", "parse_tail", "dedupe", "format_styles", "export_ris", "edit_fields", "text_stats", "strip_furniture", "line_signals", "split_numbered", "style_vote", "accuracy_tally")


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, SF)
    want = db.sql(ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda got, names: sorted((tuple(dict(zip(names, r, strict=True))[c] for c in order) for r in got), key=repr)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
