"""Registered detection queries against their SQL, and the entry module without the corpus subpackage."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from ruleloom import queries as detection

FOLDER = "/root/testdata/sf0.001"
SOME = ["sel_not_filter", "contains_wildcard", "regex", "nested_parens", "not_compound_missing", "coercions", "null_vs_missing", "ruleset_evaluate", "running_avg_threshold", "sliding_sum", "tumbling_count", "rule_aggregation", "dlq_malformed"]


def _plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row) for row in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    assert _plain(detection.QUERIES[name](spark, FOLDER).toPandas()) == _plain(con.execute(detection.SQL[name]).df())


def test_every_detection_query_has_sql():
    assert set(detection.QUERIES) == set(detection.SQL)


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
