"""Queries against their SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.functions import text as tx
from quirework.plans import catalog, editions, queries, scans, spans, works

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(float(v[i]), 6)) if isinstance(v[i], (int, float)) and not isinstance(v[i], bool) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE | catalog.ORACLE | spans.ORACLE | works.ORACLE | editions.ORACLE | scans.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    got = (queries.QUERIES | catalog.QUERIES | spans.QUERIES | works.QUERIES | editions.QUERIES | scans.QUERIES)[name](spark, SF)
    want = con.execute((queries.ORACLE | catalog.ORACLE | spans.ORACLE | works.ORACLE | editions.ORACLE | scans.ORACLE)[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_landmarks_against_brute_force(spark):
    keys = lambda t, k: [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, tx.keys(F.col("text"))).collect()]

    def once(words):
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = Counter(grams)
        return {g: i for i, g in enumerate(grams) if n[g] == 1}

    items = [(i, once(w)) for i, w in keys("benchmark", "item_id")]
    want = {}
    for doc, words in keys("documents", "doc_id"):
        own = once(words)
        for item, grams in items:
            at = [grams[g] for g in sorted(own.keys() & grams.keys(), key=own.get)]
            longest = []
            for i, v in enumerate(at):
                longest.append(1 + max((longest[j] for j in range(i) if at[j] < v), default=0))
            if at:
                want[doc, item] = max(longest)
    got = {(r.doc_id, r.item_id): r.landmarks for r in queries.QUERIES["landmarks"](spark, SF).collect()}
    assert got == want and want
