"""Compare a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    return sorted(tuple(None if v is None or v != v else v for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)) if not frame.isnull().any().any() else sorted(map(str, frame[columns].astype(object).where(frame[columns].notnull(), None).itertuples(index=False, name=None)))


def compare(spark, query, sql, folder):
    got = query(spark, folder).toPandas()
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = c.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)
    assert rows(got, columns) == rows(want, columns)
