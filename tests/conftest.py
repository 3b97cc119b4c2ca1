import os
import tempfile

import pytest

from cuespan.session import local_session

SMALL = os.environ.get("CUESPAN_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory() as shared:
        s = local_session(4, shuffle_partitions=4, memory="4g", extra={"spark.checkpoint.dir": f"file://{shared}"})
        s.sparkContext.setLogLevel("ERROR")
        yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def same_rows(found, expected):
    cols = sorted(found.columns)
    assert cols == sorted(expected.columns)
    flat = lambda p: p[cols].astype(object).where(p[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True)
    a, b = flat(found), flat(expected)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head().to_string() + "\n" + b[(a != b).any(axis=1)].head().to_string()
