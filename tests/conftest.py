import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    ).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def text(v):
    """A value as the comparison with SQL writes it."""
    if isinstance(v, float):
        return f"{v:.9g}"
    return "~" if v is None else f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a DataFrame with what DuckDB makes of SQL over the same tables, rows in any order."""
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(df, sql):
        want = con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        quoted = ", ".join(f'"{c}"' for c in cols)
        assert sorted(tuple(map(text, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(text, r)) for r in want.select(quoted).fetchall())

    return check
