import duckdb
import pytest

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("rid", T.StringType()), T.StructField("row_key", T.StringType()), T.StructField("word", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("host", T.LongType()), T.StructField("node", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("a.b c", T.StringType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text[, source]) tuples to a documents table with extra columns whose names clash."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None, "x", "y", 1, "z", "s", 2, "n", "h", "dot") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def sample():
    """doc_id and text of the smallest documents table."""
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def oracle():
    """Runs SQL over rows given as documents, or over the smallest tables."""

    def run(sql, rows=None):
        con = duckdb.connect()
        for t in ("documents", "labels", "benchmark"):
            con.execute(f"CREATE VIEW {t}_0 AS SELECT * FROM '{SF}/{t}.parquet'")
        if rows is None:
            con.execute("CREATE VIEW documents AS SELECT * FROM documents_0")
        else:
            con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
            con.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, 0)", [(r[0], r[1], r[2] if len(r) > 2 else "src0") for r in rows])
        rel = con.sql(sql)
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        return sorted(tuple(r[i] for i in order) for r in rel.fetchall())

    return run


def sorted_rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
