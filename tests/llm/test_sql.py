import pytest
from conftest import DATA, rows_of

from tallyhouse.llm import queries as q


@pytest.mark.parametrize("name", ["op1_ngram_join", "op5_embedding_dedup", "op7_decontamination", "op9_warc", "op12_secrets"])
def test_query_equals_sql(spark, duck, name):
    ours, theirs = q.QUERIES[name](spark, DATA).toPandas(), duck.execute(q.SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert [str(ours[c].dtype).lower() for c in sorted(ours.columns) if c != "refers_to"] == [str(theirs[c].dtype).lower() for c in sorted(ours.columns) if c != "refers_to"]
    assert rows_of(ours) == rows_of(theirs)


def test_sql_finds_what_is_planted(spark):
    """Links of vectors, revisits and spans of high entropy, which the tables have none of or few."""
    import duckdb

    from tallyhouse.llm.embedding_dedup import embedding_near_duplicates
    from tallyhouse.llm.secrets import find_secrets

    con = duckdb.connect()
    axis = lambda i, j=None: [float(x == i) + 0.3 * (x == j) for x in range(12)]
    vectors = [(1, axis(0)), (2, axis(0, 5)), (3, axis(0, 6)), (4, None), (5, [0.0] * 12), (6, axis(3)), (7, axis(3)), (8, [1.0]), (9, axis(9, 3)), (10, axis(9, 4))]
    texts = [(1, "key Zx9Kq2Lm8Vb4Nc7Wd1Rt6Yp3Hs5Jf0Ga end"), (2, "token='abcdefghijkl' and 0123456789abcdef0123456789ABCDEF0123456789abcdef"), (3, None), (4, "aZ9bY8cX7dW6eV5fU4gT3hS2iR1 then jQ0kP9lO8mN7oM6pL5qK4rJ3sI2tH1 é"), (5, "token=token=abcdefghijklmn")]
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", vectors)
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    got = embedding_near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).toPandas()
    assert rows_of(got) == rows_of(con.execute(q.SQL["op5_embedding_dedup"]).fetchdf()) and got["n_links"].sum() > 3
    got = find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").toPandas()
    assert rows_of(got) == rows_of(con.execute(q.SQL["op12_secrets"]).fetchdf()) and got["spans"].str.contains("entropy").sum() == 3
