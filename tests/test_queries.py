"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as e
from tandemtext.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, data, name):
    df = QUERIES[name](spark, data)
    cursor = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(cursor.fetchall(), key=key)


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rules_equal_their_sql_on_random_texts(spark):
    """Cases that the tables lack: tokens, addresses, brackets and breaks of all kinds."""
    import random

    from pyspark.sql import functions as F

    from tandemtext.functions import text as tx
    from tandemtext.operators import quality
    from tandemtext.plans.queries import _RULE_SQL

    rng = random.Random(3)
    pieces = ["(", ")", "[", "]", "（", "）", "「", "」", "a", "b1", "２", "\n", "，", "。", " ", "　", "${x}", "%d", "{0}", "\\n", "https://a.b/c", "x@y.zz", "あ", "中", "<tag id='1' type='br' desc='x'/>", "<tag id='2' type='fmt' desc='x'/>"]
    text = lambda: "".join(rng.choices(pieces, k=rng.randrange(0, 9)))
    rows = [(i, a := text(), rng.choice([a, text(), text()])) for i in range(5_000)]
    df = spark.createDataFrame(rows, "id bigint, source string, target string").withColumns({"s": tx.plain(F.col("source")), "t": tx.plain(F.col("target"))})
    c = duckdb.connect()
    c.execute("create table b (id bigint, source varchar, target varchar, s varchar, t varchar)")
    c.executemany("insert into b values (?, ?, ?, ?, ?)", [tuple(r) for r in df.collect()])
    rules = quality.local_rules(quality.quality_policy())
    for name, sql in _RULE_SQL.items():
        got, want = {r["id"] for r in df.where(rules[name]).select("id").collect()}, {r[0] for r in c.execute(f"select id from b where {sql}").fetchall()}
        assert len(got) > 20 and got == want, (name, len(got), len(want), [rows[i] for i in sorted(got ^ want)[:3]])


def test_layered_fragments_asks_every_unit(spark, tmp_path):
    """Units count whatever their ids; those without a source or without a run of four characters give nothing."""
    texts = ["裏側の世界で待っています", "これは裏側の世界の地図です", "世界", None, "遠い裏側の世界へ行こう"]
    spark.createDataFrame([(i, s, None) for i, s in zip([1, 7, 8, 9, 20], texts, strict=True)], "unit_id bigint, source_text string, context string").write.parquet(f"{tmp_path}/transunit.parquet")
    entries = [(1, "裏側の世界だ", "里侧", None, "a", "permanent", None, None), (2, "また裏側の世界に来た", "里侧的", None, "r", "runtime", 1, "d")]
    spark.createDataFrame(entries, "entry_id bigint, source string, target string, context string, file string, scope string, batch int, document string").write.parquet(f"{tmp_path}/tm_store.parquet")
    rows = QUERIES["layered_fragments"](spark, str(tmp_path)).select("q", "e", "fragment").collect()
    assert sorted(map(tuple, rows)) == [(q, e, "裏側の世界") for q in (1, 7, 20) for e in (1, 2)]
