"""SQL, plan API, catalog and transactions on small tables with exact expected rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harrow import database
from harrow import errors as err
from harrow.database import Database
from harrow.functions import aggregates
from harrow.functions.aggregates import count, maximum
from harrow.operators import relational as R
from harrow.plans import estimates
from harrow.plans.ast import FieldRef, Literal, Predicate, Term
from harrow.sources import storage
from harrow.streaming import query_stream


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def rows(frame):
    return Counter(map(tuple, frame.collect()))


def fill(db, ddl, name, data):
    with db.begin() as tx:
        tx.execute(ddl)
        tx.load(name, db.spark.createDataFrame(data, [f.name for f in tx.catalog.tables[name].fields]))


def test_select(db):
    rng = random.Random(1)
    data = [(a, f"rec{a}") for a in (round(rng.random() * 50) for _ in range(200))]
    fill(db, "create table T1 (A int, B varchar(9))", "t1", data)
    want = sum(a == 10 for a, _ in data)
    assert want > 0
    assert rows(db.query("select B from T1 where A=10")) == {("rec10",): want}
    assert rows(db.query("select b from t1 where a = '10'")) == {}
    assert sum(rows(db.query("select a from t1 where 'x' = 'x'")).values()) == 200


def test_join(db):
    fill(db, "create table T1 (A int, B varchar(9))", "t1", [(i, str(i)) for i in range(200)])
    fill(db, "create table T2 (C int, D varchar(9))", "t2", [(199 - i, str(199 - i)) for i in range(200)])
    assert rows(db.query("select B, D from T1, T2 where A=C")) == Counter((str(i), str(i)) for i in range(200))
    assert db.query("select a, c from t1, t2").count() == 40_000
    plan = db.query("select B, D from T1, T2 where A=C")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_group_by(db):
    fill(db, "create table t1 (a int, b int)", "t1", [(i // 10, i) for i in range(100)])
    out = R.group_by(db.table("t1"), ["a"], [count("b"), maximum("b")])
    assert out.columns == ["a", "countofb", "maxofb"]
    assert rows(out) == Counter((a, 10, 10 * a + 9) for a in range(10))
    aggregates.register("sum", F.sum)
    assert rows(R.group_by(db.table("t1"), [], [aggregates.Aggregate("sum", "b")])) == {(4950,): 1}
    with pytest.raises(err.UnknownField):
        R.group_by(db.table("t1"), ["z"], [count("b")])


@pytest.mark.parametrize("strategy", R.SORT_STRATEGIES)
def test_sort(spark, strategy):
    rng = random.Random(2)
    data = [(a, f"rec{a}") for a in (round(rng.random() * 50) for _ in range(2000))]
    got = [tuple(r) for r in R.sort(spark.createDataFrame(data, "a int, b string"), ["a"], strategy).collect()]
    assert [a for a, _ in got] == sorted(a for a, _ in data) and Counter(got) == Counter(data)


def test_join_strategies(spark):
    left = spark.createDataFrame([(i // 10, f"rec{i // 10}") for i in range(100)], "a int, b string")
    right = spark.createDataFrame([((99 - i) // 10, f"rec{(99 - i) // 10}") for i in range(100)], "c int, d string")
    for f in (R.merge_join, R.hash_join, R.index_join):
        got = rows(f(left, right, "a", "c"))
        assert got == Counter({(k, f"rec{k}", k, f"rec{k}"): 100 for k in range(10)})
    for strategy, node in (("merge", "SortMergeJoin"), ("hash", "ShuffledHashJoin")):
        assert node in R.join(left, right, "a", "c", strategy)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in R.product(left, right, "block")._jdf.queryExecution().executedPlan().toString()
    assert R.join(left, right, "a", "d").count() == 0


def test_name_clash(spark):
    left = spark.createDataFrame([(1, "l1"), (2, "l2")], "a int, b string")
    right = spark.createDataFrame([(1, "r1"), (3, "r3")], "a int, b string")
    assert R.join(left, right, "a", "a").columns == ["a", "b"]
    assert rows(R.join(left, right, "a", "a")) == {(1, "l1"): 1}
    assert rows(R.product(left, right)) == {(1, "l1"): 2, (2, "l2"): 2}


def test_empty(spark):
    none, one = spark.createDataFrame([], "a int, b string"), spark.createDataFrame([(1,)], "c int")
    assert R.product(none, one).count() == R.product(one, none).count() == 0
    assert R.sort(none, ["a"]).count() == R.group_by(none, ["a"], [count("b")]).count() == 0
    assert rows(R.group_by(none, [], [count("b"), maximum("a")])) == {(0, None): 1}
    assert R.join(none, one, "a", "c").count() == R.index_select(none, "a", "x").count() == 0


def test_index(db):
    fill(db, "create table t1 (a int, b varchar(9), c int)", "t1", [(i, f"rec{i}", i % 10) for i in range(100)])
    db.execute("create index idxc on t1(c)")
    assert rows(db.index_select("idxc", 3)) == Counter((i, f"rec{i}", 3) for i in range(3, 100, 10))
    assert db.execute("delete from t1 where c = 3") == 10
    assert db.index_select("idxc", 3).count() == 0
    left = db.spark.createDataFrame([(1,), (3,)], "k int")
    assert db.index_join(left, "k", "idxc").count() == 10
    with pytest.raises(err.UnknownIndex):
        db.index_select("nope", 1)
    with pytest.raises(err.UnknownField):
        db.execute("create index i on t1(zzz)")


def test_dml(db):
    db.execute("create table t (a int, b varchar(3))")
    assert db.query("select a from t").count() == 0
    assert db.execute("insert into t(a, b) values (1, 'one')") == 1
    assert db.execute("insert into t(b) values ('two')") == 1
    assert db.execute("insert into t(a) values (3)") == 1
    assert rows(db.table("t")) == Counter([(1, "one"), (0, "two"), (3, "")])
    before = db.table("t")
    assert db.execute("update t set a = 7 where a = 7") == 0
    assert db.execute("update t set a = 7 where b = 'two'") == 1
    assert db.execute("update t set a = a where a = 7") == 1
    assert db.execute("delete from t where a = 'x'") == 0
    assert rows(db.table("t")) == Counter([(1, "one"), (7, "two"), (3, "")])
    assert rows(before) == Counter([(1, "one"), (0, "two"), (3, "")])
    assert db.execute("delete from t") == 3
    assert db.table("t").count() == 0


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("insert into t(a, b) values (1)", err.TypeMismatch),
        ("insert into t(a) values ('x')", err.TypeMismatch),
        ("insert into t(b) values ('four')", err.TypeMismatch),
        ("insert into t(b) values ('\U0001f600\U0001f600')", err.TypeMismatch),
        ("insert into t(z) values (1)", err.UnknownField),
        ("update t set b = 1", err.TypeMismatch),
        ("update t set b = a", err.TypeMismatch),
        ("update t set b = c", err.TypeMismatch),
        ("delete from t where zzz = 1", err.UnknownField),
        ("delete from nope", err.UnknownTable),
        ("create table t (a int)", err.DuplicateName),
        ("create table u (a int, a int)", err.DuplicateName),
        ("create table tblcat (a int)", err.DuplicateName),
        ("create view w as select a from w", err.CyclicView),
        ("delete from tblcat", err.EngineError),
    ],
)
def test_dml_errors(db, text, error):
    db.execute("create table t (a int, b varchar(3), c varchar(9))")
    db.execute("insert into t(a, b, c) values (1, 'one', 'too long')")
    with pytest.raises(error):
        db.execute(text)
    assert rows(db.table("t")) == {(1, "one", "too long"): 1}


def test_views(db):
    fill(db, "create table t (a int, b varchar(9))", "t", [(1, "John"), (2, "Ann")])
    db.execute("create view v as select a, b from t where b = 'John'")
    db.execute("create view w as select b from v where a = 1")
    db.execute("create table u (c int)")
    db.execute("insert into u(c) values (1)")
    assert rows(db.query("select b from w")) == {("John",): 1}
    assert rows(db.query("select b, c from v, u where a = c")) == {("John", 1): 1}
    assert Database(db.spark, db.storage.root).query("select b from w").count() == 1


def test_catalog(db):
    db.execute("create table Shop (s_town varchar(20), s_id int)")
    assert rows(db.query("select slotsize from tblcat where tblname = 'shop'")) == {(52,): 1}
    got = rows(db.query("select fldname, type, length, offset from fldcat where tblname = 'shop'"))
    assert got == Counter([("s_town", 1, 20, 4), ("s_id", 0, 0, 48)])
    assert rows(db.query("select tblname from tblcat")) == Counter(
        (x,) for x in ("tblcat", "fldcat", "viewcat", "idxcat", "shop")
    )


def test_statistics_are_kept(db, monkeypatch):
    fill(db, "create table big (a int, b varchar(9))", "big", [(i, "x") for i in range(50)])
    opened = []
    monkeypatch.setattr(db.storage, "read_files", lambda *x: opened.append(x))
    stats = db.stats("big")
    assert (stats.num_records, stats.num_blocks, stats.distinct_values) == (50, 4, 17) and not opened
    frames = iter([db.spark.range(7), db.spark.range(9)])
    db.register("given", lambda: next(frames))
    found = [db.stats("given").num_records]
    db.registered["given"] = db.spark.range(9)
    found += [db.stats("given").num_records for _ in range(100)]
    assert found == [7] * 100 + [9]  # counted again after a hundred calls


def test_dml_rewrites_only_files_with_hits(db):
    db.execute("create table t (a int, b varchar(9))")
    with db.begin() as tx:
        for k in range(4):
            tx.load("t", db.spark.createDataFrame([(10 * k + i, f"r{k}") for i in range(10)], "a int, b string").coalesce(1))
    files = lambda: [f for f, _ in db.committed()[1].table("t").files]
    first = files()
    assert len(first) == 4
    assert db.execute("update t set b = 'hit' where a = 13") == 1
    second = files()
    assert set(first) - set(second) == {first[1]} and len(second) == 4
    assert db.execute("delete from t where b = 'r2'") == 10  # every row of one file: nothing is written
    assert files() == [f for f in second if f != first[2]]
    assert db.execute("delete from t where a = 0") == 1 and db.stats("t").num_records == 29
    assert rows(db.query("select a from t where b = 'hit'")) == {(13,): 1} and db.table("t").count() == 29
    assert db.recover() == 3 and db.table("t").count() == 29


def test_compaction(db, monkeypatch):
    monkeypatch.setattr(database, "MOST_SMALL_FILES", 3)
    db.execute("create table t (a int)")
    for k in range(5):
        db.execute(f"insert into t(a) values ({k})")
    assert len(db.committed()[1].table("t").files) == 2  # one of four rows, and the last one
    assert rows(db.table("t")) == Counter((k,) for k in range(5))
    tx = db.begin()
    assert tx.compact("t") == 2
    db.execute("insert into t(a) values (5)")
    with pytest.raises(err.Conflict):
        tx.commit()
    assert rows(db.table("t")) == Counter((k,) for k in range(6))


def test_inserts_do_not_conflict(db):
    db.execute("create table t (a int)")
    one, two, reader = db.begin(), db.begin(), db.begin()
    one.execute("insert into t(a) values (1)")
    two.execute("insert into t(a) values (2)")
    reader.execute("insert into t(a) values (3)")
    assert reader.query("select a from t").count() == 1
    one.commit()
    two.commit()
    with pytest.raises(err.Conflict):
        reader.commit()
    assert rows(db.table("t")) == Counter([(1,), (2,)])


def test_log_is_bounded(db, monkeypatch):
    monkeypatch.setattr(storage, "KEPT_ENTRIES", 3)
    empty = {"tables": {}, "views": {}, "indexes": []}
    for n in range(1, 9):
        assert db.storage.append(n, empty)
    assert sorted(db.storage._numbers()) == [6, 7, 8]
    assert not db.storage.append(2, empty) and not db.storage.append(8, empty)  # 2 is free, but was taken once
    assert db.storage.last()[0] == 8 and sorted(db.storage._numbers()) == [6, 7, 8]
    found = db.storage._numbers
    monkeypatch.setattr(db.storage, "_numbers", lambda: [*found(), 10])  # another writer builds on 9 at once
    assert db.storage.append(9, empty)


def test_indexed_rows_are_clustered(db):
    db.execute("create table t (a int, b int)")
    db.execute("create index t_b on t(b)")
    data = [(i, i * 7919 % 1000) for i in range(1000)]
    with db.begin() as tx:
        tx.load("t", db.spark.createDataFrame(data, "a int, b int"))
    spans = db.table("t").groupBy(db.storage.file_name().alias("f")).agg(F.min("b").alias("low"), F.max("b").alias("high")).collect()
    spans = sorted((r.low, r.high) for r in spans)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # a look-up meets one file
    assert rows(db.index_select("t_b", 5)) == Counter(x for x in data if x[1] == 5)
    db.execute("create index t_a on t(a)")
    before = db.table("t")
    assert db.cluster("t_a") >= 1
    spans = db.table("t").groupBy(db.storage.file_name().alias("f")).agg(F.min("a").alias("low"), F.max("a").alias("high")).collect()
    spans = sorted((r.low, r.high) for r in spans)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert rows(db.table("t")) == rows(before) == Counter(data)
    with pytest.raises(err.UnknownIndex):
        db.cluster("nope")


def test_sort_runs(spark):
    frame = spark.createDataFrame([(i * 7919 % 100, i) for i in range(100)], "a int, b int").repartition(4)
    runs = R.sort_runs(frame, ["a"])
    assert "rangepartitioning" not in runs._jdf.queryExecution().executedPlan().toString()
    found = runs.withColumn("run", F.spark_partition_id()).collect()
    assert len({r.run for r in found}) == 4 and len(found) == 100
    for run in range(4):
        values = [r.a for r in found if r.run == run]
        assert values == sorted(values)


def test_estimates(db):
    db.register("t", db.spark.range(30).selectExpr("id as a", "id as b"))
    db.register("u", db.spark.range(60).selectExpr("id as c"))
    found = db.estimate("select a, c from t, u where a = c and b = 1")
    assert (found.records, found.distinct) == (30 * 60 // (21 * 11), {"a": 11, "c": 11})
    assert db.estimate("select a from t where 1 = 2").records == 0 and db.estimate("select a from t where 1 = 1").records == 30
    db.execute("create view v as select a, b from t where b = 1")
    assert db.estimate("select c from v, u where a = c").records == (30 // 11) * 60 // 21
    both = estimates.Estimate(100, {"a": 10, "b": 20})
    assert estimates.group_by(both, ("a", "b"), ("countofa",)) == estimates.Estimate(200, {"a": 10, "b": 20, "countofa": 200})
    assert estimates.index_select(both, "b", 1) == estimates.Estimate(5, {"a": 10, "b": 1})
    assert estimates.join(both, estimates.Estimate(50, {"c": 5}), "a", "c").records == 500


def test_transactions(db):
    db.execute("create table t (a int)")
    db.execute("create table u (a int)")
    one, two, three = db.begin(), db.begin(), db.begin()
    one.execute("insert into t(a) values (1)")
    assert one.table("t").count() == 1 and two.table("t").count() == 0
    one.commit()
    assert two.query("select a from t").count() == 0
    two.execute("insert into u(a) values (2)")
    with pytest.raises(err.Conflict):
        two.commit()
    three.execute("insert into u(a) values (3)")
    three.commit()
    assert rows(db.table("u")) == {(3,): 1} and rows(db.table("t")) == {(1,): 1}
    with pytest.raises(err.TransactionClosed):
        three.commit()
    gone = db.begin()
    gone.execute("insert into t(a) values (9)")
    gone.rollback()
    assert db.table("t").count() == 1
    lost = db.begin()
    lost.execute("insert into t(a) values (9)")  # as if the process ended here
    assert db.recover() == 1 and db.table("t").count() == 1
    with pytest.raises(ZeroDivisionError), db.begin() as tx:
        tx.execute("delete from t")
        raise ZeroDivisionError
    assert db.table("t").count() == 1


def test_log_number_is_taken_once(db):
    assert db.storage.append(1, {"tables": {}, "views": {}, "indexes": []})
    assert not db.storage.append(1, {"tables": {}, "views": {}, "indexes": []})


def test_pushdown(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    out = R.project(R.select(frame, Predicate((Term(FieldRef("c_mktsegment"), Literal("BUILDING")),))), ["c_name"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_acctbal" not in plan


def test_stream(db, tmp_path):
    spark = db.spark
    fill(db, "create table names (k int, n varchar(9))", "names", [(1, "one"), (2, "two")])
    spark.createDataFrame([(1, 10), (2, 20), (1, 30)], "id int, v int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, v int").parquet(f"{tmp_path}/in")
    out = query_stream(db, "select n, v from s, names where id = k and id = 1", {"s": stream})
    q = out.writeStream.format("memory").queryName("harrow_stream").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("harrow_stream")) == Counter([("one", 10), ("one", 30)])
