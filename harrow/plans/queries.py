"""Queries of the relational engine over the test tables, and SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..database import Database
from ..errors import Conflict
from ..functions import aggregates
from ..functions.aggregates import count, maximum
from ..operators import relational as R
from ..sources.files import parquet_table, shared_folder
from . import estimates
from .ast import FieldRef, Literal, Predicate, Term, Update
from .compiler import compile_query

TABLES = "region nation customer supplier part orders lineitem events".split()

# Statements that the engine parses itself; DuckDB gets the same text.
SELECTS = {
    "scan_table": "select r_regionkey, r_name from region",
    "project": "select n_name, n_regionkey from nation",
    "select_int_eq": "select n_name from nation where n_regionkey = 2",
    "select_string_eq": "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'",
    "select_conjunction": "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linenumber = 1",
    "select_field_eq_field": "select n_name from nation where n_nationkey = n_regionkey",
    "select_const_true": "select r_name from region where 1 = 1",
    "select_const_false": "select r_name from region where 1 = 2",
    "product": "select r_name, n_name from region, nation",
    "join_two": "select n_name, r_name from nation, region where n_regionkey = r_regionkey",
    "join_three": "select c_name, n_name, r_name from customer, nation, region"
    " where c_nationkey = n_nationkey and n_regionkey = r_regionkey",
    "join_filter": "select o_orderkey, c_name from customer, orders"
    " where c_custkey = o_custkey and c_mktsegment = 'MACHINERY'",
}

ORACLES = SELECTS | {
    "select_type_mismatch": "select n_name from nation where 1 = 2",
    "view_merge": "select c_name from (select c_name, c_nationkey from customer where c_mktsegment = 'BUILDING') v"
    " where c_nationkey = 3",
    "view_join": "select c_name, n_name from (select c_name, c_nationkey from customer"
    " where c_mktsegment = 'BUILDING') v, nation where c_nationkey = n_nationkey",
    "block_product": SELECTS["product"],
    "merge_join": SELECTS["join_filter"],
    "hash_join": SELECTS["join_filter"],
    "index_join": "select n_nationkey, n_name, n_regionkey, r_name from nation, region where n_regionkey = r_regionkey",
    "index_select": "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 3",
    "materialize": SELECTS["join_two"],
    "groupby_count": "select l_returnflag, count(l_orderkey) as countofl_orderkey from lineitem group by l_returnflag",
    "groupby_max_int": "select l_returnflag, max(l_linenumber) as maxofl_linenumber from lineitem group by l_returnflag",
    "groupby_max_string": "select c_nationkey, max(c_name) as maxofc_name from customer group by c_nationkey",
    "groupby_two_keys": "select l_returnflag, l_linestatus, count(l_orderkey) as countofl_orderkey,"
    " max(l_partkey) as maxofl_partkey from lineitem group by l_returnflag, l_linestatus",
    "global_agg": "select count(o_orderkey) as countofo_orderkey, max(o_custkey) as maxofo_custkey from orders",
    "sort_one": "select n_nationkey, n_name from nation order by n_name",
    "sort_two": "select c_nationkey, c_custkey from customer order by c_nationkey, c_custkey",
    "update_snapshot": "select n_nationkey, n_name, case when n_regionkey = 1 then 99 else n_regionkey end"
    " as n_regionkey from nation",
    "delete_snapshot": "select n_nationkey, n_name, n_regionkey from nation where not (n_regionkey = 1)",
    "insert_snapshot": "select r_regionkey, r_name from region union all"
    " select cast(5 as int) as r_regionkey, 'ATLANTIS' as r_name",
    "rollback_snapshot": "select r_regionkey, r_name from region",
    "one_buffer_sort": "select s_nationkey, s_suppkey from supplier order by s_nationkey, s_suppkey",
    "sort_runs": "select l_orderkey, l_linenumber, true as in_order from lineitem",
    "groupby_registered": "select c_mktsegment, cast(sum(c_custkey) as bigint) as sumofc_custkey, min(c_name) as minofc_name from customer group by c_mktsegment",
    "indexes_of": "select * from (values ('p_day', 'purchase_day'), ('p_shop', 'purchase_shop')) t(fieldname, indexname)",
    "insert_together": "select r_regionkey, r_name from region union all"
    " select cast(5 as int) as r_regionkey, 'ATLANTIS' as r_name union all select cast(6 as int), 'LEMURIA'",
    "compacted": "select r_regionkey, r_name from region union all select cast(i as int) as r_regionkey, 'NEW' as r_name from range(5, 8) t(i)",
    "conflict": "select r_regionkey, r_name, true as conflict from region where r_regionkey <> 1",
    "phantom": "select r_regionkey, r_name, true as conflict from region union all select cast(5 as int), 'ATLANTIS', true",
    "recover": "select r_regionkey, r_name, true as dropped from region",
    "planner": "select n_name from nation where n_regionkey = 2 and n_nationkey > 10",
    "command": "select r_regionkey, upper('r' || r_regionkey) as r_name from region",
    "equates": "select 'BUILDING' as constant, 'n_nationkey' as field, true as applies, false as applies_to_nation",
    "reduction_factor": "select (select 1 + count(*) // 3 from customer) as by_constant,"
    " (select greatest((select 1 + count(*) // 3 from customer), (select 1 + count(*) // 3 from nation))) as by_field",
    "estimate": "with c as (select count(*) as n from customer), x as (select count(*) as n from nation)"
    " select cast(c.n * x.n // (greatest(1 + c.n // 3, 1 + x.n // 3) * (1 + c.n // 3)) as bigint) as num_records,"
    " cast(1 + c.n // 3 as bigint) as names, cast(1 as bigint) as segments from c, x",
    "stat_info": "select count(*) as num_records, cast(1 + floor(count(*) / 3) as bigint) as distinct_values from orders",
    "tblcat": "select * from (values ('tblcat', 44::int), ('fldcat', 88::int), ('viewcat', 244::int),"
    " ('idxcat', 112::int), ('purchase', 40::int)) t(tblname, slotsize)",
    "fldcat": "select * from (values ('purchase', 'p_day', 0::int, 0::int, 4::int), ('purchase', 'p_shop', 1::int, 12::int, 8::int),"
    " ('purchase', 'p_sum', 0::int, 0::int, 36::int)) t(tblname, fldname, type, length, \"offset\")",
    "idxcat": "select * from (values ('purchase_day', 'purchase', 'p_day'), ('purchase_shop', 'purchase', 'p_shop'))"
    " t(indexname, tablename, fieldname)",
    "viewcat": "select 'first_day' as viewname, 'select p_shop, p_sum from purchase where p_day = 1' as viewdef",
}


def open_scratch(spark: SparkSession, **options) -> Database:
    """A new database in the folder that all executors share, with no tables yet."""
    return Database(spark, f"{shared_folder(spark)}/scratch_{uuid.uuid4().hex}", **options)


def open_tables(spark: SparkSession, sf_dir: str, **options) -> Database:
    """A scratch database with the relational test tables as read-only tables, each opened when it is first used."""
    db = open_scratch(spark, **options)
    for name in TABLES:
        db.register(name, partial(parquet_table, spark, sf_dir, name))
    return db


def _import_table(db: Database, name: str, ddl: str, frame: DataFrame) -> None:
    """Create an own table and load it in bulk, as one staged part."""
    with db.begin() as tx:
        tx.execute(ddl)
        tx.load(name, frame)


def _nation(spark: SparkSession, sf_dir: str) -> Database:
    db = open_scratch(spark)
    ddl = "create table nation (n_nationkey int, n_name varchar(25), n_regionkey int)"
    _import_table(db, "nation", ddl, parquet_table(spark, sf_dir, "nation"))
    return db


def _region(spark: SparkSession, sf_dir: str) -> Database:
    db = open_scratch(spark)
    ddl = "create table region (r_regionkey int, r_name varchar(25))"
    _import_table(db, "region", ddl, parquet_table(spark, sf_dir, "region"))
    return db


def _update(spark, d):
    db = _nation(spark, d)
    db.execute("update nation set n_regionkey = 99 where n_regionkey = 1")
    return db.table("nation")


def _delete(spark, d):
    db = _nation(spark, d)
    db.execute("delete from nation where n_regionkey = 1")
    return db.table("nation")


def _insert(spark, d):
    db = _region(spark, d)
    db.execute("insert into region (r_regionkey, r_name) values (5, 'ATLANTIS')")
    return db.table("region")


def _rollback(spark, d):
    db = _region(spark, d)
    tx = db.begin()
    tx.execute("delete from region")
    tx.execute("insert into region (r_regionkey, r_name) values (9, 'NOWHERE')")
    tx.rollback()
    return db.table("region")


def _view(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        db = open_tables(spark, d)
        db.execute("create view v as select c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'")
        return db.query(text)

    return run


def _joined(strategy: str):
    def run(spark, d):
        machinery = Predicate((Term(FieldRef("c_mktsegment"), Literal("MACHINERY")),))
        left = R.select(parquet_table(spark, d, "customer"), machinery)
        out = R.join(left, parquet_table(spark, d, "orders"), "c_custkey", "o_custkey", strategy)
        return R.project(out, ["o_orderkey", "c_name"])

    return run


def _index_join(spark, d):
    db = _region(spark, d)
    db.execute("create index region_key on region(r_regionkey)")
    out = db.index_join(parquet_table(spark, d, "nation"), "n_regionkey", "region_key")
    return R.project(out, ["n_nationkey", "n_name", "n_regionkey", "r_name"])


def _index_select(spark, d):
    db = _nation(spark, d)
    db.execute("create index nation_region on nation(n_regionkey)")
    db.cluster("nation_region")
    return db.index_select("nation_region", 3)


def _materialize(spark, d):
    kept = R.materialize(R.join(parquet_table(spark, d, "nation"), parquet_table(spark, d, "region"), "n_regionkey", "r_regionkey"))
    return R.project(kept, ["n_name", "r_name"])


def _block_product(spark, d):
    out = R.product(parquet_table(spark, d, "region"), parquet_table(spark, d, "nation"), "block")
    return R.project(out, ["r_name", "n_name"])


def _grouped(table: str, keys: list[str], *aggregates):
    return lambda spark, d: R.group_by(parquet_table(spark, d, table), keys, aggregates)


def _sorted(table: str, fields: list[str], out: list[str], strategy: str = "auto"):
    return lambda spark, d: R.sort(R.project(parquet_table(spark, d, table), out), fields, strategy)


def _stat_info(spark, d):
    stats = open_tables(spark, d).stats("orders")
    return spark.createDataFrame([(stats.num_records, stats.distinct_values)], "num_records long, distinct_values long")


def _purchases(spark: SparkSession) -> Database:
    db = open_scratch(spark)
    db.execute("create table Purchase (p_day int, p_shop varchar(12), p_sum int)")
    db.execute("create index purchase_day on Purchase(p_day)")
    db.execute("create index purchase_shop on Purchase(p_shop)")
    db.execute("create view first_day as select p_shop, p_sum from Purchase where p_day = 1")
    return db


def _catalog(name: str):
    return lambda spark, d: _purchases(spark).table(name)


def _fldcat(spark, d):
    return _purchases(spark).query("select tblname, fldname, type, length, offset from fldcat where tblname = 'purchase'")


def _indexes_of(spark, d):
    return spark.createDataFrame(list(_purchases(spark).indexes_of("purchase").items()), "fieldname string, indexname string")


def _sort_runs(spark, d):
    """The rows of each run with whether they are in order after the row before them in it."""
    fields = ["l_orderkey", "l_linenumber"]
    runs = R.sort_runs(R.project(parquet_table(spark, d, "lineitem").repartition(5, "l_linenumber"), fields), fields)

    def ordered(batches):
        last = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            fits = [a is None or a <= b for a, b in zip([last, *rows], rows, strict=False)]
            last = rows[-1] if rows else last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fits, pa.bool_())], names=[*fields, "in_order"])

    return runs.mapInArrow(ordered, "l_orderkey long, l_linenumber int, in_order boolean")


def _groupby_registered(spark, d):
    aggregates.register("sum", F.sum)
    aggregates.register("min", F.min)
    wanted = [aggregates.Aggregate("sum", "c_custkey"), aggregates.Aggregate("min", "c_name")]
    return R.group_by(parquet_table(spark, d, "customer"), ["c_mktsegment"], wanted)


def _insert_together(spark, d):
    """Two transactions insert into one table at a time; neither reads it, so both commit."""
    db = _region(spark, d)
    one, two = db.begin(), db.begin()
    one.execute("insert into region (r_regionkey, r_name) values (5, 'ATLANTIS')")
    two.execute("insert into region (r_regionkey, r_name) values (6, 'LEMURIA')")
    one.commit()
    two.commit()
    return db.table("region")


def _compacted(spark, d):
    db = _region(spark, d)
    for k in (5, 6, 7):
        db.execute(f"insert into region (r_regionkey, r_name) values ({k}, 'NEW')")
    db.compact("region")
    return db.table("region")


def _fails(tx) -> bool:
    try:
        tx.commit()
    except Conflict:
        return True
    return False


def _conflict(spark, d):
    """Of two transactions that delete from one table the first one wins."""
    db = _region(spark, d)
    one, two = db.begin(), db.begin()
    one.execute("delete from region where r_regionkey = 1")
    two.execute("delete from region where r_regionkey = 2")
    one.commit()
    return db.table("region").withColumn("conflict", F.lit(_fails(two)))


def _phantom(spark, d):
    """A row that another one inserts into a table that a transaction has read."""
    db = _region(spark, d)
    reader = db.begin()
    reader.query("select r_name from region where r_regionkey = 5").count()
    db.execute("insert into region (r_regionkey, r_name) values (5, 'ATLANTIS')")
    reader.execute("delete from region where r_regionkey = 4")
    return db.table("region").withColumn("conflict", F.lit(_fails(reader)))


def _recover(spark, d):
    """What a transaction has staged when its process ends is dropped."""
    db = _region(spark, d)
    lost = db.begin()
    lost.execute("insert into region (r_regionkey, r_name) values (9, 'NOWHERE')")
    lost.execute("update region set r_name = 'LOST' where r_regionkey = 0")
    again = Database(spark, db.storage.root)
    dropped = again.recover() >= 2
    return again.table("region").withColumn("dropped", F.lit(dropped))


def _planner(spark, d):
    """A planner of one's own: the engine's, with one filter more."""

    def stricter(query, views, read):
        return compile_query(query, views, lambda name: read(name).filter("n_nationkey > 10"))

    return open_tables(spark, d, planner=stricter).query("select n_name from nation where n_regionkey = 2")


def _command(spark, d):
    """An update that runs another way: names come from keys."""
    db = _region(spark, d)

    def renamed(tx, command):
        for r in tx.table(command.table).select("r_regionkey").collect():
            where = Predicate((Term(FieldRef("r_regionkey"), Literal(r.r_regionkey)),))
            tx.run(Update(command.table, "r_name", Literal(f"R{r.r_regionkey}"), where))
        return 0

    db.commands[Update] = renamed
    db.execute("update region set r_name = 'any'")
    return db.table("region")


_TERMS = (Term(FieldRef("c_mktsegment"), Literal("BUILDING")), Term(FieldRef("c_nationkey"), FieldRef("n_nationkey")))


def _equates(spark, d):
    p, nation = Predicate(_TERMS), parquet_table(spark, d, "nation")
    both = [*parquet_table(spark, d, "customer").columns, *nation.columns]
    row = (p.constant_for("c_mktsegment").value, p.field_for("c_nationkey"), p.applies_to(both), p.applies_to(nation.columns))
    return spark.createDataFrame([row], "constant string, field string, applies boolean, applies_to_nation boolean")


def _reduction_factor(spark, d):
    db = open_tables(spark, d)
    tables = [estimates.Estimate(s.num_records, {f: s.distinct_values for f in db.table(t).columns}) for t in ("customer", "nation") for s in [db.stats(t)]]
    both = estimates.product(*tables)
    row = tuple(estimates.reduction_factor(Predicate((t,)), both) for t in _TERMS)
    return spark.createDataFrame([row], "by_constant long, by_field long")


def _estimate(spark, d):
    text = "select c_name, c_mktsegment from customer, nation where c_mktsegment = 'BUILDING' and c_nationkey = n_nationkey"
    e = open_tables(spark, d).estimate(text)
    row = (e.records, e.distinct["c_name"], e.distinct["c_mktsegment"])
    return spark.createDataFrame([row], "num_records long, names long, segments long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: (lambda text: lambda spark, d: open_tables(spark, d).query(text))(text) for k, text in SELECTS.items()}
    return found | {
        "select_type_mismatch": lambda spark, d: open_tables(spark, d).query("select n_name from nation where n_regionkey = '2'"),
        "view_merge": _view("select c_name from v where c_nationkey = 3"),
        "view_join": _view("select c_name, n_name from v, nation where c_nationkey = n_nationkey"),
        "block_product": _block_product,
        "merge_join": _joined("merge"),
        "hash_join": _joined("hash"),
        "index_join": _index_join,
        "index_select": _index_select,
        "materialize": _materialize,
        "groupby_count": _grouped("lineitem", ["l_returnflag"], count("l_orderkey")),
        "groupby_max_int": _grouped("lineitem", ["l_returnflag"], maximum("l_linenumber")),
        "groupby_max_string": _grouped("customer", ["c_nationkey"], maximum("c_name")),
        "groupby_two_keys": _grouped("lineitem", ["l_returnflag", "l_linestatus"], count("l_orderkey"), maximum("l_partkey")),
        "global_agg": _grouped("orders", [], count("o_orderkey"), maximum("o_custkey")),
        "sort_one": _sorted("nation", ["n_name"], ["n_nationkey", "n_name"], "natural_runs"),
        "sort_two": _sorted("customer", ["c_nationkey", "c_custkey"], ["c_nationkey", "c_custkey"], "multi_buffer"),
        "update_snapshot": _update,
        "delete_snapshot": _delete,
        "insert_snapshot": _insert,
        "rollback_snapshot": _rollback,
        "one_buffer_sort": _sorted("supplier", ["s_nationkey", "s_suppkey"], ["s_nationkey", "s_suppkey"], "one_buffer"),
        "sort_runs": _sort_runs,
        "groupby_registered": _groupby_registered,
        "indexes_of": _indexes_of,
        "insert_together": _insert_together,
        "compacted": _compacted,
        "conflict": _conflict,
        "phantom": _phantom,
        "recover": _recover,
        "planner": _planner,
        "command": _command,
        "equates": _equates,
        "reduction_factor": _reduction_factor,
        "estimate": _estimate,
        "fldcat": _fldcat,
        "stat_info": _stat_info,
        "tblcat": _catalog("tblcat"),
        "idxcat": _catalog("idxcat"),
        "viewcat": _catalog("viewcat"),
    }
