"""Lexer, parser and syntax trees, by the rules of the grammar."""

import pytest

from harrow.errors import BadSyntaxError
from harrow.plans.ast import (
    CreateIndex,
    CreateTable,
    CreateView,
    Delete,
    FieldDef,
    FieldRef,
    Insert,
    Literal,
    Predicate,
    Query,
    Term,
    Update,
)
from harrow.plans.lexer import tokens
from harrow.plans.parser import parse_command, parse_query

KEY = Predicate((Term(FieldRef("n_nationkey"), Literal(7)),))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select n_name from nation", Query(("n_name",), ("nation",))),
        ("SELECT N_NAME, n_RegionKey FROM Nation", Query(("n_name", "n_regionkey"), ("nation",))),
        ("select n_name from nation where n_nationkey = 7", Query(("n_name",), ("nation",), KEY)),
        ("select n_name from nation where 7 = n_nationkey", Query(("n_name",), ("nation",), Predicate((Term(Literal(7), FieldRef("n_nationkey")),)))),
        ("\tselect n_name\nfrom nation ;", Query(("n_name",), ("nation",))),
        (
            "select o_orderkey, c_name from orders, customer where o_custkey = c_custkey and o_orderstatus = 'F' and 1 = 1",
            Query(
                ("o_orderkey", "c_name"),
                ("orders", "customer"),
                Predicate((
                    Term(FieldRef("o_custkey"), FieldRef("c_custkey")), Term(FieldRef("o_orderstatus"), Literal("F")), Term(Literal(1), Literal(1)),
                )),
            ),
        ),
        ("select p_name from part where p_brand = 'Brand#11 and = ;'", Query(("p_name",), ("part",), Predicate((Term(FieldRef("p_brand"), Literal("Brand#11 and = ;")),)))),
    ],
)
def test_query(text, want):
    assert parse_query(text) == want
    assert parse_query(str(want)) == want


@pytest.mark.parametrize(
    "text",
    [
        "",
        ";",
        "select from nation",
        "select n_name",
        "select n_name nation",
        "select n_name from",
        "select n_name,, n_regionkey from nation",
        "select n_name from nation, where n_nationkey = 1",
        "select n_name from nation where",
        "select n_name from nation where n_nationkey",
        "select n_name from nation where n_nationkey = ",
        "select n_name from nation where n_nationkey > 1",
        "select n_name from nation where n_nationkey = 1 and",
        "select n_name from nation where n_nationkey = 1 n_regionkey = 2",
        "select n_name from nation group by n_name",
        "select n_name from nation; select n_name from nation",
        "select count(n_name) from nation",
        "select n_name from nation where n_nationkey = 2147483648",
        "select n_name from nation where n_nationkey = -7",
        "select n_name from nation where n_name = 'no end",
        "select where from nation",
        "delete from nation",
    ],
)
def test_query_errors(text):
    with pytest.raises(BadSyntaxError, match="^bad syntax: "):
        parse_query(text)


COMMANDS = [
    ("insert into region (r_name, r_regionkey) values ('OCEANIA', 2147483647)", Insert("region", ("r_name", "r_regionkey"), (Literal("OCEANIA"), Literal(2147483647)))),
    ("delete from nation where n_nationkey = 7;", Delete("nation", KEY)),
    ("Delete From Nation", Delete("nation")),
    ("update nation set n_name = 'X' where n_nationkey = 7", Update("nation", "n_name", Literal("X"), KEY)),
    ("update nation set n_regionkey = n_nationkey", Update("nation", "n_regionkey", FieldRef("n_nationkey"))),
    ("create table shop (s_id int, s_town varchar(30))", CreateTable("shop", (FieldDef("s_id"), FieldDef("s_town", 30)))),
    ("create view seventh as select n_name from nation where n_nationkey = 7", CreateView("seventh", Query(("n_name",), ("nation",), KEY))),
    ("create index shop_town on shop (s_town)", CreateIndex("shop_town", "shop", "s_town")),
]


@pytest.mark.parametrize(("text", "want"), COMMANDS)
def test_command(text, want):
    assert parse_command(text) == want
    assert parse_command(str(want)) == want


@pytest.mark.parametrize(
    "text",
    [
        "",
        "select n_name from nation",
        "insert into region values (1)",
        "insert into region (r_name) values ()",
        "insert into region (r_name) values (r_name)",
        "delete nation",
        "update nation set n_name where n_nationkey = 7",
        "update nation n_name = 'X'",
        "create table shop ()",
        "create table shop (s_id int",
        "create table shop (s_id bigint)",
        "create table shop (s_town varchar)",
        "create table shop (s_town varchar('9'))",
        "create view seventh select n_name from nation",
        "create index on shop (s_town)",
        "create index shop_town on shop",
        "create function f",
        "drop table shop",
    ],
)
def test_command_errors(text):
    with pytest.raises(BadSyntaxError):
        parse_command(text)


def test_tokens():
    found = [(t.kind, t.value) for t in tokens("Select x_1,'It is; AND' FROM t where 042=y")]
    assert found == [
        ("keyword", "select"), ("name", "x_1"), ("delim", ","), ("string", "It is; AND"), ("keyword", "from"), ("name", "t"),
        ("keyword", "where"), ("int", 42), ("delim", "="), ("name", "y"), ("end", ""),
    ]


def test_equated():
    p = Predicate((Term(Literal("F"), FieldRef("o_orderstatus")), Term(FieldRef("o_custkey"), FieldRef("c_custkey")), Term(Literal(1), Literal(1))))
    assert p.constant_for("o_orderstatus") == Literal("F") and p.constant_for("o_custkey") is None
    assert p.field_for("c_custkey") == "o_custkey" and p.field_for("o_custkey") == "c_custkey" and p.field_for("o_orderstatus") is None
    assert p.applies_to(["O_OrderStatus", "o_custkey", "c_custkey"]) and not p.applies_to(["o_custkey", "c_custkey"])
    assert Predicate().applies_to([])
