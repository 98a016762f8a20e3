"""One behaviour each, on small CSV files and frames."""

import json
import math

import pytest

from tarnql.__main__ import main
from tarnql.errors import ColumnNotFoundError, SourceError, UnsupportedQueryError
from tarnql.functions.coerce import infer, number_text
from tarnql.model import Aggregate, AggregateKind, Comparator, Comparison, Kind, Relation
from tarnql.operators.aggregate import aggregate, aggregate_by_names
from tarnql.operators.filter import conjunction, filtered
from tarnql.operators.order import limited, ordered, ordered_by_name
from tarnql.operators.project import project, project_by_names
from tarnql.output import write_table
from tarnql.plans.parser import parse
from tarnql.plans.planner import sql
from tarnql.sources.csv import scan
from tarnql.sources.zonemap import ZoneMap, generate_zone_map, load_zone_map, pruned_scan, save_zone_map, zone_map_path, zone_maps


@pytest.fixture
def csv(tmp_path):
    def write(text: str, name: str = "t.csv") -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    return write


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kinds_come_from_the_first_row(spark, csv):
    rel = scan(spark, csv("i,f,s,e\n1,1.5,x,\n2,2,y,7\n"))
    assert rel.kinds == (Kind.INT, Kind.FLOAT, Kind.STRING, Kind.STRING)
    assert rows(rel.frame()) == [(1, 1.5, "x", ""), (2, 2.0, "y", "7")]


def test_cells_that_do_not_parse_are_zero(spark, csv):
    path = csv("k,v\na,1\nb,\nc,abc\nd,2.5\ne,4\n")
    assert rows(sql(spark, f"SELECT COUNT(v), SUM(v), MIN(v), MAX(v), AVG(v) FROM `{path}`")) == [(5, 5.0, 0.0, 4.0, 1.0)]


@pytest.mark.parametrize(
    ("cell", "kind"),
    [("5", Kind.INT), ("+5", Kind.INT), (" 5", Kind.STRING), ("1.5", Kind.FLOAT), ("1e3", Kind.FLOAT), (".5", Kind.FLOAT), ("5.", Kind.FLOAT), ("1d", Kind.STRING), ("NaN", Kind.FLOAT), ("-Inf", Kind.FLOAT), ("9223372036854775808", Kind.FLOAT), ("1e400", Kind.STRING), ("0x1p4", Kind.FLOAT), ("0x10", Kind.STRING), ("1_000", Kind.STRING), ("٣", Kind.STRING), ("5\n", Kind.STRING), ("", Kind.STRING)],
)
def test_number_grammar(spark, csv, cell, kind):
    assert infer(cell) is kind


def test_spark_coercion_follows_the_grammar(spark, csv):
    path = csv("i,f\n1,1.0\n 5,1d\n+7,.5\n1e3,1e400\n9223372036854775808,0x1p4\n-2,-Infinity\n")
    got = rows(scan(spark, path).frame())
    assert got == [(1, 1.0), (0, 0.0), (7, 0.5), (0, 0.0), (0, 16.0), (-2, -math.inf)]


def test_empty_text_is_a_value(spark, csv):
    path = csv("id,name\n1,x\n2,\n")
    assert rows(sql(spark, f"SELECT id FROM `{path}` WHERE name = ''")) == [(2,)]


@pytest.mark.parametrize("query", ["SELECT * FROM `{}`", "SELECT COUNT(*) FROM `{}`", "SELECT a FROM `{}`"])
def test_ragged_records_fail(spark, csv, query):
    with pytest.raises(Exception, match="(?i)malformed|fields"):
        sql(spark, query.format(csv("a,b\n1,2\n3\n"))).collect()


def test_literals_take_the_type_of_the_column(spark, csv):
    ages = csv("name,age\nann,25\nbob,26\n")
    assert rows(sql(spark, f"SELECT name FROM `{ages}` WHERE age = 25.9")) == [("ann",)]
    assert rows(sql(spark, f"SELECT name FROM `{ages}` WHERE age != '25'")) == []
    assert rows(sql(spark, f"SELECT name FROM `{ages}` WHERE age > -1.5 AND age < 99999999999999.0")) == [("ann",), ("bob",)]
    assert sorted(rows(sql(spark, f"SELECT code FROM `{csv('code' + chr(10) + 'A1' + chr(10) + '10' + chr(10) + '9' + chr(10), 'c.csv')}` WHERE code > 5"))) == [("9",), ("A1",)]


def test_nan(spark, csv):
    path = csv("x\n1.5\nNaN\n-2.5\n")
    assert rows(sql(spark, f"SELECT x FROM `{path}` WHERE x > 0")) == [(1.5,)]
    assert rows(sql(spark, f"SELECT MAX(x) FROM `{path}`")) == [(1.5,)]
    assert len(rows(sql(spark, f"SELECT x FROM `{path}` WHERE x != 1.5"))) == 2


def test_aggregates_of_text(spark, csv):
    assert rows(sql(spark, f"SELECT SUM(s), MIN(s), AVG(s), COUNT(s) FROM `{csv('s' + chr(10) + 'b' + chr(10) + 'a' + chr(10))}`")) == [(0.0, None, 0.0, 2)]


def test_header_only(spark, csv):
    path = csv("a,b\n")
    assert rows(sql(spark, f"SELECT * FROM `{path}`")) == []
    assert rows(sql(spark, f"SELECT COUNT(*), SUM(a), AVG(a) FROM `{path}`")) == [(0, 0.0, None)]
    assert rows(sql(spark, f"SELECT COUNT(*) FROM `{path}` GROUP BY a")) == []


def test_empty_and_missing_files(spark, csv, tmp_path):
    with pytest.raises(SourceError):
        scan(spark, csv(""))
    with pytest.raises(SourceError):
        scan(spark, str(tmp_path / "none.csv"))


def test_quotes_and_line_breaks_in_fields(spark, csv):
    assert rows(scan(spark, csv('id,t\n1,"a ""q"", b"\n2,"two\nlines"\n')).frame()) == [(1, 'a "q", b'), (2, "two\nlines")]


def test_names_are_case_sensitive_and_the_first_wins(spark, csv):
    path = csv("a,a,A\n1,2,3\n")
    assert rows(sql(spark, f"SELECT a FROM `{path}`")) == [(1,)]
    assert rows(sql(spark, f"SELECT A FROM `{path}`")) == [(3,)]


def test_groups(spark, csv):
    path = csv("c,v\nx,1\ny,2\nx,3\n")
    df = sql(spark, f"SELECT COUNT(*), c FROM `{path}` GROUP BY c ORDER BY COUNT(*) DESC")
    assert df.columns == ["c", "COUNT(*)"] and rows(df) == [("x", 2), ("y", 1)]
    assert sorted(rows(sql(spark, f"SELECT c FROM `{path}` GROUP BY c"))) == [("x",), ("y",)]


def test_several_order_keys_limit_and_offset(spark, csv):
    path = csv("k,v\n1,5\n2,5\n3,4\n")
    assert rows(sql(spark, f"SELECT k FROM `{path}` ORDER BY v, k DESC")) == [(3,), (2,), (1,)]
    assert rows(sql(spark, f"SELECT k FROM `{path}` ORDER BY k LIMIT 1 OFFSET 1")) == [(2,)]
    assert rows(sql(spark, f"SELECT k FROM `{path}` ORDER BY k LIMIT 2, 1")) == [(3,)]
    assert rows(sql(spark, f"SELECT k AS n FROM `{path}` ORDER BY n LIMIT 0")) == []


@pytest.mark.parametrize(
    "query",
    ["SELECT DISTINCT a FROM t", "SELECT a, COUNT(*) FROM t GROUP BY a HAVING a > 1", "SELECT COUNT(DISTINCT a) FROM t", "SELECT a FROM t WHERE a = 1 OR a = 2", "SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t WHERE a LIKE 'x'", "SELECT a FROM t WHERE a BETWEEN 1 AND 2", "SELECT a FROM t WHERE a IS NULL", "SELECT a FROM t JOIN u", "SELECT a FROM t, u", "SELECT a FROM (SELECT 1)", "SELECT a FROM t UNION SELECT a FROM t", "INSERT INTO t VALUES (1)", "SELECT UPPER(a) FROM t", "SELECT a + 1 FROM t", "SELECT a FROM t LIMIT 'x'", "SELECT a FROM t WHERE 1 = a", "SELECT a FROM t WHERE NOT a = 1", "SELECT a FROM t WHERE a = b", "SELECT *, COUNT(*) FROM t", "SELECT b, COUNT(*) FROM t GROUP BY a", "SELECT", "SELECT a FROM t WHERE a <=> 1", "SELECT SUM(*) FROM t"],
)
def test_unsupported_queries_say_so(spark, query):
    with pytest.raises(UnsupportedQueryError):
        sql(spark, query, {"t": spark.createDataFrame([(1, 2)], "a int, b int")})


@pytest.mark.parametrize("query", ["SELECT z FROM t", "SELECT a FROM t WHERE z = 1", "SELECT a FROM t ORDER BY z", "SELECT SUM(z) FROM t", "SELECT COUNT(*) FROM t GROUP BY z"])
def test_unknown_columns(spark, query):
    with pytest.raises(ColumnNotFoundError, match="z"):
        sql(spark, query, {"t": spark.createDataFrame([(1,)], "a int")})


def test_parser_details():
    q = parse("select t.a AS x, `odd name` y FROM 'dir/x.csv' AS t WHERE (t.a >= -1.5e2) AND b <> 'it''s' AND c = \"q\\\"\" ORDER BY x desc, b LIMIT 5;")
    assert [i.name for i in q.items] == ["x", "y"] and q.table == "dir/x.csv"
    assert [v for _, _, v in q.where] == [-150.0, "it's", 'q"']
    assert q.order_by == (("x", True), ("b", False)) and q.limit == 5
    assert parse("SELECT * FROM data.csv").table == "data.csv"


def test_number_text():
    assert [number_text(v) for v in (5, 1.5, 1e6, 1234567.8, 100000.0, 1e-5, 0.0001, -2.5e-7, 0.0, 1e21)] == ["5", "1.5", "1e+06", "1.2345678e+06", "100000", "1e-05", "0.0001", "-2.5e-07", "0", "1e+21"]


def test_operators_by_hand(spark):
    rel = Relation.of(spark.createDataFrame([(1, "x", 2.0), (2, "y", None), (3, "x", 4.0)], "k long, c string, v double"))
    assert rows(filtered(rel, Comparison(9, Comparator.EQ, 1)).frame()) == []
    assert len(rows(filtered(rel, conjunction([])).frame())) == 3
    assert rows(filtered(rel, rel.col(0) > 2).frame()) == [(3, "x", 4.0)]
    assert project(rel, []).frame().columns == ["k", "c", "v"]
    assert project(rel, [2, 7, 0]).frame().columns == ["v", "", "k"]
    assert project_by_names(rel, ["c", "nope"]).names == ("c", "")
    assert rows(aggregate(rel, [Aggregate(AggregateKind.COUNT, 2), Aggregate(AggregateKind.AVG, 2)]).frame()) == [(3, 2.0)]
    assert aggregate(rel, [Aggregate(AggregateKind.SUM, 0)]).names == ("SUM_0",)
    assert sorted(rows(aggregate_by_names(rel, ["c"], [Aggregate(AggregateKind.MAX, 0, "m")]).frame())) == [("x", 3.0), ("y", 2.0)]
    assert rows(aggregate(rel, [Aggregate(AggregateKind.COUNT)], [9]).frame()) == [(None, 3)]
    assert [r[0] for r in rows(ordered(rel, [(2, True)]).frame())] == [3, 1, 2]
    assert len(rows(ordered_by_name(rel, "nope").frame())) == 3
    assert [r[0] for r in rows(limited(ordered(rel, [(0, False)]), 1, 1).frame())] == [2]
    for bad in (lambda: limited(rel, -1), lambda: ordered(rel, [(0, False)], 0)):
        with pytest.raises(ValueError):
            bad()


def test_plans_prune_push_down_and_fuse(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS s").write.parquet(path)
    plan = sql(spark, f"SELECT id FROM `{path}` WHERE v > 10 ORDER BY id DESC LIMIT 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,10)]" in plan and "ReadSchema: struct<id:bigint,v:bigint>" in plan
    assert "TakeOrderedAndProject" in plan


def test_zone_map_of_a_file(spark, csv):
    path = csv("id,m,s\n1,1,a\n2,x,b\n")
    zm = generate_zone_map(spark, path)
    assert (zm.row_count, zm.min_values, zm.max_values) == (2, {"id": 1}, {"id": 2})
    at = save_zone_map(zm)
    assert at == zone_map_path(path) and json.loads(open(at).read())["row_count"] == 2
    assert load_zone_map(path) == zm and "id: [1, 2]" in zm.summary()


def test_pruned_scan_reads_only_files_that_may_match(spark, csv, tmp_path):
    csv("id\n1\n5\n", "parts/p1.csv")
    csv("id\n10\n20\n", "parts/p2.csv")
    folder = str(tmp_path / "parts")
    maps = zone_maps(spark, folder)
    assert [m.can_prune("id", Comparator.GT, 7) for m in maps] == [True, False]
    rel = pruned_scan(spark, folder, [("id", Comparator.GT, 7)], maps)
    assert sorted(rows(rel.frame())) == [(10,), (20,)] and all("p2" in f for f in rel.df.inputFiles())
    nothing = pruned_scan(spark, folder, [("id", Comparator.GT, 99)], maps)
    assert rows(aggregate(nothing, [Aggregate(AggregateKind.COUNT), Aggregate(AggregateKind.SUM, 0)]).frame()) == [(0, 0.0)]


def test_pruning_is_sound():
    for low in range(-2, 3):
        for high in range(low, 3):
            zm = ZoneMap("f", 1, {"x": low}, {"x": high})
            for value in range(-3, 4):
                held = range(low, high + 1)
                truth = {Comparator.EQ: value in held, Comparator.LT: low < value, Comparator.LTE: low <= value, Comparator.GT: high > value, Comparator.GTE: high >= value, Comparator.NEQ: any(v != value for v in held)}
                for op, some in truth.items():
                    assert zm.can_prune("x", op, value) == (not some)
            assert not zm.can_prune("y", Comparator.EQ, 0)


def test_command_line(spark, csv, capsys):
    path = csv("name,age\nann,25\nbob,\n")
    assert main(["query", f"SELECT name, age FROM `{path}` ORDER BY age"]) == 0
    assert capsys.readouterr().out.splitlines() == ["name\tage", "-" * 16, "bob\t0", "ann\t25", "(2 rows)"]
    assert main([f"SELECT MIN(name) FROM `{path}`"]) == 0 and "NULL" in capsys.readouterr().out
    assert main(["zm", path]) == 0 and "Rows: 2" in capsys.readouterr().out
    assert main(["help"]) == 0 and main([]) == 1 and main(["q"]) == 1
    assert main(["q", "SELECT nope FROM"]) == 1 and "Error" in capsys.readouterr().err


def test_table_writer(spark, capsys):
    assert write_table(spark.createDataFrame([(None, 1.5)], "a string, b double")) == 1
    assert capsys.readouterr().out == "a\tb\n" + "-" * 11 + "\nNULL\t1.5\n(1 rows)\n"


def test_count_of_a_literal_counts_rows(spark, csv):
    path = csv("a,b\n1,x\n2,y\n")
    assert rows(sql(spark, f"SELECT COUNT(1) AS n, COUNT('x') FROM `{path}`"))[0][0] == 2


def test_order_by_a_renamed_key(spark, csv):
    path = csv("c,v\ny,2\nx,1\ny,3\n")
    for name in ("c", "k"):
        assert rows(sql(spark, f"SELECT c AS k, COUNT(*) AS n FROM `{path}` GROUP BY c ORDER BY {name}")) == [("x", 1), ("y", 2)]


def test_long_first_cell(spark, csv):
    path = csv("a,b\n" + "x" * 200_000 + ",1\n")
    assert rows(sql(spark, f"SELECT b FROM `{path}`")) == [(1,)]


def test_pruned_files_are_never_read(spark, tmp_path):
    """In a folder with a blank in its name: the pruned file is gone, and the scan still answers."""
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "p1.csv").write_text("id\n1\n5\n")
    (folder / "p2.csv").write_text("id\n10\n20\n")
    maps = zone_maps(spark, str(folder))
    (folder / "p1.csv").unlink()
    assert sorted(rows(pruned_scan(spark, str(folder), [("id", Comparator.GT, 7)], maps).frame())) == [(10,), (20,)]
