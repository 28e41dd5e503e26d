import pytest
from engine_tables import SF
from pyspark.sql import functions as F

from driftgauge import tables
from driftgauge.conf import AqpConf
from driftgauge.functions import compat
from driftgauge.operators.rank_index import build_rank_index
from driftgauge.plans.sqlfront import AqpSession, constant, parse, split_top
from driftgauge.sources.files import copy_from, copy_to, read_tbl, write_tbl
from driftgauge.sources.views import MaterializedView


@pytest.fixture(scope="module")
def session(spark):
    s = AqpSession(spark, AqpConf(error_mode="relative"))
    line = tables.lineitem(spark, SF)
    s.register("lineitem", line, list(tables.LINEITEM_ID), [build_rank_index(line, "shipdate_julian", tables.LINEITEM_ID)])
    s.register("orders", tables.load(spark, SF, "orders"), ["o_orderkey"])
    part = tables.load(spark, SF, "part")
    s.register("part", part, ["p_partkey"], [build_rank_index(part, "p_size", ["p_partkey"])])
    s.register("facts", line, list(tables.LINEITEM_ID), [build_rank_index(line, "l_partkey", tables.LINEITEM_ID)])
    return s


def test_text_helpers(spark):
    assert split_top("a, f(b, c), 'x,y'", ",") == ["a", "f(b, c)", "'x,y'"]
    assert split_top("x BETWEEN 1 AND 5 AND y = 2", "AND") == ["x BETWEEN 1 AND 5", "y = 2"]
    assert constant("50*200") == 10000 and constant("(1 + 2) / 4") == 0.75
    with pytest.raises(ValueError):
        constant("null")
    q = parse("select g, approx_sum(a.x)/7.0 as m from t a tablesample swr(10) repeatable (3), u tablesample swr(1) where a.k = u.j and a.z > 1 group by g")
    assert q.driver.seed == 3 and [s.table for s in q.joined] == ["u"] and q.by == ["g"] and q.items[1].factor == pytest.approx(1 / 7)


def test_progressive_sql(session, spark):
    text = "select approx_count(*) as n, approx_count_star_half_ci(0.95) as e from lineitem tablesample pswr(20000, 50*40, 0.05, 0.95) where l_returnflag = 'R' and (shipdate_julian >= 2450084 and shipdate_julian < 2451545)"
    n, e = session.sql(text).first()
    truth = tables.lineitem(spark, SF).where("l_returnflag = 'R' and shipdate_julian >= 2450084 and shipdate_julian < 2451545").count()
    assert abs(n - truth) < 3 * e and e <= 0.05 * n
    assert "Sampling: PSWR" in session.explain(text)


def test_sampled_join_sql(session, spark):
    text = "SELECT o_orderpriority, approx_count(*) AS n, approx_count_star_half_ci(0.95) AS e FROM lineitem l TABLESAMPLE swr(3000) REPEATABLE (5) JOIN orders o TABLESAMPLE swr(1) ON o.o_orderkey = l.l_orderkey GROUP BY o_orderpriority"
    truth = {r[0]: r[1] for r in spark.sql("SELECT o_orderpriority, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1").collect()}
    got = session.sql(text).collect()
    assert {r[0] for r in got} == set(truth) and all(abs(r.n - truth[r[0]]) < 3 * r.e for r in got)
    assert session.explain(text) == "Sampling: SWR (3000) REPEATABLE (5)"
    fan = "SELECT approx_sum(l.l_quantity) AS q, approx_sum_half_ci(l.l_quantity, 0.95) AS e FROM part p TABLESAMPLE swr(4000) REPEATABLE (2) JOIN facts l TABLESAMPLE swr(1) ON p.p_partkey = l.l_partkey WHERE l.l_quantity < 20"
    q, e = session.sql(fan).first()
    exact = tables.lineitem(spark, SF).where("l_quantity < 20").agg(F.sum("l_quantity")).first()[0]
    assert abs(q - exact) < 3 * e


def test_standard_methods_and_errors(session):
    assert session.sql("SELECT count(*) FROM part p TABLESAMPLE system_rows(17)").first()[0] == 17
    a = session.sql("SELECT p_partkey FROM part TABLESAMPLE bernoulli(30) REPEATABLE (4)").collect()
    assert a == session.sql("SELECT p_partkey FROM part TABLESAMPLE bernoulli(30) REPEATABLE (4)").collect() and a
    assert session.sql("SELECT count(*) FROM part").first()[0] > len(a)
    with pytest.raises(ValueError):
        session.sql("SELECT approx_count(*) FROM part")
    with pytest.raises(ValueError):
        session.sql("SELECT approx_count(*) FROM orders TABLESAMPLE swr(10)")
    with pytest.raises(ValueError):
        session.sql("SELECT approx_count(*) AS n FROM part TABLESAMPLE swr(-1)")


def test_copy_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "plain", 1.5), (2, 'with "quotes", comma', None), (3, None, -2.0)], "id int, name string, x double")
    for kind in ("csv", "text"):
        copy_to(df, str(tmp_path / kind), fmt=kind, header=kind == "csv")
        back = copy_from(spark, str(tmp_path / kind), "id int, name string, x double", fmt=kind, header=kind == "csv")
        assert sorted(back.collect()) == sorted(df.collect())
    some = copy_from(spark, str(tmp_path / "csv"), "id int, name string, x double", header=True, columns=["name"], where="id = 1")
    assert [tuple(r) for r in some.collect()] == [("plain",)]
    write_tbl(df.where("id <> 2"), str(tmp_path / "tbl"))
    assert read_tbl(spark, str(tmp_path / "tbl"), "id int, name string, x double").count() == 2


def test_materialized_view(spark):
    spark.range(5).createOrReplaceTempView("base_rows")
    view = MaterializedView(spark, "SELECT count(*) AS n FROM base_rows")
    with pytest.raises(ValueError):
        view.read()
    view.refresh()
    spark.range(9).createOrReplaceTempView("base_rows")
    assert view.read().first().n == 5
    view.refresh()
    assert view.read().first().n == 9


def test_compat_values(spark):
    import hashlib
    import hmac

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(compat.gcd(F.lit(-12), F.lit(18))) == 6 and value(compat.gcd(F.lit(0), F.lit(0))) == 0 and value(compat.lcm(F.lit(4), F.lit(6))) == 12
    assert value(compat.sind(F.lit(30))) == 0.5 and value(compat.cosd(F.lit(60))) == 0.5 and value(compat.atand(F.lit(1.0))) == 45.0
    assert tuple(value(compat.justify_interval(compat.make_interval(F.lit(0), F.lit(29), F.lit(25 * 3600 * 10**6))))) == (1, 0, 3600 * 10**6)
    assert tuple(value(compat.age(F.lit("2024-03-15").cast("date"), F.lit("2023-01-10").cast("date")))) == (1, 2, 5)
    assert value(compat.hmac_sha256(b"key", F.lit("message"))) == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()
    assert value(compat.similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert value(compat.difference(F.lit("Anne"), F.lit("Ann"))) == 4
    r = compat.make_range(F.lit(1), F.lit(5))
    assert value(compat.range_contains(r, F.lit(5))) is False and value(compat.range_empty(compat.make_range(F.lit(3), F.lit(3)))) is True
    assert value(compat.similar_to(F.lit("abc"), "a_c")) and not value(compat.similar_to(F.lit("abcd"), "a_c"))
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None)], "g int, v double")
    assert df.groupBy("g").agg(compat.array_agg(F.col("v")).alias("a")).first().a == [2.0, 4.0, None]
    assert compat.hypothetical_dense_rank(df, F.col("v"), F.lit(4.0)).first()[0] == 2
    assert compat.hypothetical_percent_rank(df, F.col("v"), F.lit(4.0)).first()[0] == 0.5


def test_key_ranges():
    from datetime import date, datetime

    from driftgauge.plans.sqlfront import _equal_columns, _key_ranges

    keys = {"k": "long", "d": "date", "s": "string", "x": "double", "t": "timestamp"}
    one = lambda *c: _key_ranges(list(c), keys, _equal_columns(list(c)))
    assert one("k >= 3", "(k < 9 AND y = 1)") == ({"k": (3, 9)}, ["y = 1"])
    assert one("5 <= k", "7 > k") == ({"k": (5, 7)}, [])
    assert one("k IN (4, 9, 2)") == ({"k": (2, 10)}, ["k IN (4, 9, 2)"])
    assert one("k BETWEEN 2 AND 4", "z BETWEEN 1 AND 2") == ({"k": (2, 5)}, ["z BETWEEN 1 AND 2"])
    assert one("(k, y) > (3, 5)") == ({"k": (3, None)}, ["(k, y) > (3, 5)"])
    assert one("(k, y) < (3, 5)") == ({"k": (None, 4)}, ["(k, y) < (3, 5)"])
    assert one("k = other", "other = 7") == ({"k": (7, 8)}, ["k = other", "other = 7"])
    assert one("d >= date '2024-01-05'", "d <= date '2024-02-01'") == ({"d": (date(2024, 1, 5), date(2024, 2, 2))}, [])
    assert one("s = 'it''s'") == ({"s": ("it's", "it's\0")}, []) and one("s = 5") == ({}, ["s = 5"])
    assert one("t < timestamp '2024-01-01 10:00:00'") == ({"t": (None, datetime(2024, 1, 1, 10))}, [])
    low, high = one("x > 1.5", "x <= 2")[0]["x"]
    assert 1.5 < low < 1.5000001 and 2 < high < 2.0000001
    assert one("k >= 'a'", "k + 1 > 3", "NOT k = 3") == ({}, ["k >= 'a'", "k + 1 > 3", "NOT k = 3"])


def test_key_ranges_in_text(session, spark):
    base = "select approx_count(*) as n from part tablesample pswr(4000, 500, 0.05, 0.95) where "
    for where in ("p_size in (3, 40)", "(p_size, p_partkey) <= (20, 100)", "p_size between 5 and 9 and p_type = 'PROMO'"):
        out = session.sql(base + where).first().n
        truth = tables.load(spark, SF, "part").where(where if not where.startswith("(") else "p_size < 20 or (p_size = 20 and p_partkey <= 100)").count()
        assert abs(out - truth) <= max(5, 0.25 * truth), where


def test_string_and_date_keys(spark):
    from driftgauge.operators.estimators import approx_count
    from driftgauge.streaming.online import OnlineAggregator

    orders = tables.load(spark, SF, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    s = AqpSession(spark, AqpConf(error_mode="relative"))
    s.register("orders", orders, ["o_orderkey"], [build_rank_index(orders, "day", ["o_orderkey"]), build_rank_index(orders, "o_orderpriority", ["o_orderkey"])])
    for where in ("day >= date '1996-01-01' and day < date '1997-01-01'", "o_orderpriority = '2-HIGH'"):
        n = s.sql(f"select approx_count(*) as n from orders tablesample pswr(4000, 500, 0.05, 0.95) where {where}").first().n
        assert n == orders.where(where).count()  # the range says it all: every draw stands for the same weight
    index = build_rank_index(orders, "o_orderpriority", ["o_orderkey"])
    r = OnlineAggregator(index, AqpConf(optimization_strategy=2)).run({"n": approx_count()}, 1000, 100, abs_error=0.5, ranges={"o_orderpriority": ("2-HIGH", "2-HIGH\0")})
    assert r.strategy == "uniform" and not r.strata


def test_copy_options(spark, tmp_path):
    schema = "id int, name string, note string"
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"x', ""), (3, None, "n")], schema).coalesce(1)
    copy_to(df, str(tmp_path / "some"), header=True, force_quote=["name"])
    lines = [x for p in sorted((tmp_path / "some").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["id,name,note", '1,"a,b",', '2,"q""x",""', "3,,n"]
    copy_to(df, str(tmp_path / "all"), force_quote=True)
    assert [x for p in sorted((tmp_path / "all").glob("part-*")) for x in p.read_text().splitlines()][0] == '"1","a,b",'
    back = copy_from(spark, str(tmp_path / "some"), schema, header="match")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, "a,b", None), (2, 'q"x', ""), (3, None, "n")]
    with pytest.raises(Exception, match="(?i)header|schema"):
        copy_from(spark, str(tmp_path / "some"), "id int, wrong string, note string", header="match").collect()
    forced = copy_from(spark, str(tmp_path / "some"), schema, header=True, force_not_null=["name"], force_null=["note"])
    assert {r.id: (r.name, r.note) for r in forced.collect()} == {1: ("a,b", None), 2: ('q"x', None), 3: ("", "n")}


def test_cursor_edges(spark):
    from driftgauge.plans.cursor import Cursor

    c = Cursor(spark.range(10).select(F.col("id").alias("x")), ["x"])
    assert c.fetch(-1) == [] and [r[0] for r in c.fetch(3)] == [0, 1, 2] and c.move(100) == 7 and c.fetch(1) == []
    assert [r[0] for r in c.fetch(-2)] == [9, 8] and c.fetch_absolute(4)[0] == 3 and c.fetch_absolute(40) is None and c.fetch_absolute(-10)[0] == 0
    assert Cursor(spark.range(0), ["id"]).fetch(2) == []


def test_text_search_queries(spark):
    from driftgauge.functions import textsearch

    one = spark.createDataFrame([("The quick brown fox, the QUICK dog",)], "t string")
    ask = lambda q: one.select(textsearch.matches(textsearch.to_tsvector(F.col("t")), q)).first()[0]
    assert ask("quick <-> brown <-> fox") and ask("quick <2> fox") and not ask("brown <-> quick") and ask("!(cat | cow) & do:*") and not ask("fox & cat")
    for bad in ("quick brown", "quick &", "(quick", "<-> fox", "a ? b"):
        with pytest.raises(ValueError):
            ask(bad)
    v = one.select(textsearch.to_tsvector(F.col("t"), ("the",)).alias("v")).first().v
    assert [(r.word, r.place) for r in v] == [("brown", 3), ("dog", 7), ("fox", 4), ("quick", 2), ("quick", 6)]


def test_values_of_missing_types(spark):
    from driftgauge.functions import hashes, values

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(values.money(F.lit("($1,234.567)"))) == -value(values.money(F.lit("$1234.57"))) and value(values.money(F.lit("x"))) is None
    assert value(values.inet(F.lit("1.2.3.400"))) is None and value(values.network(values.inet(F.lit("192.168.5.77/20")))) == "192.168.0.0/20"
    assert value(hashes.hash_int8(F.lit(12345))) == value(hashes.hash_int4(F.lit(12345)))
    assert value(hashes.hash_int8(F.lit(-12345))) == value(hashes.hash_int4(F.lit(-12345)))


def test_exclude_current_of_infinite_rows(spark):
    import math

    from pyspark.sql import Window

    df = spark.createDataFrame([(1, 1.0), (2, math.inf), (3, 2.0), (4, None), (5, math.nan)], "i int, v double")
    got = [r.s for r in df.select("i", compat.exclude_current(F.col("v"), Window.orderBy("i"), 1, 1).alias("s")).orderBy("i").collect()]
    assert got[0] == math.inf and got[1] == 3.0 and got[2] == math.inf and math.isnan(got[3]) and got[4] is None
