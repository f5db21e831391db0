import datetime as dt

import duckdb

from voxelloom.llm import queries, urlfilter as u

CAPTURE = "page_id long, url string, fetched timestamp"
ENTRY = "entry_id long, kind string, value string, change string, action string, at timestamp"


def day(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.execute("SELECT page_id, url, host, n_active, verdict, entry_id FROM (" + queries.ORACLES["op6_url_filter"] + ")").fetchall())
    got = sorted(tuple(r) for r in queries.op6_url_filter(spark, sf).collect())
    assert got == want and len({g[4] for g in got}) > 1


def test_entries_hold_from_their_time_to_the_next(spark):
    entries = [
        (1, "domain", "a.com", "add", "block", day(10)),
        (2, "domain", "a.com", "remove", "block", day(20)),
        (3, "domain", "a.com", "add", "block", day(30)),
        (4, "host", "x.a.com", "add", "allow", day(12)),
        (5, "prefix", "x.a.com/p/q", "add", "block", day(0)),
        (6, "prefix", "x.a.com/p/q", "remove", "block", day(0)),
        (7, "host", "tie.com", "remove", "block", day(5)),
        (8, "host", "TIE.com", "add", "block", day(5)),
        (9, None, "a.com", "add", "block", day(1)),
        (10, "host", "b.com", "add", "block", None),
    ]
    url = "http://user:pw@X.A.com.:80/p/q/r?z=1#f"
    captures = [(1, url, day(9)), (2, url, day(10)), (3, url, day(12)), (4, "https://a.com", day(19)), (5, "https://a.com", day(20)), (6, "https://ba.com/", day(40)), (7, "http://tie.com/", day(5))]
    captures += [(8, None, day(11)), (9, "nonsense", day(11)), (10, url, None), (11, "https://a.com", day(30)), (11, "https://a.com", day(30)), (12, "http://b.com", day(9)), (13, "http://" + "s." * 2000 + "a.com/" + "p/" * 2000, day(31))]
    got = u.apply_lists(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(entries, ENTRY)).collect()
    assert len(got) == len(captures)
    by = {r.page_id: (r.n_active, r.verdict, r.entry_id) for r in got}
    assert [by[k] for k in range(1, 14)] == [
        (0, "none", None), (1, "block", 1), (2, "allow", 4), (1, "block", 1), (0, "none", None), (0, "none", None), (1, "block", 8),
        (0, "none", None), (0, "none", None), (0, "none", None), (1, "block", 3), (0, "none", None), (1, "block", 3),
    ]


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], ENTRY)
    rows = spark.createDataFrame([(1, "http://a.com", day(1), "x", 5)], CAPTURE + ", verdict string, entry_id int")
    assert [tuple(r) for r in u.apply_lists(rows, none).collect()] == [(1, "http://a.com", day(1), "a.com", 0, "none", None)]
    assert u.apply_lists(spark.createDataFrame([], CAPTURE), none).count() == 0


def test_internal_names_and_many_rows_of_a_url(spark):
    entries = spark.createDataFrame([(1, "host", "a.com", "add", "block", day(0))], ENTRY)
    rows = [(k, "http://a.com/x", day(1), f"p{k}", k) for k in range(50)] + [(99, "http://b.com", None, "q", 0)]
    got = u.apply_lists(spark.createDataFrame(rows, CAPTURE + ", _path string, _n int"), entries)
    assert got.columns == ["page_id", "url", "fetched", "_path", "_n", "host", "n_active", "verdict", "entry_id"]
    assert sorted((r.page_id, r["_path"], r["_n"], r.verdict) for r in got.collect()) == [(k, f"p{k}", k, "block") for k in range(50)] + [(99, "q", 0, "none")]


def test_plan_has_no_python(spark, sf):
    plan = queries.op6_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
