from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from check import compare
from matchlens.llm.queries import OP8_SQL, ORACLES, QUERIES
from matchlens.llm.url_filters import host_of, intervals, judged, patterns_of

D = date(2024, 1, 1)


def day(n):
    return D + timedelta(n)


def plain(capture, entries):
    _, url, when = capture
    if url is None or when is None or "://" not in url:
        return "unlisted", None, 0
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, _, path = rest.partition("/")
    host = host.split(":")[0].lower()
    if not host:
        return "unlisted", None, 0
    labels, steps = host.split("."), [s for s in path.split("/") if s]
    keys = {".".join(labels[i:]) for i in range(len(labels))} | {"/".join([host, *steps[:i]]) for i in range(1, len(steps) + 1)}
    state = {}
    for name, pattern, action, at in sorted((e for e in entries if e[0] and e[1] and e[3] and e[2] in ("add", "remove")), key=lambda e: (e[3], e[2])):
        if pattern in keys and at <= when:
            state[name, pattern] = action
    on = [k for k, a in state.items() if a == "add"]
    if not on:
        return "unlisted", None, 0
    _, rank, name, pattern = max((len(p), n == "block", n, p) for n, p in on)
    return ("blocked" if rank else "allowed"), pattern, len(on)


def test_query_against_sql(spark, con):
    assert compare(QUERIES["op8_url_temporal_lists"](spark, "/root/testdata/sf0.001"), con, ORACLES["op8_url_temporal_lists"]) is None


def test_patterns(spark):
    urls = ["http://A.b.example.COM:80/x//y/z.html?q=/no#f", "https://h", "ftp://h/", "mailto:x", "", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(patterns_of(F.col("url"))).collect()]
    assert got[0] == ["a.b.example.com", "b.example.com", "example.com", "com", "a.b.example.com/x", "a.b.example.com/x/y", "a.b.example.com/x/y/z.html"]
    assert got[1:] == [["h"], ["h"], None, None, None]


def test_against_brute_force(spark):
    hosts = ["a.example.com", "b.example.com", "c.d.test.org", "h"]
    entries = [("block" if i % 3 else "allow", ["example.com", "a.example.com", "a.example.com/p", "org", "h/q/r", "test.org"][i * 7 % 6], "add" if i % 5 else "remove", day(i * 37 % 400)) for i in range(150)]
    entries += [("block", "h", "add", day(3)), ("block", "h", "remove", day(3)), (None, "h", "add", day(0)), ("allow", "h", "maybe", day(0)), ("allow", None, "add", day(1)), ("allow", "h", "add", None)]
    captures = [(i, f"http://{hosts[i % 4]}/{'pq'[i % 2]}/r/{i}", day(i * 11 % 420 - 5)) for i in range(300)]
    captures += [(None, "http://h/", day(9)), (7, None, day(9)), (8, "http://h", None), (9, "no url", day(1)), (9, "no url", day(1)), (10, "x://", day(1))]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetch_date date").withColumn("row", F.lit("r")).withColumn("pattern", F.lit(1)).withColumn("day", F.lit(2))
    lists = spark.createDataFrame(entries, "list string, pattern string, action string, date date")
    got = sorted(((r.page_id, r.url, r.fetch_date, r.decision, r.pattern, r.n_active) for r in judged(frame, lists).collect()), key=str)
    assert got == sorted(((*c, *plain(c, entries)) for c in captures), key=str)
    assert {r.decision for r in judged(frame, lists.limit(0)).collect()} == {"unlisted"}
    assert judged(frame.limit(0), lists).count() == 0 and intervals(lists.limit(0)).count() == 0


def test_hosts_without_user_port_and_final_dot(spark):
    want = {
        "http://user:pw@evil.com/x": "evil.com", "http://a@b@Evil.com:80?x@y": "evil.com", "https://[::1]:8080/a": "[::1]", "http://a.com./b": "a.com",
        "http://a.com:443#f": "a.com", "http://:80/": None, "http://./": None, "no url": None, "http:///x": None,
    }
    rows = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: r.host for r in rows.select("url", host_of(F.col("url")).alias("host")).collect()} == want
    import duckdb

    sql = OP8_SQL.split("nullif(", 1)[1].split("AS host", 1)[0]
    for url, host in want.items():
        assert duckdb.execute(f"SELECT nullif({sql} FROM (SELECT ? AS url)", [url]).fetchone()[0] == host
