"""Portal maps, landed calls, seen keys in buckets, and incremental runs."""

import hashlib
import json
import os
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from sluice.operators import postings
from sluice.sources import files, landing, portals
from sluice.sources.seen import SeenTable, mark_new
from sluice.streaming import calls as call_streams
from sluice.streaming import runs

ANSWER = "call_id string, portal string, source string, query string, remote_only boolean, most int, body string, exit_code int, stderr string"
RSS = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Jobs</title>
<item><title>Acme: Dev: Ops</title><link>https://w.org/1?a=1&amp;b=2</link><pubDate>Tue, 21 Jul 2026 23:59:00 +0000</pubDate><description><![CDATA[<p>hi &amp; ho</p>]]></description></item>
<item><title>No colon</title><link>https://w.org/2</link><region>EU only</region></item></channel></rss>"""


def answers(spark, *rows):
    full = [(r[0], r[1], *(list(r[2:-1]) + [None] * 4)[:4], r[-1], 0, "") for r in rows]
    return spark.createDataFrame(full, ANSWER)


def items(df):
    return {r["call_id"]: r["items"] and [i.toPython() for i in r["items"]] for r in portals.decode_portals(df).select("call_id", "items").collect()}


def test_every_portals_map(spark):
    job = {"description": "<b>a</b> &lt;"}
    got = items(answers(
        spark,
        ("a", "adzuna", json.dumps({"results": [{**job, "id": 12, "title": "T", "company": {"display_name": "C"}, "location": {"display_name": "L"}, "created": "2026-07-01T10:00:00Z", "redirect_url": "https://x", "salary_min": 48000, "salary_max": 55000.5}, {"salary_max": 3}, 5, {"title": 4, "company": "flat"}]})),
        ("b", "remotive", json.dumps({"0-warning": "w", "jobs": [{**job, "id": 1, "title": "T", "company_name": "C", "candidate_required_location": "L", "url": "u", "publication_date": "2026-07-01T10:00:00", "salary": ""}]})),
        ("c", "arbeitnow", json.dumps({"data": [{**job, "slug": "s-1", "title": "T", "company_name": "C", "location": "L", "url": "u", "created_at": 1704153599, "remote": False}]})),
        ("d", "wwr", RSS),
        ("e", "wwr", "himalayas", json.dumps({"jobs": [{**job, "guid": "g", "title": "T", "companyName": "C", "locationRestrictions": ["ES", "IT"], "applicationLink": "u", "pubDate": 1704153600000, "minSalary": 5, "maxSalary": 9}, {"applicationLink": "v"}]})),
        ("f", "infojobs", json.dumps({"offers": [{"id": "i", "title": "T", "author": {"name": "C"}, "province": {"value": "P"}, "link": "u", "updated": "2026-07-02T00:00:00.000Z", "teleworking": {"value": "Solo Teletrabajo"}, "salaryMin": {"value": 20}, "salaryMax": {"value": 30}, "requirementMin": "r"}, {"city": "Q", "teleworking": {"value": "no"}}]})),
        ("g", "linkedin", json.dumps({"results": [{"id": "z"}]}))))
    whole = lambda **k: {**dict.fromkeys(portals.FIELDS), **k}
    common = {"title": "T", "company": "C", "location": "L", "description": "a <"}
    assert got["a"] == [whole(**common, id="12", url="https://x", date="2026-07-01", salary="48000-55000.5 EUR"), whole(salary="3 EUR"), whole()]
    assert got["b"] == [whole(**common, id="1", url="u", date="2026-07-01", remote=True)]
    assert got["c"] == [whole(**common, id="s-1", url="u", date="2024-01-01", remote=False)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got["d"] == [
        whole(id=digest("https://w.org/1?a=1&b=2"), title="Dev: Ops", company="Acme", location="Remote", url="https://w.org/1?a=1&b=2", date="2026-07-21", description="hi & ho", remote=True, portal="wwr"),
        whole(id=digest("https://w.org/2"), title="No colon", location="EU only", url="https://w.org/2", remote=True, portal="wwr")]
    assert got["e"] == [whole(**{**common, "location": "ES, IT"}, id="g", url="u", date="2024-01-02", salary="5-9", remote=True, portal="himalayas"), whole(id=digest("v"), location="Remote", url="v", remote=True, portal="himalayas")]
    assert got["f"] == [whole(id="i", title="T", company="C", location="P", url="u", date="2026-07-02", salary="20-30", remote=True, description="r"), whole(location="Q")]
    assert got["g"] == [{"id": "z"}]


def test_local_search_and_limits(spark):
    jobs = [{"legal": "note"}, {"id": 1, "position": "Senior DEV", "tags": ["Python", "x"], "description": "remote", "salary_min": 1, "salary_max": 2}, {"id": 2, "position": "dev"}, {"id": 3, "position": "python", "description": "a dev", "salary_min": 0, "salary_max": 2}]
    data = {"data": [{"slug": f"s{i}", "title": "dev", "remote": i % 2 == 0} for i in range(5)]}
    got = items(answers(
        spark, ("a", "remoteok", None, " Python dev", json.dumps(jobs)), ("b", "remoteok", json.dumps(jobs)), ("c", "arbeitnow", None, "dev", True, json.dumps(data)),
        ("d", "arbeitnow", None, None, None, 2, json.dumps(data)), ("e", "remotive", None, "nothing such", json.dumps({"jobs": [{"id": 1}]})), ("f", "remoteok", None, "absent", json.dumps(jobs))))
    ids = {k: [x["id"] for x in v] for k, v in got.items()}
    assert ids == {"a": ["1", "3"], "b": ["1", "2", "3"], "c": ["s0", "s2", "s4"], "d": ["s0", "s1"], "e": ["1"], "f": []}
    assert [x["salary"] for x in got["b"]] == ["1-2", None, None] and got["b"][0]["location"] == "Worldwide"


def test_answers_that_are_none(spark):
    rows = answers(spark, ("a", "adzuna", "{"), ("b", "adzuna", "[]"), ("c", "adzuna", '{"results": {}}'), ("d", "wwr", "not a feed"), ("e", "nowhere", "{}"), ("f", "adzuna", None), ("g", "adzuna", " "), ("h", "wwr", "<rss><channel></channel></rss>"), ("i", "remoteok", "[]"))
    broken = spark.createDataFrame([("x", "adzuna", None, None, None, None, "{}", 2, '{"code":"NO_CREDENTIALS","message":"m"}'), ("y", "wwr", None, None, None, None, "", 7, "?")], ANSWER)
    got = {r["call_id"]: r["failure"] and (r["failure"]["code"], r["failure"]["expected"]) for r in portals.decode_portals(rows.unionByName(broken)).collect()}
    assert got == {
        "a": ("MALFORMED_JSON", False), "b": ("INVALID_ENVELOPE", False), "c": ("INVALID_ENVELOPE", False), "d": ("MALFORMED_XML", False), "e": ("UNKNOWN_PORTAL", False), "f": ("MALFORMED_JSON", False),
        "g": ("MALFORMED_JSON", False), "h": None, "i": None, "x": ("NO_CREDENTIALS", True), "y": ("PROCESS_EXIT_7", False)}


def land(root, plan, **parts):
    """Write a plan and the files of calls: stdout, stderr, status by call."""
    for kind, ending in (("plan", "json"), ("stdout", "json"), ("stderr", "stderr"), ("status", "json"), ("tick", "json")):
        (root / kind).mkdir(parents=True, exist_ok=True)
        if kind == "plan" and plan:
            (root / kind / f"{len(list((root / kind).iterdir()))}.json").write_text("\n".join(map(json.dumps, plan)))
        for call, body in parts.get(kind, {}).items():
            (root / kind / f"{call}.{ending}").write_bytes(body if isinstance(body, bytes) else body.encode())


def plan_of(now, **calls):
    return [{"call_id": c, "portal": p, "ordinal": i + 1, "planned_at": now + ago} for i, (c, (p, ago)) in enumerate(calls.items())]


OK = '{"results": []}'


def test_landed_parts_are_joined(spark, tmp_path):
    now = time.time()
    plan = plan_of(now, whole=("p", -10), running=("p", -10), dead=("q", -500), mute=("p", -100), late=("p", -1000), odd=("p", -10), bytes=("p", -10))
    land(tmp_path, plan, stdout={"whole": OK, "running": OK, "late": OK, "odd": " ", "bytes": b"\xff\xfe"}, stderr={"late": "e", "odd": "e", "bytes": "e"}, status={"whole": '{"exit_code": 0, "stderr_bytes": 0}', "mute": '{"exit_code": 3, "stderr_bytes": 0}', "late": '{"exit_code": 0}', "odd": "broken!", "bytes": '{"exit_code": 0}'})
    for part in ("stdout/late.json", "stderr/late.stderr"):
        os.utime(tmp_path / part, (now - 990, now - 990))
    parts = landing.read_parts(spark, str(tmp_path))
    matrix = landing.planned(parts)
    assert matrix.count() == 7
    got = {r["call_id"]: tuple(r)[1:] for r in landing.join_parts(matrix, parts, now).collect()}
    timeout = (landing.TIMED_OUT, landing.TIMEOUT)
    assert got == {"whole": ("p", 1, 0, OK, ""), "dead": ("q", 3, timeout[0], None, timeout[1]), "late": ("p", 5, timeout[0], OK, timeout[1]), "odd": ("p", 6, 1, " ", "e"), "bytes": ("p", 7, 0, None, "e")}
    later = {r["call_id"]: (r["exit_code"], r["stdout"]) for r in landing.join_parts(matrix, parts, now + 1000).collect()}
    assert later["running"] == (124, OK) and later["mute"] == (3, None) and len(later) == 7
    codes = {r["call_id"]: r["failure"] and r["failure"]["code"] for r in files.decode_calls(landing.join_parts(matrix, parts, now + 1000)).collect()}
    assert codes == {"whole": None, "running": "TIMEOUT", "dead": "TIMEOUT", "mute": "PROCESS_EXIT_3", "late": "TIMEOUT", "odd": "PROCESS_EXIT_1", "bytes": "MALFORMED_JSON"}


def drain(stream, tmp_path, name):
    out = str(tmp_path / name)
    q = stream.writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()
    return sorted((tuple(r) for r in stream.sparkSession.read.schema(call_streams.CALL).json(out).collect()), key=str)


def test_streamed_calls_settle_once(spark, tmp_path):
    """Whole calls at once, overdue ones by their timer, late parts never again; over several starts of the stream, with a moved clock."""
    root, now = tmp_path / "land", 1_700_000_000

    def at(seconds, plan=(), **parts):
        before = {p for p in root.glob("*/*")}
        land(root, plan, **parts)
        for p in {p for p in root.glob("*/*")} - before:
            os.utime(p, (now + seconds, now + seconds))

    start = lambda: drain(call_streams.call_stream(landing.stream_parts(spark, str(root))), tmp_path, "calls")
    at(1, plan_of(now, whole=("p", 0), dead=("q", 0), slow=("p", 0), mute=("p", 0)), stdout={"whole": OK, "slow": OK, "dead": OK}, status={"whole": '{"exit_code": 0, "stderr_bytes": 0}', "mute": '{"exit_code": 3}'})
    assert start() == [("whole", "p", 1, 0, OK, "")]
    at(100, stderr={"slow": "e"}, status={"slow": '{"exit_code": 2}'})
    assert start() == [("slow", "p", 3, 2, OK, "e"), ("whole", "p", 1, 0, OK, "")]
    at(200, tick={"t1": "x"})
    settled = [("dead", "q", 2, 124, OK, landing.TIMEOUT), ("mute", "p", 4, 3, None, None), ("slow", "p", 3, 2, OK, "e"), ("whole", "p", 1, 0, OK, "")]
    assert start() == settled
    at(300, stdout={"mute": OK}, stderr={"dead": "e", "mute": "e"}, status={"dead": '{"exit_code": 0}'})
    assert start() == settled
    parts = landing.read_parts(spark, str(root))
    assert sorted((tuple(r) for r in landing.join_parts(landing.planned(parts), parts, now + 400).collect()), key=str) == settled


def test_seen_state_survives_its_own_format(spark, tmp_path):
    path = str(tmp_path / "seen_jobs.json")
    (tmp_path / "seen_jobs.json").write_text('{"version":1,"seen":{"a:1":"t0"}}')
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    for i, more in enumerate((("a:1", "b:2"), ("b:2", "c:3"), ("c:3",))):
        seen, failures = files.load_seen(spark, path, f"s{i}")
        assert failures == []
        assert files.write_seen(postings.update_seen(seen, keys(*more), f"t{i + 1}"), path, failures)
    assert {tuple(r) for r in files.load_seen(spark, path, "s")[0].collect()} == {("a:1", "t0"), ("b:2", "t1"), ("c:3", "t2")}
    assert not [p for p in tmp_path.iterdir() if "corrupt" in p.name]
    assert {r["key"] for r in files.load_seen(spark, path, "s", below=2)[0].collect()} <= {"a:1", "b:2", "c:3"}


def test_seen_table_is_not_shuffled(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path / "seen"), buckets=4)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    table.add(keys("a:1", "a:2", None, "a:1"), "t0", 0)
    table.add(keys("a:2", "b:1"), "t1", 1)
    table.add(keys("a:2", "b:1", "b:2"), "t1", 1)  # the same batch again takes the first one's place
    table.add(keys("b:2", "c:1"), "t2", 2)
    want = {("a:1", "t0"), ("a:2", "t0"), ("b:1", "t1"), ("b:2", "t1"), ("c:1", "t2")}
    assert {tuple(r) for r in table.keys().collect()} == want and {r["key"] for r in table.keys(1).collect()} == {"a:1", "a:2"}
    again = SeenTable(spark, str(tmp_path / "seen"), buckets=16)
    assert again.buckets == 4 and {tuple(r) for r in again.keys().collect()} == want
    rows = spark.createDataFrame([("a", "1"), ("c", "1"), ("d", "1"), ("a", None), (None, "1")], "portal string, id string")
    assert {(r["portal"], r["id"]): r["new"] for r in mark_new(rows, again, 2).collect()} == {("a", "1"): False, ("c", "1"): True, ("d", "1"): True, ("a", None): False, (None, "1"): True}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = again.known(spark.range(1000).select(F.col("id").cast("string").alias("key")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(key") <= 2 and re.search(r"Bucketed: true", plan)
    assert "Exchange" not in plan[plan.index("FileScan") - 200 : plan.index("FileScan")]
    again.compact()
    assert {tuple(r) for r in again.keys().collect()} == want and {tuple(r) for r in SeenTable(spark, str(tmp_path / "seen")).keys().collect()} == want
    again.add(keys("e:1"), "t3", 3)
    assert again.keys().count() == 6 and len([p for p in (tmp_path / "seen").iterdir() if p.name.startswith("generation-")]) == 1


def test_one_of_many_writers_makes_a_file(spark, tmp_path):
    path, got = str(tmp_path / "lock"), []
    threads = [threading.Thread(target=lambda i=i: got.append(runs.write_once(spark, path, str(i)))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 8 and len(set(got)) == 1
    with runs.lease(spark, str(tmp_path / "lease")) as first:
        with runs.lease(spark, str(tmp_path / "lease")) as second:
            assert first and not second
        with runs.lease(spark, str(tmp_path / "lease"), stale_after=-1) as third:
            assert third
    with runs.lease(spark, str(tmp_path / "lease")) as again:
        assert again


def call(i, portal, *ids, exit_code=0):
    jobs = [{"id": x, "title": f"Title {x}", "company": "Co", "url": f"https://e.org/{x}", "date": f"2024-01-{x % 28 + 1:02}"} for x in ids]
    return (f"c{i}", portal, i, exit_code, json.dumps({"results": jobs}), '{"code": "NO_CREDENTIALS"}' if exit_code else "")


def outcome(spark, out, seen):
    tables = [spark.read.parquet(f"{out}/{x}") for x in ("results", "failures", "counters")]
    rows = [sorted((tuple(map(str, r)) for r in t.select(sorted(t.columns)).collect())) for t in tables]
    return rows + [sorted((r["key"], r["first_seen_at"]) for r in SeenTable(spark, seen).keys().collect())]


@pytest.mark.parametrize("killed", ["failures", "seen"])
def test_a_killed_run_equals_a_clean_one(spark, tmp_path, monkeypatch, killed):
    source = str(tmp_path / "calls")
    batches = [[call(1, "adzuna", 1, 2), call(2, "remotive", 2, 3), call(3, "infojobs", exit_code=2)], [call(4, "adzuna", 2, 4), call(5, "remotive", 3, 5)]]
    work = lambda name, now: runs.run_available(spark.readStream.schema(call_streams.CALL).parquet(source), str(tmp_path / f"{name}-seen"), str(tmp_path / name), str(tmp_path / f"{name}-at"), now, buckets=2)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, call_streams.CALL).coalesce(1).write.mode("append").parquet(source)
        assert work("clean", f"t{i}")
        if i == 1:
            # The second run dies before or inside one of its four outputs.
            write, add = files.write_run, SeenTable.add

            def stop(*a, **k):
                raise RuntimeError("killed")

            with monkeypatch.context() as m:
                if killed == "seen":
                    m.setattr(SeenTable, "add", stop)
                else:
                    m.setattr(files, "write_run", lambda df, path, *a: stop() if path.endswith(killed) else write(df, path, *a))
                with pytest.raises(Exception, match="killed"):
                    work("dead", "t1")
            assert SeenTable.add is add
        assert work("dead", f"t{i}" if i == 0 else "later")
    want, got = outcome(spark, str(tmp_path / "clean"), str(tmp_path / "clean-seen")), outcome(spark, str(tmp_path / "dead"), str(tmp_path / "dead-seen"))
    assert got == want and len(want[3]) == 6
    results, failures, counters = runs.latest(spark, str(tmp_path / "dead"))
    assert [(r["portal"], r["id"], r["new"], r["source_ids"]) for r in results.collect()] == [("remotive", "5", True, ["remotive:5"]), ("adzuna", "4", True, ["adzuna:4"]), ("remotive", "3", False, ["remotive:3"]), ("adzuna", "2", False, ["adzuna:2"])]
    c = counters.first()
    assert (c["calls"], c["results"], c["new"], c["seen"], failures.count()) == (2, 4, 2, 2, 0)
    assert work("dead", "t9") and outcome(spark, str(tmp_path / "dead"), str(tmp_path / "dead-seen")) == want  # nothing new: nothing done




def test_postings_that_share_a_url_keep_a_row_each(spark, tmp_path):
    """Pages 4, 13 and 22 are of the feed, whose key is the URL's digest: two share one."""
    import duckdb

    from sluice.plans.queries import ORACLE_SQL, QUERIES

    html = '<html lang="en"><title>t</title></html>'
    pages = [(i, "https://x.example.com/" + ("same" if i in (4, 13) else str(i)), html) for i in (0, 2, 4, 8, 13, 22, 49)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in QUERIES["scrape_runs"](spark, str(tmp_path)).select("key", "first_seen_at").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(ORACLE_SQL["scrape_runs"]).fetchall()
    assert sorted(got) == sorted(want)
    assert len(got) == len(set(got)) + 1
