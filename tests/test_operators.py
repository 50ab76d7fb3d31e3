import pytest
from pyspark.sql import functions as F
from sluice.operators import postings, ranking, tracker
from sluice.sources import files
from sluice.streaming import state


def test_dedup_joins_groups_over_a_bridge_row(spark):
    rows = [(0, "p", "1", "A", "X", "http://e.org/1", False), (1, "q", "2", "B", "X", "http://e.org/2", False), (2, "r", "3", "b", "x", "http://e.org/1/", True), (3, "p", None, None, None, None, False), (4, "p", "5", None, None, None, False)]
    df = spark.createDataFrame(rows, "pos int, portal string, id string, title string, company string, url string, new boolean")
    got = {r["pos"]: (r["size"], r["new"], r["source_ids"], r["duplicate_sources"]) for r in postings.deduplicate(df).collect()}
    assert got == {0: (3, True, ["p:1", "q:2", "r:3"], ["p", "q", "r"]), 3: (1, False, [], ["p"]), 4: (1, False, ["p:5"], ["p"])}


def test_components_follow_long_chains(spark):
    rows = spark.range(40).select(F.col("id").alias("pos"), F.floor((F.col("id") + 1) / 2).cast("string").alias("a"), F.floor(F.col("id") / 2).cast("string").alias("b"))
    assert {r["root"] for r in postings.components(rows, "pos", ["a", "b"]).collect()} == {0}


@pytest.mark.parametrize(("n", "size", "waves", "want"), [(12, 5, None, [5, 5, 2]), (135, 50, 3, [45, 45, 45]), (100, 50, 3, [34, 33, 33]), (200, 50, 3, [50] * 4), (120, 30, 4, [30] * 4), (2, 5, 3, [1, 1])])
def test_waves(spark, n, size, waves, want):
    got = ranking.in_waves(spark.range(n), [F.col("id")], size, waves).groupBy("wave").agg(F.count("*").alias("c"), F.max("place").alias("m")).orderBy("wave").collect()
    assert [r["c"] for r in got] == want and all(r["m"] == r["c"] - 1 for r in got)


def test_seen_keeps_old_stamps(spark):
    old = spark.createDataFrame([("a:1", "t0")], "key string, first_seen_at string")
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", None)], "portal string, id string")
    assert {r["id"]: r["new"] for r in postings.mark_new(rows, old).collect()} == {"1": False, "2": True, None: False}
    keys = spark.createDataFrame([("a:1",), ("a:2",), (None,)], "key string")
    assert {tuple(r) for r in postings.update_seen(old, keys, "t1").collect()} == {("a:1", "t0"), ("a:2", "t1")}


def test_last_writer_and_gate(spark):
    a, b = spark.createDataFrame([("k", 1), ("l", 1)], "job_key string, v int"), spark.createDataFrame([("k", 2)], "job_key string, v int")
    assert {tuple(r) for r in ranking.last_writer(a, b).collect()} == {("k", 2), ("l", 1)}
    told = lambda bad, n: spark.createDataFrame([("c" if i < bad else None,) for i in range(n)], "code string")
    assert [ranking.failure_gate(told(*x)).first()["aborted"] for x in ((3, 10), (4, 10), (2, 2))] == [False, True, False]


def test_review_errors_and_redaction(spark):
    base = ("a:1", 8.4, "A", "APLICAR", ["x"] * 3, ["y"] * 3, "", "n")
    change = lambda **k: tuple({**dict(zip(ranking.REVIEW, base, strict=True)), **k}[c] for c in ranking.REVIEW)
    rows = [base, change(job_key="b:2"), change(score=8.04), change(score=float("nan")), change(tier="VETO"), change(strengths=["x", " ", "z"]), change(notes=None)]
    df = spark.createDataFrame(rows, "job_key string, score double, tier string, verdict string, strengths array<string>, gaps array<string>, salary string, notes string")
    got = [r[0] for r in df.select(ranking.review_error(F.lit("a:1"))).collect()]
    assert got == [None, "another job_key than asked for", "score outside 0 to 10 in tenths", "score outside 0 to 10 in tenths", "veto not discarded", "not three strengths", "salary or notes missing"]
    out = ranking.redact_reviews(spark.createDataFrame([change(gaps=["a@b.org", "y", "y"])], df.schema)).first()
    assert out["gaps"][0] == "[EMAIL_REDACTED]" and out["notes"].endswith("persisted.") and not out["contact_remains"]


def test_envelope_ladder(spark):
    rows = [("a", "p", 0, '{"results":[5,{"id":7,"title":3,"url":"https://x.org"}]}', ""), ("b", "p", 2, "", '{"code":"NO_CREDENTIALS"}'), ("c", "p", 2, "", "boom"), ("d", "p", 0, " ", ""), ("e", "p", 0, "[]", ""), ("f", "p", 0, '{"results":1}', ""), ("g", "p", 0, None, "")]
    decoded = files.decode_calls(spark.createDataFrame(rows, "call_id string, portal string, exit_code int, stdout string, stderr string"))
    codes = {r["call_id"]: r["failure"] and (r["failure"]["code"], r["failure"]["expected"]) for r in decoded.collect()}
    assert codes == {"a": None, "b": ("NO_CREDENTIALS", True), "c": ("PROCESS_EXIT_2", False), "d": ("MALFORMED_JSON", False), "e": ("INVALID_ENVELOPE", False), "f": ("INVALID_ENVELOPE", False), "g": ("MALFORMED_JSON", False)}
    assert [(r["id"], r["title"], r["url"]) for r in postings.normalize(decoded).collect()] == [("7", None, "https://x.org")]


def test_tracker_upsert_and_gate(spark):
    have = spark.createDataFrame([(0, "2024-01-01", "Acme", "Dev", "", "http://u/1", "", "", "applied", "", ""), (1, "2024-01-01", "Beta", "Ops", "", "", "", "", "", "", "")], "pos long, fecha string, empresa string, rol string, portal string, url string, tier string, score string, estado string, `próxima acción` string, notas string")
    patches = spark.createDataFrame([("ACME", "dev", "http://u/2", "8.44"), ("beta", "OPS", "http://u/3", None), ("Other", "X", "http://u/1", "3")], "empresa string, rol string, url string, score string")
    got = {(r["url"], r["empresa"], r["fecha"], r["score"], r["estado"]) for r in tracker.upsert(have, patches, "2024-02-02").collect()}
    assert got == {("http://u/1", "Other", "2024-01-01", "3.0", "applied"), ("http://u/2", "ACME", "2024-02-02", "8.4", "draft"), ("http://u/3", "beta", "2024-01-01", "", "draft")}
    states = spark.createDataFrame([("applied", 0, "2024-01-01"), ("applied", 2, "2024-01-01"), ("offer", 0, "2024-01-01"), ("applied", 0, "2024-01-05")], "status string, followups int, last_activity string")
    assert [r["refusal"] for r in tracker.followup_gate(states, F.lit(1), F.lit("2024-01-11")).collect()] == [None, "limit", "status", "too_early"]


def test_overlap_counts_each_probe(spark):
    rows = lambda x: spark.createDataFrame(x, "title string, company string")
    r = ranking.overlap_report(rows([("A ", "b"), ("a", "B"), ("c", None)]), rows([("a", "b")])).first()
    assert (r["total"], r["duplicates"], r["fresh"], r["recommendation"]) == (3, 2, 1, "keep_off")


def test_streams(spark, tmp_path):
    """The state follows seq and the latest day, whatever order and batches events come in."""
    shape = "key string, status string, seq long, day string, followup boolean"
    first = [("a", f"s{i}", i, "2024-01-01", False) for i in range(40)] + [("a", "applied", 50, "2024-01-05", False)]
    for n, rows in enumerate((first[::-1], [("a", "rejected", 60, "2024-01-06", True)], [("a", "late", 55, "2024-01-02", False), ("a", None, 70, "2024-01-04", True)])):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema(shape).json(str(tmp_path / "in"))
        q = state.outcome_stream(source).writeStream.outputMode("update").format("memory").queryName(f"folded{n}").option("checkpointLocation", str(tmp_path / "folded")).trigger(availableNow=True).start() if n == 0 else None
        if n == 0:
            q.awaitTermination(120)
            assert [tuple(r) for r in spark.table("folded0").collect()] == [("a", "applied", 0, "2024-01-05", None)]
    out = str(tmp_path / "states")

    def keep(df, i):
        df.write.mode("append").parquet(out)

    q = state.outcome_stream(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "batches")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    best = spark.read.parquet(out).orderBy(F.desc("followups")).first()
    assert tuple(best) == ("a", "rejected", 2, "2024-01-06", "2024-01-06")
    q = state.first_sight(source, "key").writeStream.outputMode("append").format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "firsts")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 1


def test_atomic_write_and_seen_file(spark, tmp_path):
    for n in (3, 5):
        files.write_atomic(spark.range(n), str(tmp_path / "t"), keep=1)
    (tmp_path / "t" / "version=9").mkdir()  # an attempt that was cut short
    assert files.read_atomic(spark, str(tmp_path / "t")).count() == 5 and files.write_atomic(spark.range(7), str(tmp_path / "t")) == 10
    assert files.read_atomic(spark, str(tmp_path / "t")).count() == 7
    with pytest.raises(FileNotFoundError):
        files.read_atomic(spark, str(tmp_path / "none"))
    for body, code in (('{"version":1,"seen":{"a:1":"t"}}', None), ('{"version":2,"seen":{}}', "STATE_UNSUPPORTED_VERSION"), ("{", "STATE_RESET_CORRUPT"), ("[]", "STATE_RESET_CORRUPT")):
        (tmp_path / "seen.json").write_text(body)
        df, got = files.read_seen(spark, str(tmp_path / "seen.json"))
        assert got == code and df.count() == (code is None)


def test_unusable_state_is_put_aside(spark, tmp_path):
    path = str(tmp_path / "seen_jobs.json")
    assert files.load_seen(spark, path, "t1")[1] == []
    for i in range(2):
        (tmp_path / "seen_jobs.json").write_text("{")
        seen, failures = files.load_seen(spark, path, "t1")
        assert seen.count() == 0 and failures[0]["code"] == "STATE_RESET_CORRUPT" and not (tmp_path / "seen_jobs.json").exists()
    assert {p.name for p in tmp_path.iterdir() if "corrupt" in p.name and not p.name.startswith(".")} == {"seen_jobs.corrupt.t1.json", "seen_jobs.corrupt.t1.1.json"}
    keys = spark.createDataFrame([("a:1", "t")], "key string, first_seen_at string")
    assert not files.write_seen(keys, str(tmp_path / "state"), [{"code": "STATE_BACKUP_FAILED"}]) and files.write_seen(keys, str(tmp_path / "state"), failures)
    assert files.read_atomic(spark, str(tmp_path / "state")).count() == 1


def test_tracker_file_runs_and_calls(spark, tmp_path):
    from sluice.functions import fixed

    head = ",".join(fixed.TRACKER_COLUMNS)
    (tmp_path / "t.csv").write_text(f"{head}\n2024-01-01,Acme,Dev,,,,,applied,,\"two\nlines\"\n,,,,,,,,,\n2024-01-02,Beta,Ops,,,,,draft,,\n")
    rows = files.read_tracker(spark, str(tmp_path / "t.csv")).orderBy("pos").collect()
    assert [(r["empresa"], r["notas"]) for r in rows] == [("Acme", "two\nlines"), ("Beta", "")]
    for run in ("r1", "r2"):
        files.write_run(spark.createDataFrame([(run,)], "name string"), str(tmp_path / "runs"), run)
    assert files.read_latest_run(spark, str(tmp_path / "runs")).first()["name"] == "r2"
    (tmp_path / "calls").mkdir()
    (tmp_path / "calls" / "c1.json").write_text('{"results": []}')
    assert [tuple(r) for r in files.read_calls(spark, str(tmp_path / "calls")).collect()] == [("c1", '{"results": []}')]
    matrix = files.call_matrix(spark, ["x", "y"], {"p": ["here"], "a": ["there", "here"]})
    done = spark.createDataFrame([("p-0-1", 0), ("a-1-0", 1), ("a-1-0", 0)], "call_id string, pos int")
    assert [(r["call_id"], r["pos"], r["arrival"]) for r in postings.in_matrix_order(done, matrix).orderBy("arrival").collect()] == [("p-0-1", 0, 1), ("a-1-0", 0, 2), ("a-1-0", 1, 3)]  # portals as given, not by name


HAVE = "pos long, fecha string, empresa string, rol string, portal string, url string, tier string, score string, estado string, `próxima acción` string, notas string"


def test_tracker_refuses(spark):
    have = spark.createDataFrame([(0, "2024-01-01", "Acme", "Dev", "", "", "", "", "applied", "", "")], HAVE)
    ok = ("Acme", "Dev", None, "8", "offer")
    for bad in ([("", "Dev", None, None, None)], [("Acme", "Dev", None, "11", None)], [("Acme", "Dev", None, "x", None)], [("Acme", "Dev", None, None, "gone")], [ok, ("ACME", "dev", None, None, None)], [("New", "x", None, None, None)] * 2):
        with pytest.raises(ValueError):
            tracker.upsert(have, spark.createDataFrame(bad, "empresa string, rol string, url string, score string, estado string"), "2024-02-02")
    news = [(f"N{i}", "x", None, None, None) for i in range(5)]
    got = tracker.upsert(have, spark.createDataFrame([*news[::-1], ok], "empresa string, rol string, url string, score string, estado string"), "2024-02-02").orderBy("pos").collect()
    assert [(r["pos"], r["empresa"], r["score"], r["estado"]) for r in got] == [(0, "Acme", "8.0", "offer"), *[(i + 1, f"N{i}", "", "draft") for i in range(5)]]


def test_outcomes_and_followups(spark):
    have = spark.createDataFrame([(0, "2024-01-01", "Acme", "Dev", "", "", "", "", "applied", "", "")], HAVE)
    states = spark.createDataFrame([], tracker.STATE)
    send = lambda *r: spark.createDataFrame([r], "empresa string, rol string, status string, notes string, stages array<string>, resolved_date string, next_action string")
    have, states = tracker.record_outcomes(have, states, send("acme", "dev", "interview", "first", ["cv"], None, "call them"), "2024-01-10")
    have, states = tracker.record_outcomes(have, states, send("Acme", "Dev", "rejected", "", ["cv", "talk"], None, None), "2024-01-20")
    assert tuple(states.first()) == ("acme_dev", "rejected", "2024-01-20", "2024-01-20", "2024-01-20", 0, "2024-01-10: first", ["cv", "talk"])
    row = have.first()
    assert (have.count(), row["estado"], row["próxima acción"], row["notas"]) == (1, "rejected", "Registrar feedback y calibrar", "2024-01-10: first")
    have, states = tracker.record_outcomes(have, states, send("Acme", "Dev", "in_progress", None, None, None, None), "2024-02-01")
    ask = lambda n, body, day: tracker.record_followups(have, states, spark.createDataFrame([("ACME", "Dev", n, body)], "empresa string, rol string, number int, body string"), day)
    assert [ask(*x)[2].first()["refusal"] for x in ((1, "hi", "2024-02-05"), (2, "hi", "2024-02-15"), (3, "hi", "2024-02-15"), (1, " ", "2024-02-15"))] == ["too_early", "not_consecutive", "number", "empty_body"]
    have, states, told = ask(1, "hi", "2024-02-15")
    s = states.first()
    assert told.first()["refusal"] is None and (s["followups"], s["last_activity"], s["status"]) == (1, "2024-02-15", "in_progress") and s["notes"].endswith("2024-02-15: follow-up 1 draft created; manual review required")
    assert have.first()["próxima acción"] == "Revisar y enviar follow-up manual"
    with pytest.raises(ValueError):
        tracker.record_outcomes(have, states, send("Acme", "Dev", "lost", None, None, None, None), "2024-02-20")


def test_rank_reviews_end_to_end(spark):
    cand = [(i, f"a:{i}", t, "Co", "Rome") for i, t in enumerate(["One", "Two", "", "Four", "Five"])] + [(9, "a:0", "One again", "Co", "Rome")]
    c = spark.createDataFrame(cand, "pos long, job_key string, title string, company string, location string").withColumns({x: F.lit(None).cast("string") for x in ("url", "date", "portal")}).withColumns({"remote": F.lit(None).cast("boolean"), "source_ids": F.array(F.lit("s")), "duplicate_sources": F.array(F.lit("p"))})
    body = lambda k, score="8.0": '{"job_key":"%s","score":%s,"tier":"A","verdict":"APLICAR","strengths":["a","b","call 333 111 2222"],"gaps":["a","b","c"],"salary":"","notes":"n"}' % (k, score)
    raw = spark.createDataFrame([("a:0", body("a:0"), 1), ("a:1", body("a:1", "9.5"), 3), ("a:3", body("a:3", "9"), 2), ("a:4", "[]", 1)], "job_key string, payload string, attempts int")
    reviews = ranking.parse_reviews(raw)
    with pytest.raises(RuntimeError):
        ranking.rank_reviews(c, reviews)
    ranks, failures = ranking.rank_reviews(c, reviews, share=0.9)
    got = ranks.orderBy(*ranking.rank_order()).collect()
    assert [(r["job_key"], r["title"]) for r in got] == [("a:1", "Two"), ("a:0", "One again")] and got[0]["strengths"][2] == "call [PHONE_REDACTED]" and got[0]["notes"].startswith("n [CONTACT")
    assert [tuple(r) for r in failures.collect()] == [("a:2", "RANK_FIELD_NULL", 0, "candidate missing critical fields: title", None), ("a:3", "RANK_FAILED", 2, "invalid_reviewer_output", "no number with decimals as score"), ("a:4", "RANK_FAILED", 1, "invalid_reviewer_output", "other fields than a review has")]
    _, merged = ranking.rank_reviews(c, reviews, spark.createDataFrame([("a:0",), ("z:1",)], "job_key string"), merged=True)
    assert [(r["job_key"], r["reason"]) for r in merged.collect()][-1] == ("z:1", "unsafe_apply_url") and "missing_output" in {r["reason"] for r in merged.collect()}
    top = ranking.digest_rows(ranks)
    ranking.check_digest_input(ranks, failures)
    with pytest.raises(ValueError):
        ranking.check_digest_input(ranks.drop("url"), failures)
    assert [(r["n"], r["step"], r["title"]) for r in ranking.next_steps(top).collect()] == [(1, "apply", "Two"), (2, "apply", "One again")]
    assert [r["key"] for r in ranking.failure_lines(failures).collect()] == ["a:2", "a:3", "a:4"]
    text = ranking.digest_text(ranking.digest_lines(ranks, failures), "2024-01-01", "r", failures=2)
    assert "| 1 | 9.5 | A |" in text and "- Apply: **Two** (Co)" in text and "- `a:3`: `RANK_FAILED` invalid_reviewer_output" in text and "- and 1 more" in text and "`a:4`" not in text
    empty = ranking.digest_text(ranking.digest_lines(ranks.limit(0), failures.limit(0)), "2024-01-01", "r")
    assert empty.count("- None") == 2


def test_offer_payload_and_digest_order(spark):
    row = spark.createDataFrame([("a:1", "1", "a", "T<b>", "two\nlines", None, "2024-01-01", None, None, None, "c", ["a:1"], ["a"], "https://x.org")], "job_key string, id string, portal string, title string, company string, location string, date string, description string, salary string, remote boolean, source_call string, source_ids array<string>, duplicate_sources array<string>, url string")
    block = ranking.offer_payload(row).first()["block"].split("\n")
    assert block[0] == "<UNTRUSTED_JOB_DATA_JSON>" and "x.org" not in block[1] and '"company":null' in block[1] and "T\\\\u003Cb" in block[1] and block[1].startswith('{"company"') and block[1].count('":') == 13
    rows = spark.createDataFrame([("a", "2024-01-01", False), ("b", "soon", True), ("c", "2024-01-02", True), ("d", None, True)], "title string, date string, new boolean").withColumns({c: F.lit("") for c in ("company", "portal", "id")})
    assert [r["title"] for r in rows.orderBy(*postings.digest_order()).collect()] == ["c", "b", "d", "a"]
    lines = postings.latest_lines(rows.withColumn("url", F.when(F.col("title") == "c", "https://x.org")).withColumn("location", F.lit(None).cast("string"))).orderBy("n").collect()
    assert [r["n"] for r in lines] == [1, 2, 3, 4] and lines[0]["line"] == "| 1 | pendiente | [c](https://x.org) | — | — | — | 2024-01-02 | sí |" and lines[3]["line"].endswith("| a | — | — | — | 2024-01-01 | no |")


def test_one_group_may_hold_a_third_of_all_rows(spark):
    rows = spark.range(6000).select(F.col("id").alias("pos"), F.lit("p").alias("portal"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("title"), F.lit("X").alias("company"), F.lit(None).cast("string").alias("url"), F.lit(False).alias("new"))
    got = postings.deduplicate(rows)
    assert got.count() == 4001 and got.orderBy(F.desc("size")).first()["size"] == 2000


def test_entry_works_without_the_training_data_modules(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "sluice", tmp_path / "sluice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    (tmp_path / "sluice" / "llm").mkdir()  # an empty folder is left
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op')], len(e.oracle_sql()) > 30)"], cwd=tmp_path, capture_output=True, text=True, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and "[] True" in out.stdout, out.stderr
