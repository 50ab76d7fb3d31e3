from pyspark.sql import functions as F
from sluice.functions import contacts, dates, urls
from sluice.functions import text as tx


def _map(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_lenient_dates_keep_the_written_day(spark):
    raw = ["2026-07-06", "2026-02-31", "2026-07-06T23:30:00-05:00", "2026/07/06", "03/04/2026", "12/31/2026", " 2026-07-06 ", "soon", None, "2026-07-06T25:00:00", "2026-07-06T10:00:00 junk", "2026-07-06T10:00 junk"]
    assert _map(spark, dates.lenient_date, raw) == ["2026-07-06", None, "2026-07-06", "2026-07-06", "2026-04-03", "2026-12-31", "2026-07-06", None, None, None, "2026-07-06", None]


def test_strict_dates_take_no_blanks(spark):
    raw = ["2024-02-29", "2023-02-29", "2024-02-29T10:00:00Z", "2024-02-29 10:00:00", " 2024-02-29", "2024-2-9", "2024-02-29T99:00:00Z", None]
    assert _map(spark, dates.strict_date, raw) == ["2024-02-29", None, "2024-02-29", None, None, None, None, None]


def test_canonical_urls(spark):
    raw = ["HTTPS://User@Ex.org:8443/a/;p?b=2&A=1&utm_x=3&trk=4#f", "http://ex.org", "http://ex.org/", "http://ex.org//", "ftp://ex.org/", None, "http://ex.org/a?x=a+b&y"]
    assert _map(spark, urls.canonical_url, raw) == ["https://ex.org:8443/a?a=1&b=2", "http://ex.org/", "http://ex.org/", "http://ex.org", None, None, "http://ex.org/a?x=a+b&y="]


def test_hosts_and_identifiers(spark):
    assert _map(spark, urls.hostile_host, ["https://a.icims.com/x", "https://icims.com.example.org", "icims.com", None, ""]) == [True, False, False, False, False]
    assert _map(spark, urls.safe_identifier, ["a:1", "job@1", "job 1", "---", ".", None]) == [True, False, False, False, False, False]


def test_safe_links(spark):
    good = ["https://example.org/jobs/1234567", "http://localhost:8080/x", "https://10.0.0.1/a", "HTTPS://münchen.example/", "https://[::1]/a", "https://example.org./", "https://example.org/a-1234567?x=1&y=2"]
    bad = ["javascript:alert(1)", "https://u@example.org/", "https://example.org:99999/", "https://..example.org/", "https://example.org/?m=a%40b.org", "https://example.org/?m=a%2540b.org", "https://example.org/a b", "https://example.org/%0a", "https://example.org/2026-07-22/", None, "", "https://example.org/12-1234567/", "https://example.org/?tel=%2B39 333 111 2222", "https://example.org/?tel=333-111-2222", "https://-a.example/", "https://[::1/a", "https:///x", "https://" + "a" * 64 + ".org/", "https://example.org/a%26%2364%3Bb.org/x&#64;y.org"]
    assert _map(spark, urls.safe_apply_url, good + bad) == [True] * len(good) + [False] * len(bad)


def test_contacts(spark):
    raw = ["write noreply@x.org or jo@x.org", "none", None, "no-reply@x.org"]
    assert _map(spark, contacts.contact_email, raw) == ["jo@x.org", None, None, None]
    raw = ["call +39 333 111 2222 now", "on 2026-07-22", "mail a&#64;b.org", "via Roma 12", "plain & text", None]
    assert _map(spark, contacts.redact_contacts, raw) == ["call [PHONE_REDACTED] now", "on 2026-07-22", "mail [EMAIL_REDACTED]", "[ADDRESS_REDACTED]", "plain & text", None]


def test_text_keys(spark):
    assert _map(spark, tx.fold_key, ["Él_a  ﬁn!", None, "--"]) == ["el_a fin", "", ""]
    assert _map(spark, tx.fold_order, ["Él_a", None]) == ["el a", ""]
    assert _map(spark, tx.slug, ["Añb / C", "", None]) == ["anb_c", "application", "application"]
    assert _map(spark, tx.cell, ["a|b\nc", "", None]) == ["a\\|b c", "—", "—"]
    assert _map(spark, tx.prompt_escape, ["a<b>&", "a\nb", None]) == ["a\\u003Cb\\u003E\\u0026", None, None]
    assert _map(spark, tx.score_text, ["8.44", "1.45", "", None, "11", "x"]) == ["8.4", "1.4", "", "", None, None]


def test_scans_agree_with_plain_matching(spark):
    """The built-in test drops no text that the patterns would change, in any decoded form."""
    import html
    import re
    from urllib.parse import unquote

    from sluice.functions import fixed

    raw = ["jo%40b.org", "&lt;a&#64;b.org&gt;", "12 Main Street", "calle Mayor 3", "10 avenue x", "333.111.2222", "٠١٢٣٤٥٦٧٨٩", "via", "a 12 b", "2024-01-01 2024-01-02", "100%", "AT&T", "%2540", "x" * 50, "5 \u00a0road\u00a07", "Ｊo@ｂ.org", "12b St.", ""]

    def plain(text):
        forms = [text]
        for _ in range(8):
            forms.append(html.unescape(unquote(forms[-1])))
        for form in reversed(forms):
            out = re.sub(fixed.EMAIL, "[EMAIL_REDACTED]", form)
            out = re.sub(fixed.PHONE, lambda m: m[0] if len(re.findall(r"\d", m[0])) < 7 or re.fullmatch(fixed.PLAIN_DATE, m[0]) else "[PHONE_REDACTED]", out)
            for p in (fixed.STREET_PREFIX, fixed.STREET_SUFFIX, fixed.STREET_NUMBER):
                out = re.sub(p, "[ADDRESS_REDACTED]", out)
            if out != form:
                return out, True
        return text, False

    want = [plain(t) for t in raw]
    assert _map(spark, contacts.redact_contacts, raw) == [x for x, _ in want]
    assert _map(spark, contacts.contains_contact, raw) == [x for _, x in want]


def test_secrets_and_quotes(spark):
    assert _map(spark, contacts.has_secret, ["password: x", "Basic abcdefgh12", "plain", None]) == [True, True, False, False]
    assert _map(spark, tx.yaml_quote, ['a "b"\n', None, "{é}"]) == ['"a \\"b\\"\\n"', '""', '"{é}"']


def test_contact_signs_miss_nothing_that_python_finds(spark):
    """Over all code points: what the scan redacts, the built-in test lets through, and blanks are trimmed alike."""
    from sluice.functions import contacts
    from sluice.functions import text as tx

    points = [p for p in range(0x11000) if not 0xD800 <= p < 0xE000]
    rows = [(f"12{chr(p)}34{chr(p)}56{chr(p)}789",) for p in points] + [(f"via{chr(p)}Roma{chr(p)}12",) for p in points] + [(f"a{chr(p)}b@x.org",) for p in points]
    df = spark.createDataFrame(rows, "t string").repartition(8)
    found = {r["t"] for r in df.where(~contacts.suspect(F.col("t"))).collect()}
    assert not [t for t in found if contacts.scan(t)[1]]
    blanks = [(chr(p) + "x" + chr(p),) for p in points if chr(p).isspace()]
    got = spark.createDataFrame(blanks, "t string").select(tx.clean(F.col("t"))).distinct().collect()
    assert [r[0] for r in got] == ["x"]


def test_one_review_per_key(spark):
    from sluice.operators import ranking

    asked = spark.createDataFrame([(0, "a:1", "T", "L"), (1, "b:2", "T", "L")], "pos int, job_key string, title string, location string")
    twice = spark.createDataFrame([("a:1", 8.1, None, 1), ("a:1", 6.5, None, 2), ("b:2", 5.0, "bad", 1)], "job_key string, score double, error string, pos int")
    got = {r["job_key"]: (r["r_score"], r["code"]) for r in ranking.judged(asked, twice).collect()}
    assert got == {"a:1": (6.5, None), "b:2": (5.0, "RANK_FAILED")} and ranking.judged(asked, twice).count() == 2
    assert {r["r_score"] for r in ranking.judged(asked, twice.drop("pos")).where("job_key = 'a:1'").collect()} == {8.1}
