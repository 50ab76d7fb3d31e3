import threading

import pytest
from pyspark.sql import functions as F
from sluice.functions import fixed
from sluice.operators import scoring
from sluice.tables import cut, scratch, setting

RAW = "id int, title string, company string, location string, remote boolean, salary string, description string, language string, portal string, email_contacto string, url string"
ME = scoring.Profile({"python": True, "c++": True, "node.js": False}, {"marine": ("acuario",), "industry": ("packaging",)})


def one(spark, **given):
    base = {"id": 1, "title": None, "company": None, "location": None, "remote": None, "salary": None, "description": None, "language": None, "portal": None, "email_contacto": None, "url": None}
    more = "".join(f", {k} {'int' if k == 'commute_minutes' else 'string'}" for k in given if k not in base)
    return scoring.scored(spark.createDataFrame([tuple({**base, **given}.values())], RAW + more), ME).first()


def test_places_take_the_best_tier_that_applies(spark):
    cases = {
        "Bologna": "A+", "casalecchio  di-Reno (BO)": "A+", "Nápoles": "A", "NAPOLES": "A", "Nápoles": "A", "Reggio Calabria": "A", "Reggio Emilia": "C", "L'Hospitalet": "B", "La Coruña": "B",
        "Milano": "VETO", "Milano o Pisa": "A", "Romano di Lombardia": "C", "Zurich": "C", "Smart working": "B+", "Roma, remoto": "B+", "Bari. Remoto": "A", "Reggio. Calabria": "C", " ": None, "": None, None: None,
    }
    rows = [(p,) for p in cases]
    got = spark.createDataFrame(rows, "p string").select("p", scoring.place_tier(scoring.plain(F.col("p")), F.lit(None).cast("boolean")).alias("t")).collect()
    assert {r["p"]: r["t"] for r in got} == cases
    assert one(spark, location="Zurich", commute_minutes=61)["tier"] == "VETO" and one(spark, location="Zurich", commute_minutes=60)["tier"] == "C"
    assert one(spark, location="Pisa", commute_minutes=90)["tier"] == "A" and one(spark, location="Roma", remote=True)["tier"] == "B+"


def test_every_listed_place_has_its_tier(spark):
    rows = [(t, p) for t, places in fixed.PLACES.items() for p in (*places, *scoring.OWN_NAMES.get(t, ()))]
    got = spark.createDataFrame(rows, "want string, p string").select("want", "p", scoring.place_tier(scoring.plain(F.col("p")), F.lit(False)).alias("t"))
    assert got.where("want <> t OR t IS NULL").collect() == []
    assert [len(fixed.PLACES[t]) for t in ("A", "B")] == [23, 24]


def test_pay_is_the_lowest_yearly_amount(spark):
    cases = {"60.000 - 70.000 €": 60.0, "55k": 55.0, "55 K": 55.0, "42,500.00 EUR": 42.5, "30000": 30.0, "20 €/h": None, "from 2024: 61k": 61.0, "99.999.999": None, "12345678": None, "": None, None: None, "1.200 al mes": None, "60.5k": 60.0}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", scoring.yearly_pay(F.col("p")).alias("v")).collect()
    assert {r["p"]: r["v"] for r in got} == cases


def test_roles_take_their_first_band(spark):
    cases = {"IT Manager": 9.5, "Senior IT-Manager (Bologna)": 9.5, "Junior IT Manager": 4.0, "IT/OT Specialist": 8.5, "Energy Manager": 7.5, "BI Manager": 5.5, "College dean": 4.0, None: 4.0, "IT Manager / Data Manager": 9.5}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", scoring.role_score(scoring.plain(F.col("p"))).alias("v")).collect()
    assert {r["p"]: r["v"] for r in got} == cases


@pytest.mark.parametrize(("text", "language", "want"), [
    ("PMP required.", "en", ["certificate"]), ("PMP welcome. Python required.", "en", []), ("Cism, obbligatoria", "it", ["certificate"]), ("Laurea in Ingegneria obbligatoria", "it", ["degree"]),
    ("Laurea in ingegneria\nobbligatoria", "it", []), ("Voto 110/110", "it", ["grade"]), ("CON LODE", "it", ["grade"]), ("Italiano madrelingua", "it", []), ("Italiano madrelingua", "es", ["native_language"]),
    ("6+ years of Node.js", "en", []), ("Italiano madrelingua", None, ["native_language"]), ("PMPs required", "en", []),
])
def test_vetoes(spark, text, language, want):
    got = one(spark, description=text, language=language)
    assert got["vetoes"] == want and got["verdict"] == ("DESCARTAR" if want else None)


def test_years_veto_names_a_skill_that_is_lacked(spark):
    me = scoring.Profile({"python": True, "cobol": False}, {})
    rows = [(i, t) for i, t in enumerate(("6+ years of Cobol", "5 years of Cobol", "9 years of Python", "9 years here. Cobol", "12 anni di cobol"))]
    df = spark.createDataFrame(rows, "id int, description string").selectExpr("*", *[f"CAST(NULL AS string) AS {c}" for c in ("title", "company", "location", "salary", "language", "portal", "url")], "false AS remote")
    assert {r["id"]: r["vetoes"] for r in scoring.scored(df, me).collect()} == {0: ["years"], 1: [], 2: [], 3: [], 4: ["years"]}


def test_language_penalty_and_its_exemptions(spark):
    cases = [("plain text", "adzuna", True), ("English required", "adzuna", False), ("English C1", "adzuna", False), ("English spoken. Python required", "adzuna", True), ("Remote EMEA", "adzuna", False), ("plain", "Remotive", False), ("plain", None, True)]
    for text, portal, want in cases:
        got = one(spark, description=text, portal=portal, language="en")
        assert got["penalty"] == want and (fixed.SCORE_NOTES["language"] in got["notes"]) == want, text
    assert not one(spark, description="text", language="it")["penalty"]


def test_scores_add_up_and_odd_rows_have_defined_results(spark):
    got = one(spark, title="IT Manager", location="Bologna", salary="65k", description="Python, C++ and Node.js. Acuario", language="it", email_contacto="a@b.org", verdict="APLICAR", score_note="kept")
    assert (got["location_score"], got["role_score"], round(got["skills_score"], 4), got["sector_score"], got["pay_score"], got["language_score"], got["sector_bonus"]) == (10.0, 9.5, 6.6667, 10.0, 10.0, 10.0, 2.0)
    assert got["score"] == 10.0 and got["gaps"] == ["node.js"] and got["verdict"] == "APLICAR" and got["score_note"] == "kept" and got["notes"] == [fixed.SCORE_NOTES["email"]]
    bare = one(spark)
    assert bare["tier"] is None and bare["score"] == 4.8 and bare["vetoes"] == [] and bare["gaps"] == [] and bare["notes"] == [fixed.SCORE_NOTES["pay"]] and bare["verdict"] is None
    assert one(spark, location="Roma", verdict="APLICAR")["verdict"] == "DESCARTAR"
    assert scoring.scored(spark.createDataFrame([], RAW), ME).collect() == []
    assert one(spark, description="word " * 300_000 + "PMP required")["vetoes"] == ["certificate"]


def test_scoring_shuffles_nothing_and_runs_no_python(spark):
    plan = scoring.scored(spark.createDataFrame([], RAW), ME)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_scopes_of_two_threads_keep_to_themselves(spark):
    begun, ended, told = threading.Event(), threading.Event(), {}

    def other():
        with scratch(spark, []):
            begun.wait(60)
        ended.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark, []):
        mine = cut(spark.range(5), "mine")
        begun.set()
        assert ended.wait(60)
        told["rows"] = mine.count()
    thread.join()
    assert told == {"rows": 5}
    with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND"):
        spark.read.parquet(mine._written_at).count()


def test_a_kept_table_lives_until_the_scope_around_ends(spark):
    with scratch(spark, []):
        kept = []
        with scratch(spark, kept):
            kept.append(cut(spark.range(3), "kept"))
            gone = cut(spark.range(4), "gone")
        assert kept[0].count() == 3
        with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND"):
            spark.read.parquet(gone._written_at).count()
    with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND"):
        spark.read.parquet(kept[0]._written_at).count()


def test_a_setting_of_overlapping_holders_is_put_back(spark):
    name, before = "spark.sql.maxPlanStringLength", spark.conf.get("spark.sql.maxPlanStringLength")
    a, b = setting(spark, name, "1000"), setting(spark, name, "1000")
    a.__enter__(), b.__enter__()
    a.__exit__(None, None, None)
    assert spark.conf.get(name) == "1000"
    b.__exit__(None, None, None)
    assert spark.conf.get(name) == before
