"""Candidates, batches, prompts, review checks, ranks, digest, scores, overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts, dates, fixed, urls
from ..functions import text as tx
from ..tables import cut, numbered

CANDIDATE = ("job_key", "id", "portal", "title", "company", "location", "url", "date", "description", "remote", "salary", "source_call", "source_ids", "duplicate_sources")
REVIEW = ("job_key", "score", "tier", "verdict", "strengths", "gaps", "salary", "notes")


def with_job_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("job_key", F.concat_ws(":", "portal", "id"))


def _eligible() -> Column:
    return F.coalesce(F.col("new") & F.col("id").isNotNull() & F.col("portal").isNotNull() & (F.coalesce("url", F.lit("")) != "") & urls.safe_identifier(F.col("job_key")), F.lit(False))


def top_candidates(rows: DataFrame, pos: str = "pos", limit: int = 10) -> DataFrame:
    """The first ten eligible rows in input order (the cap is the feature)."""
    return with_job_key(rows).where(_eligible()).orderBy(pos).limit(limit)


def split_candidates(rows: DataFrame) -> DataFrame:
    """All rows with ``skipped``: null for candidates, else the reason; filter once for each output."""
    told = with_job_key(rows)
    reason = F.when(~_eligible(), "not_eligible").when(~urls.safe_apply_url(F.col("url")), "unsafe_url")
    return told.withColumn("skipped", reason)


def in_waves(rows: DataFrame, order: list[Column], size: int = 5, waves: int | None = None) -> DataFrame:
    """wave and place (both from 0). With ``waves`` that hold all rows, balanced contiguous waves, larger first;
    otherwise chunks of ``size``. Sizes below 1 mean 5, waves below 1 mean 1."""
    size, placed = size if size > 0 else 5, numbered(rows, order, "_n")
    i = F.col("_n") - 1
    total = rows.count()
    if waves is not None and total <= max(waves, 1) * size:
        n = max(waves, 1)
        q, r = divmod(total, n)
        edge = r * (q + 1)  # rows in the waves that have one more
        wave = F.when(i < edge, F.floor(i / (q + 1))).otherwise(r + F.floor((i - edge) / max(q, 1)))
        start = F.when(i < edge, wave * (q + 1)).otherwise(edge + (wave - r) * max(q, 1))
    else:
        wave = F.floor(i / size)
        start = wave * size
    return placed.withColumn("wave", wave.cast("long")).withColumn("place", (i - start).cast("long")).drop("_n")


def offer_block(rows: DataFrame, columns: list[str], open_mark: str = "<<<OFFER", close_mark: str = "OFFER>>>") -> DataFrame:
    """``block``: escaped columns as JSON in name order, nulls kept, between markers."""
    kinds = dict(rows.dtypes)
    fields = [(tx.prompt_escape(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(c) for c in sorted(columns)]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.withColumn("block", F.concat(F.lit(open_mark + "\n"), body, F.lit("\n" + close_mark)))


def wave_prompts(blocks: DataFrame, head: str, wave: str = "wave", place: str = "place") -> DataFrame:
    """One prompt per wave: the head, then its blocks in order (a wave is bounded by its size)."""
    parts = F.array_sort(F.collect_list(F.struct(place, "block")))
    return blocks.groupBy(wave).agg(F.concat(F.lit(head + "\n\n"), F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n")).alias("prompt"), F.count("*").alias("offers"))


def offer_payload(candidates: DataFrame) -> DataFrame:
    """job_key, title, company, url and ``block``: the thirteen fields of an offer, without its URL, between their marks."""
    free = ("title", "company", "location", "description", "salary")
    fields = [(tx.prompt_escape(F.col(c)) if c in free else F.col(c)).alias(c) for c in sorted(fixed.OFFER_FIELDS)]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    first, last = fixed.OFFER_MARKS
    return candidates.select("job_key", "title", "company", "url", F.concat(F.lit(first + "\n"), body, F.lit("\n" + last)).alias("block"))


def posting_errors() -> Column:
    """The rules a posting breaks, as an array; empty if it is valid."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "id": ~urls.safe_identifier(F.col("id")), "portal": ~urls.safe_identifier(F.col("portal")), "title": blank("title"), "company": F.col("company").isNotNull() & blank("company"),
        "url": F.col("url").isNotNull() & ~urls.safe_apply_url(F.col("url")), "date": F.col("date").isNotNull() & ~F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull(), F.lit(False)),
        "source_ids": F.coalesce(F.size("source_ids"), F.lit(0)) < 1, "duplicate_sources": F.coalesce(F.size("duplicate_sources"), F.lit(0)) < 1,
    }
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))


def validate_postings(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per error: job_key, rule; the second and later rows of a job_key are duplicates."""
    told = with_job_key(rows).withColumn("_r", posting_errors())
    firsts = told.groupBy("job_key").agg(F.min(pos).alias("_first"))
    again = told.join(firsts, "job_key", "left").withColumn("_r", F.when(F.col(pos) > F.col("_first"), F.array_append("_r", F.lit("duplicate_job_key"))).otherwise(F.col("_r")))
    return again.select("job_key", pos, F.explode("_r").alias("rule"))


def failure_errors() -> Column:
    """The rules a failure record (call_id, portal, code, message, exit_code, raw_file, stderr_file) breaks."""
    rules = {
        "call_id": ~urls.safe_identifier(F.col("call_id")), "portal": ~urls.safe_identifier(F.col("portal")), "code": ~urls.safe_identifier(F.col("code")),
        "message": (F.trim(F.coalesce("message", F.lit(""))) == "") | contacts.has_secret(F.col("message")), "exit_code": ~F.coalesce(F.col("exit_code") >= 0, F.lit(False)),
        "raw_file": contacts.has_secret(F.col("raw_file")), "stderr_file": contacts.has_secret(F.col("stderr_file")),
    }
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))


def parse_reviews(raw: DataFrame) -> DataFrame:
    """Reviews from JSON (job_key asked for, payload, and attempts if there): entry_key, the fields, attempts, and well_formed.

    Well-formed are objects of exactly the known fields, where those of fixed kind have it.
    """
    v = F.try_parse_json("payload")
    get = lambda c, kind: F.try_variant_get(v, f"$.{c}", kind)
    kind = lambda c: F.coalesce(F.schema_of_variant(get(c, "variant")), F.lit("VOID"))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    exact = F.array_sort(keys) == F.array(*[F.lit(c) for c in sorted(REVIEW)])
    text = lambda c: F.when(kind(c) == "STRING", get(c, "string")).alias(c)
    three = lambda c: F.when(kind(c) == "ARRAY<STRING>", get(c, "array<string>")).alias(c)
    # Whole numbers are no scores: 8.0 is one, 8 is not.
    score = F.when(kind("score").rlike("^(DOUBLE|FLOAT|DECIMAL)"), get("score", "double")).alias("score")
    attempts = F.coalesce("attempts", F.lit(1)) if "attempts" in raw.columns else F.lit(1)
    return raw.select(
        F.col("job_key").alias("entry_key"), text("job_key"), score, text("tier"), text("verdict"), three("strengths"), three("gaps"), text("salary"), text("notes"),
        attempts.cast("int").alias("attempts"), F.coalesce(exact, F.lit(False)).alias("well_formed"))


def review_error(expected: Column) -> Column:
    """What is wrong with a review, the first rule that fails; null if nothing is."""
    three = lambda c: F.coalesce((F.size(c) == 3) & F.forall(c, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.lit(False))
    score = F.col("score")
    in_range = score.between(0, 10) & ~F.isnan(score) & (F.round(score, 1) == score)
    ladder = [
        (~urls.safe_identifier(F.col("job_key")), "unsafe job_key"), (~F.coalesce(F.col("job_key") == expected, F.lit(False)), "another job_key than asked for"),
        (score.isNull(), "no number with decimals as score"), (~F.coalesce(in_range, F.lit(False)), "score outside 0 to 10 in tenths"),
        (~F.coalesce(F.col("tier").isin(*fixed.TIERS), F.lit(False)), "unknown tier"), (~F.coalesce(F.col("verdict").isin(*fixed.VERDICTS), F.lit(False)), "unknown verdict"),
        ((F.col("tier") == "VETO") & (F.col("verdict") != "DESCARTAR"), "veto not discarded"), (~three("strengths"), "not three strengths"), (~three("gaps"), "not three gaps"),
        (F.col("salary").isNull() | F.col("notes").isNull(), "salary or notes missing"),
    ]
    first, *rest = ladder
    return reduce(lambda acc, r: acc.when(*r), rest, F.when(*first))


def redact_reviews(reviews: DataFrame) -> DataFrame:
    """Free text redacted; notes say so where anything changed; ``contact_remains`` if a pattern is still there."""
    out = reviews
    joined = F.array("strengths", "gaps")
    for c in ("strengths", "gaps"):
        parts = [contacts.redact_contacts(F.get(c, i)) for i in range(3)]
        out = out.withColumn(f"_{c}", F.when(F.size(c) == 3, F.array(*parts)).otherwise(F.col(c)))
    out = out.withColumn("_salary", contacts.redact_contacts(F.col("salary"))).withColumn("_notes", contacts.redact_contacts(F.col("notes")))
    changed = ~F.array("_strengths", "_gaps").eqNullSafe(joined) | ~F.col("_salary").eqNullSafe(F.col("salary")) | ~F.col("_notes").eqNullSafe(F.col("notes"))
    out = out.withColumn("_notes", F.when(changed, F.concat("_notes", F.lit(fixed.REDACTION_NOTE))).otherwise(F.col("_notes")))
    rest = [x for x in reviews.columns if x not in ("strengths", "gaps", "salary", "notes")]
    final = out.select(*rest, *[F.col(f"_{c}").alias(c) for c in ("strengths", "gaps", "salary", "notes")])
    everything = F.concat_ws("\n", "strengths", "gaps", "salary", "notes")
    return final.withColumn("contact_remains", contacts.contains_contact(everything))


def checked_reviews(reviews: DataFrame) -> DataFrame:
    """Parsed reviews with ``error``, free text redacted; a pattern that remains after redaction is an error, too."""
    told = reviews.withColumn("error", F.when(~F.col("well_formed"), "other fields than a review has").otherwise(review_error(F.col("entry_key"))))
    clean = redact_reviews(told)
    return clean.withColumn("error", F.coalesce("error", F.when(F.col("contact_remains"), "contact data remains"))).drop("contact_remains")


def last_in_first_place(rows: DataFrame, pos: str = "pos", key: str = "job_key") -> DataFrame:
    """One row per key: the last one's values at the first one's place."""
    names = [c for c in rows.columns if c not in (pos, key)]
    picked = rows.groupBy(key).agg(F.min(pos).alias(pos), F.max_by(F.struct(*names), pos).alias("_v"))
    return picked.select(pos, key, "_v.*")


def rank_reviews(candidates: DataFrame, reviews: DataFrame, skipped: DataFrame | None = None, merged: bool = False, share: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Ranks and failures of candidates (pos, job_key, ...) by parsed reviews.

    The plain form checks critical fields first and stops (RuntimeError) where more than ``share`` of
    at least three candidates failed. The merged form does neither, but names ``skipped`` candidates
    (job_key) without an own review as invalid input. Ranks keep the candidate's own title, company
    and place; failures come with code, attempts, reason and detail, by key.
    """
    asked = last_in_first_place(candidates)
    answers = checked_reviews(reviews).withColumnsRenamed({"job_key": "own_key", "entry_key": "job_key"})
    told = judged(asked, answers, () if merged else ("title", "location"))
    leak = F.lit(False)
    for c in ("title", "company", "location"):
        leak = leak | contacts.contains_contact(contacts.redact_contacts(F.col(c)))
    told = cut(told.withColumn("_leak", F.col("code").isNull() & leak).withColumns({
        "code": F.when(F.col("_leak"), "RANK_FAILED").otherwise(F.col("code")), "reason": F.when(F.col("_leak"), "contact_pattern_remaining").otherwise(F.col("reason")),
        "detail": F.when(F.col("reason") == "invalid_reviewer_output", F.substring("r_error", 1, 120)), "attempts": F.when(F.col("reason").isin("invalid_reviewer_output") | F.col("code").isNull(), F.col("r_attempts")).otherwise(0)}).drop("_leak"), "told")
    if not merged and failure_gate(told, share).first()["aborted"]:
        raise RuntimeError("too many candidates failed: nothing is ranked")
    own = {"score", "tier", "verdict", "strengths", "gaps", "salary", "notes"}
    ranks = told.where("code IS NULL").select(*[F.col(f"r_{c}" if c in own else c).alias(c) for c in fixed.RANK_FIELDS])
    failures = told.where("code IS NOT NULL").select("job_key", "code", "attempts", "reason", "detail")
    if skipped is not None:
        done = told.where("reason IS NULL OR reason <> 'missing_output'").select("job_key")
        left = skipped.where("job_key IS NOT NULL").select("job_key").join(done, "job_key", "left_anti")
        failures = failures.unionByName(left.select("job_key", F.lit("RANK_INPUT_INVALID").alias("code"), F.lit(0).alias("attempts"), F.lit("unsafe_apply_url").alias("reason"), F.lit(None).cast("string").alias("detail")))
    return ranks, failures.orderBy("job_key")


def _variant_kind(item: str, field: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.col(item), f"$.{field}", "variant")), F.lit("VOID"))


def payload_errors(payloads: DataFrame) -> DataFrame:
    """One row (run, path, rule) for everything that is wrong with payloads (run, payload as JSON)."""
    v = F.try_parse_json("payload")
    root = payloads.select("run", v.alias("v"))
    get = lambda c, kind, item="v": F.try_variant_get(F.col(item), f"$.{c}", kind)
    text = lambda c, item: F.when(_variant_kind(item, c) == "STRING", get(c, "string", item))
    keys = lambda item: F.map_keys(F.try_variant_get(F.col(item), "$", "map<string, variant>"))
    whole = lambda c, item: F.coalesce((_variant_kind(item, c) == "BIGINT") & (get(c, "long", item) >= 0), F.lit(False))

    def listed(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
        bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in rules.items()]))
        return rows.select("run", "path", F.explode(bad).alias("rule"))

    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    none = root.where(~is_object).select("run", F.lit("root").alias("path"), F.lit("object").alias("rule"))
    objects = root.where(is_object).withColumn("path", F.lit("root")).withColumn("counts", get("counts", "variant"))
    stamp = text("generated_at", "v")
    n = keys("counts")
    counted = _variant_kind("v", "counts").startswith("OBJECT")
    top = listed(objects, {
        "missing": F.size(F.array_except(F.array(*[F.lit(c) for c in ("run_id", "generated_at", "results", "failures", "counts")]), keys("v"))) > 0,
        "run_id": ~urls.safe_identifier(text("run_id", "v")), "generated_at": stamp.isNull() | ~stamp.contains("T") | dates.strict_date(stamp).isNull(),
        "results": ~_variant_kind("v", "results").startswith("ARRAY"), "failures": ~_variant_kind("v", "failures").startswith("ARRAY"), "counts": ~counted,
        "counts.unexpected": counted & (F.size(tx.unexpected_keys(n, fixed.COUNT_FIELDS)) > 0), "counts.results": counted & ~whole("results", "counts"),
        "counts.integer": counted & whole("results", "counts") & reduce(lambda a, b: a | b, [F.array_contains(n, c) & ~whole(c, "counts") for c in fixed.COUNT_FIELDS if c != "results"])})
    items = lambda c: objects.select("run", F.posexplode(F.try_variant_get("v", f"$.{c}", "array<variant>")).alias("i", "x")).withColumn("path", F.concat(F.lit(f"{c}["), F.col("i").cast("string"), F.lit("]"))).withColumn("ok", F.coalesce(F.schema_of_variant("x").startswith("OBJECT"), F.lit(False)))
    optional = lambda c: ~_variant_kind("x", c).isin("STRING", "VOID")
    flag = lambda c: ~_variant_kind("x", c).isin("BOOLEAN", "VOID")
    t = lambda c: text(c, "x")
    ids = lambda c: ~F.coalesce((_variant_kind("x", c) == "ARRAY<STRING>") & F.forall(get(c, "array<string>", "x"), lambda e: urls.safe_identifier(e)) & (F.size(get(c, "array<string>", "x")) > 0), F.lit(False))
    key = F.concat_ws(":", t("portal"), t("id"))
    results = items("results")
    wrong = listed(results.where("ok"), {
        "missing": F.size(F.array_except(F.array(*[F.lit(c) for c in fixed.RESULT_FIELDS]), keys("x"))) > 0, "unexpected": F.size(tx.unexpected_keys(keys("x"), (*fixed.RESULT_FIELDS, "job_key"))) > 0,
        "id": ~urls.safe_identifier(t("id")), "portal": ~urls.safe_identifier(t("portal")), "title": F.coalesce(F.trim(t("title")), F.lit("")) == "",
        **{c: optional(c) for c in ("company", "location", "description", "salary")}, "url": (_variant_kind("x", "url") != "VOID") & ~urls.safe_apply_url(t("url")),
        "date": F.when(_variant_kind("x", "date") == "VOID", ~F.array_contains(keys("x"), "date")).otherwise(~F.coalesce(dates.strict_date(t("date")) == t("date"), F.lit(False))),
        "remote": flag("remote"), "new": _variant_kind("x", "new") != "BOOLEAN", "email_contacto": (_variant_kind("x", "email_contacto") != "VOID") & (F.coalesce(F.trim(t("email_contacto")), F.lit("")) == ""), "ats_hostil": flag("ats_hostil"),
        "source_call": ~urls.safe_identifier(t("source_call")), "source_ids": ids("source_ids"), "duplicate_sources": ids("duplicate_sources"), "job_key": F.array_contains(keys("x"), "job_key") & ~F.coalesce(t("job_key") == key, F.lit(False))})
    named = results.where("ok").select("run", "i", "path", key.alias("k"), (urls.safe_identifier(t("portal")) & urls.safe_identifier(t("id"))).alias("good")).where("good")
    firsts = named.groupBy("run", "k").agg(F.min("i").alias("first"))
    again = named.join(firsts, ["run", "k"]).where("i > first").select("run", "path", F.lit("duplicate job_key").alias("rule"))
    failures = items("failures")
    broken = listed(failures.where("ok"), {
        "unexpected": F.size(tx.unexpected_keys(keys("x"), fixed.FAILURE_FIELDS)) > 0, **{c: ~urls.safe_identifier(t(c)) for c in ("call_id", "portal", "code")},
        "message": (F.coalesce(F.trim(t("message")), F.lit("")) == "") | contacts.has_secret(t("message")), "exit_code": F.array_contains(keys("x"), "exit_code") & ~whole("exit_code", "x"),
        **{c: optional(c) | contacts.has_secret(t(c)) for c in ("raw_file", "stderr_file", "backup_file")}, "expected": F.array_contains(keys("x"), "expected") & (_variant_kind("x", "expected") != "BOOLEAN")})
    others = [d.where("NOT ok").select("run", "path", F.lit("object").alias("rule")) for d in (results, failures)]
    return reduce(DataFrame.unionByName, [none, top, wrong, again, broken, *others])


def last_writer(single: DataFrame, batched: DataFrame, key: str = "job_key") -> DataFrame:
    """Union where the batched row wins its key; of equal keys in one side the last by ``pos`` (if there is one)."""
    both = single.withColumn("_rank", F.lit(0)).unionByName(batched.withColumn("_rank", F.lit(1)))
    names = [c for c in both.columns if c not in ("_rank", key)]
    rank = F.struct("_rank", "pos") if "pos" in both.columns else F.col("_rank")
    picked = both.groupBy(key).agg(F.max_by(F.struct(*names), rank).alias("_v"))
    return picked.select(key, "_v.*")


def tier_ordinal(tier: Column) -> Column:
    return reduce(lambda acc, x: acc.when(tier == x[1], x[0]), list(enumerate(fixed.TIERS))[1:], F.when(tier == fixed.TIERS[0], 0)).otherwise(99)


def rank_order() -> list[Column]:
    """Score down, tier, folded title and company, key."""
    return [F.col("score").desc(), tier_ordinal(F.col("tier")), tx.fold_order(F.col("title")), tx.fold_order(F.col("company")), F.col("job_key")]


def judged(candidates: DataFrame, reviews: DataFrame, critical: tuple[str, ...] = ("title", "location")) -> DataFrame:
    """Candidates beside their reviews with code and reason (null code: ranked). ``critical=()`` is the merged variant.

    A key has one review: of several the last by ``pos``, or the greatest by its fields where reviews have no order.
    """
    names = [c for c in reviews.columns if c != "job_key"]
    order = F.col("pos") if "pos" in names else F.struct(*names)
    reviews = reviews.groupBy("job_key").agg(F.max_by(F.struct(*names), order).alias("_v")).select("job_key", "_v.*")
    r = reviews.select(*[F.col(c).alias(f"r_{c}" if c != "job_key" else c) for c in reviews.columns]).withColumn("_has", F.lit(True))
    joined = candidates.join(r, "job_key", "left")
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in critical])) if critical else F.expr("cast(array() as array<string>)")
    wrong = F.col("r_error").isNotNull()
    code = F.when(F.size(missing) > 0, "RANK_FIELD_NULL").when(F.col("_has").isNull() | wrong, "RANK_FAILED")
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("candidate missing critical fields: "), F.array_join(missing, ",")))
        .when(F.col("_has").isNull(), "missing_output").when(wrong, "invalid_reviewer_output")
    )
    return joined.withColumn("code", code).withColumn("reason", reason).drop("_has")


def failure_gate(told: DataFrame, share: float = 0.30, least: int = 3) -> DataFrame:
    """One row: total, failures, aborted (strictly more than the share, and enough candidates)."""
    n = told.agg(F.count("*").alias("total"), F.count_if(F.expr("code IS NOT NULL")).alias("failures"))
    return n.withColumn("aborted", (F.col("total") >= least) & (F.col("failures") > share * F.col("total")))


def digest_rows(ranks: DataFrame, limit: int = 10) -> DataFrame:
    """The digest's table: the first rows in rank order, numbered, cells escaped (the cap is the feature)."""
    top = ranks.orderBy(*rank_order()).limit(limit)
    n = F.row_number().over(Window.orderBy(F.col("score").desc(), tier_ordinal(F.col("tier")), tx.fold_order(F.col("title")), tx.fold_order(F.col("company")), F.col("job_key")))
    return top.select(n.alias("n"), *[tx.cell(F.col(c)).alias(c) for c in ("score", "tier", "verdict", "title", "company", "location", "portal", "url") if c in ranks.columns])


def next_steps(rows: DataFrame) -> DataFrame:
    """What to do about the digest's rows, by verdict: n, step (apply or queue), title, company; others need nothing."""
    step = F.when(F.col("verdict") == fixed.VERDICTS[0], "apply").when(F.col("verdict") == fixed.VERDICTS[1], "queue")
    return rows.select("n", step.alias("step"), "title", "company").where("step IS NOT NULL")


def failure_lines(failures: DataFrame) -> DataFrame:
    """The digest's failures by key: key, code and reason as cells, with what they lack filled in."""
    has = lambda *names: F.coalesce(*[F.col(c) for c in names if c in failures.columns], F.lit(None).cast("string"))
    return failures.select(tx.cell(F.coalesce(has("job_key", "call_id"), F.lit("unknown"))).alias("key"), tx.cell(F.coalesce(has("code"), F.lit("UNKNOWN"))).alias("code"), tx.cell(has("reason", "message")).alias("reason")).orderBy("key", "code")


def check_digest_input(ranks: DataFrame, failures: DataFrame) -> None:
    """Refuse (ValueError) tables that lack what the digest shows."""
    for table, needed in ((ranks, ("job_key", "score", "tier", "verdict", "title", "company", "location", "portal", "url")), (failures, ("job_key", "code", "reason"))):
        if lacking := [c for c in needed if c not in table.columns]:
            raise ValueError(f"the digest's input lacks {', '.join(lacking)}")


def digest_lines(ranks: DataFrame, failures: DataFrame, limit: int = 10) -> DataFrame:
    """The digest as lines of Markdown (section, n from 1, line): its table, the next steps of its rows, every failure by key.

    Only the table is bounded; failures stay a distributed table, numbered without one task for all of them.
    Sections without rows have no lines.
    """
    check_digest_input(ranks, failures)
    top = digest_rows(ranks, limit)
    names = ("score", "tier", "verdict", "title", "company", "location", "portal", "url")
    rows = top.select(F.lit("priority").alias("section"), F.col("n").cast("long").alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", F.col("n").cast("string"), *names), F.lit(" |")).alias("line"))
    advice = F.when(F.col("step") == "apply", "- Apply: ").otherwise("- Keep in the queue: ")
    steps = next_steps(top).select(F.lit("next"), F.col("n").cast("long"), F.concat(advice, F.lit("**"), "title", F.lit("** ("), "company", F.lit(")")))
    bad = numbered(failure_lines(failures), [F.col("key"), F.col("code"), F.col("reason")])
    return rows.union(steps).union(bad.select(F.lit("failures"), "n", F.concat(F.lit("- `"), "key", F.lit("`: `"), "code", F.lit("` "), "reason")))


def digest_text(lines: DataFrame, day: str, run_id: str, failures: int = 20) -> str:
    """The digest as one Markdown text: the lines of ``digest_lines``, of the failures the first ones, with the number of the others."""
    names = ("#", "Score", "Tier", "Verdict", "Title", "Company", "Location", "Portal", "URL")
    shown = lines.where((F.col("section") != "failures") | (F.col("n") <= failures)).orderBy("n").collect()
    of = lambda section: [r["line"] for r in shown if r["section"] == section]
    more = lines.where((F.col("section") == "failures") & (F.col("n") > failures)).count()
    table = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *of("priority")]
    rest = [f"- and {more} more"] if more else []
    return "\n".join([f"# Digest {day}", "", f"Run: {run_id}", "", "## Priority", "", *table, "", "## Next", "", *(of("next") or ["- None"]), "", "## Failures", "", *(of("failures") or ["- None"]), *rest, ""])


def weighted_score(parts: dict[str, Column], sector_bonus: Column | None = None, language_penalty: Column | None = None, direct_email: Column | None = None) -> Column:
    """Weighted sum of sub-scores, plus bonus, minus 1.5 and plus 0.5 where they apply, within 0 to 10, one decimal."""
    total = reduce(lambda a, b: a + b, [parts[k] * w for k, w in fixed.WEIGHTS.items()])
    if sector_bonus is not None:
        total = total + sector_bonus
    if language_penalty is not None:
        total = total - F.when(language_penalty, 1.5).otherwise(0.0)
    if direct_email is not None:
        total = total + F.when(direct_email, 0.5).otherwise(0.0)
    return F.round(F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(10.0)), 6), 1)


def pay_score(pay: Column) -> Column:
    """Bands of yearly pay in thousands: 60 and more 10, 50 8, 42 6, 35 4, less 3, unknown 5."""
    return F.when(pay.isNull(), 5.0).when(pay >= 60, 10.0).when(pay >= 50, 8.0).when(pay >= 42, 6.0).when(pay >= 35, 4.0).otherwise(3.0)


def overlap_report(probe: DataFrame, known: DataFrame, title: str = "title", company: str = "company") -> DataFrame:
    """How many probed rows are known already, each counted, with the recommendation."""
    keyed = probe.select(tx.pair_key(F.col(title), F.col(company)).alias("k"))
    have = known.select(tx.pair_key(F.col(title), F.col(company)).alias("k")).distinct().withColumn("_hit", F.lit(True))
    n = keyed.join(have, "k", "left").agg(F.count("*").alias("total"), F.count_if(F.expr("_hit")).alias("duplicates"))
    share = F.when(F.col("total") > 0, 100.0 * F.col("duplicates") / F.col("total")).otherwise(0.0)
    out = n.withColumn("fresh", F.col("total") - F.col("duplicates")).withColumn("overlap_pct", F.round(share, 1))
    advice = F.when(F.col("total") == 0, "no_data").when(share > 60, "keep_off").when(100 - share > 20, "turn_on").otherwise("marginal")
    return out.withColumn("recommendation", advice)
