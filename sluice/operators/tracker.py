"""The application tracker: upserts, outcomes and the follow-up gate over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..tables import cut, numbered


def next_action(status: Column) -> Column:
    out = None
    for state, action in fixed.NEXT_ACTIONS.items():
        out = F.when(status == state, action) if out is None else out.when(status == state, action)
    return out


def resolve(patches: DataFrame, tracker: DataFrame) -> DataFrame:
    """Patches (empresa, rol, url, ...) with ``pos`` of the tracker row each one means, or null.

    An exact URL comes first; else the first row of equal company and role where
    one side has no URL. Both are equi-joins on pre-aggregated first positions.
    """
    fold = lambda c: tx.casefold(tx.clean(F.col(c), True))
    url = F.nullif(tx.clean(F.col("url")), F.lit(""))
    t = tracker.select("pos", url.alias("u"), fold("empresa").alias("e"), fold("rol").alias("r"))
    by_url = t.where("u IS NOT NULL").groupBy("u").agg(F.min("pos").alias("by_url"))
    by_pair = t.groupBy("e", "r").agg(F.min("pos").alias("any_row"), F.min(F.when(F.col("u").isNull(), F.col("pos"))).alias("urlless_row"))
    p = patches.withColumn("u", url).withColumn("e", fold("empresa")).withColumn("r", fold("rol"))
    pair = F.when(F.col("u").isNull(), F.col("any_row")).otherwise(F.col("urlless_row"))
    return p.join(by_url, "u", "left").join(by_pair, ["e", "r"], "left").withColumn("pos", F.coalesce("by_url", pair)).drop("u", "e", "r", "by_url", "any_row", "urlless_row")


def _refuse(rows: DataFrame, bad: Column, why: str) -> None:
    if not rows.where(F.coalesce(bad, F.lit(False))).isEmpty():
        raise ValueError(why)


def check_status(rows: DataFrame, column: str) -> None:
    """Refuse (ValueError) states outside the vocabulary; null is none given."""
    _refuse(rows, ~tx.clean(F.col(column), True).isin(*fixed.NEXT_ACTIONS) & F.col(column).isNotNull(), "unknown application state")


def upsert(tracker: DataFrame, patches: DataFrame, today: str, order: tuple[str, ...] = ("empresa", "rol", "url")) -> DataFrame:
    """The tracker after a batch of patches, at most one per row of it (fold a sequence first, see fold_patches).

    Only what a patch gives replaces anything; a new row gets the day (or the
    patch's ``fecha``), the state 'draft' if none is given, and the next action of
    its state if it has none; new rows follow the old ones by ``order``. Refused
    (ValueError): patches without company or role, scores that are no number from 0
    to 10, unknown states, and several patches that mean one row.
    """
    given = lambda c: F.col(f"`{c}`") if c in patches.columns else F.lit(None).cast("string")
    _refuse(patches, (tx.clean(F.col("empresa"), True) == "") | (tx.clean(F.col("rol"), True) == ""), "company and role are required")
    _refuse(patches, given("score").isNotNull() & tx.score_text(given("score")).isNull(), "a score is a number from 0 to 10")
    if "estado" in patches.columns:
        check_status(patches, "estado")
    found = cut(resolve(patches, tracker), "patches")
    one = F.coalesce(F.concat(F.lit("row "), F.col("pos").cast("string")), F.concat(F.lit("url "), F.nullif(tx.clean(F.col("url")), F.lit(""))), F.concat_ws("\0", tx.casefold(tx.clean(F.col("empresa"), True)), tx.casefold(tx.clean(F.col("rol"), True))))
    _refuse(found.groupBy(one.alias("one")).count(), F.col("count") > 1, "several patches mean one row: fold them first")
    names = [c for c in fixed.TRACKER_COLUMNS if c != "fecha"]
    raw = {c: (F.col(f"p.`{c}`") if c in patches.columns else F.lit(None)) for c in names}
    text = {c: (tx.score_text(v) if c == "score" else tx.clean(v, c != "notas")) for c, v in raw.items()}
    value = {c: F.when(raw[c].isNotNull(), text[c]) for c in names}
    both = tracker.alias("t").join(found.where("pos IS NOT NULL").alias("p"), F.col("t.pos") == F.col("p.pos"), "left")
    kept = both.select(F.col("t.pos").alias("pos"), F.col("t.fecha").alias("fecha"), *[F.coalesce(value[c], F.col(f"t.`{c}`")).alias(c) for c in names])
    day = F.coalesce(F.col("p.fecha"), F.lit(today)) if "fecha" in patches.columns else F.lit(today)
    fresh = found.where("pos IS NULL").alias("p").select(day.alias("fecha"), *[F.coalesce(value[c], F.lit("")).alias(c) for c in names])
    last = tracker.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))
    fresh = numbered(fresh, [F.col(c) for c in order], "_n").join(last).withColumn("pos", F.col("_last") + F.col("_n")).drop("_last", "_n")
    out = kept.unionByName(fresh)
    out = out.withColumn("estado", F.when(F.coalesce("estado", F.lit("")) == "", "draft").otherwise(F.col("estado")))
    action = F.col("`próxima acción`")
    return out.withColumn("próxima acción", F.when(F.coalesce(action, F.lit("")) == "", next_action(F.col("estado"))).otherwise(action)).select("pos", *fixed.TRACKER_COLUMNS)


STATE = "key string, status string, resolved string, updated string, last_activity string, followups int, notes string, stages array<string>"


def application_key(company: Column, role: Column) -> Column:
    return F.concat_ws("_", tx.slug(company), tx.slug(role))


def merged_notes(old: Column, new: Column, day: str) -> Column:
    """The notes with a line 'day: text' more, if there is a text."""
    text = tx.clean(new)
    line = F.concat(F.lit(f"{day}: "), text)
    return F.when(text == "", F.coalesce(old, F.lit(""))).when(F.coalesce(old, F.lit("")) == "", line).otherwise(F.concat(old, F.lit("\n"), line))


def _replaced(states: DataFrame, fresh: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in STATE.split(", ")]
    return states.select(*names).join(fresh.select("key"), "key", "left_anti").unionByName(fresh.select(*names))


def record_outcomes(tracker: DataFrame, states: DataFrame, outcomes: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Tracker and states (see STATE) after a batch of outcomes, at most one per application.

    ``outcomes``: empresa, rol, status, and as far as there are notes, stages,
    resolved_date, next_action, application_date, portal, url, tier, score. Final
    states without a day of resolution take today. Refused as in ``upsert``.
    """
    _refuse(outcomes, F.col("status").isNull(), "unknown application state")
    check_status(outcomes, "status")
    has = lambda c, kind="string": F.col(c) if c in outcomes.columns else F.lit(None).cast(kind)
    company, role = tx.clean(F.col("empresa"), True), tx.clean(F.col("rol"), True)
    status, given_day = tx.clean(F.col("status"), True), tx.clean(has("resolved_date"))
    told = outcomes.select(
        application_key(company, role).alias("key"), company.alias("empresa"), role.alias("rol"), status.alias("estado"), has("notes").alias("n"), has("stages", "array<string>").alias("s"),
        F.when(given_day != "", given_day).when(status.isin(*fixed.FINAL_STATES), today).otherwise("").alias("resolved"), F.coalesce(F.nullif(has("next_action"), F.lit("")), next_action(status)).alias("próxima acción"),
        has("application_date").alias("fecha"), has("portal").alias("portal"), F.coalesce(has("url"), F.lit("")).alias("url"), has("tier").alias("tier"), has("score").cast("string").alias("score"))
    _refuse(told.groupBy("key").count(), F.col("count") > 1, "several outcomes mean one application: send them one by one")
    old = states.select("key", F.col("followups").alias("f"), F.col("notes").alias("old_notes"), F.col("stages").alias("old_stages"))
    none = F.array().cast("array<string>")
    both = cut(told.join(old, "key", "left").withColumn("notas", merged_notes(F.col("old_notes"), F.col("n"), today)), "outcomes")
    fresh = both.select(
        "key", F.col("estado").alias("status"), "resolved", F.lit(today).alias("updated"), F.lit(today).alias("last_activity"), F.coalesce("f", F.lit(0)).alias("followups"),
        F.col("notas").alias("notes"), F.array_union(F.coalesce("old_stages", none), F.coalesce("s", none)).alias("stages"))
    patches = both.select("empresa", "rol", "estado", F.col("`próxima acción`"), "notas", "fecha", "portal", F.nullif("url", F.lit("")).alias("url"), "tier", "score")
    return upsert(tracker, patches, today), _replaced(states, fresh)


def record_followups(tracker: DataFrame, states: DataFrame, requests: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracker, states and the requests with ``refusal`` after a batch of follow-up drafts (empresa, rol, number, body), one per application.

    The gate decides first, then an empty body is refused. Nothing is ever sent.
    """
    asked = requests.withColumn("key", application_key(tx.clean(F.col("empresa"), True), tx.clean(F.col("rol"), True))).withColumn("url", F.lit(""))
    _refuse(asked.groupBy("key").count(), F.col("count") > 1, "several follow-ups for one application: send them one by one")
    rows = tracker.select("pos", F.col("estado").alias("status"), F.col("fecha").alias("since"))
    old = states.select("key", F.col("status").alias("old_status"), "resolved", "last_activity", "followups", "notes", "stages")
    known = resolve(asked, tracker).join(rows, "pos", "left").join(old, "key", "left")
    known = known.withColumn("followups", F.coalesce("followups", F.lit(0))).withColumn("last_activity", F.coalesce(F.nullif("last_activity", F.lit("")), F.nullif("since", F.lit(""))))
    gated = followup_gate(known, F.col("number"), F.to_date(F.lit(today)))
    told = cut(gated.withColumn("refusal", F.coalesce("refusal", F.when(tx.clean(F.col("body")) == "", "empty_body"))), "followups")
    good = told.where("refusal IS NULL")
    note = F.concat(*[F.lit(x) if i % 2 == 0 else F.col("number").cast("string") for i, x in enumerate([fixed.FOLLOW_UP_NOTE.partition("{}")[0], "", fixed.FOLLOW_UP_NOTE.partition("{}")[2]])])
    good = good.withColumn("notes", merged_notes(F.col("notes"), note, today))
    fresh = good.select("key", F.coalesce("old_status", F.lit("")).alias("status"), F.coalesce("resolved", F.lit("")).alias("resolved"), F.lit(today).alias("updated"), F.lit(today).alias("last_activity"), F.col("number").cast("int").alias("followups"), "notes", F.coalesce("stages", F.array().cast("array<string>")).alias("stages"))
    patches = good.select("empresa", "rol", F.col("status").alias("estado"), F.lit(fixed.FOLLOW_UP_ACTION).alias("próxima acción"), F.col("notes").alias("notas"), F.lit(None).cast("string").alias("url"))
    return upsert(tracker, patches, today), _replaced(states, fresh), told.select(*requests.columns, "refusal")


def fold_patches(events: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """A sequence of patches per key to one: for each field the last value given."""
    return events.groupBy(*keys).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields], F.min(order).alias("first"), F.max(order).alias("last"))


def fold_outcomes(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """State per application after its events (status, note, stage, day, followup) in order.

    Final states without a resolution day take the day of the event that set them.
    Notes are lines 'day: text'; stages keep first appearance.
    """
    status = F.max_by("status", F.when(F.col("status").isNotNull(), F.col(order)))
    noted = F.array_sort(F.collect_list(F.when(F.coalesce(F.trim("note"), F.lit("")) != "", F.struct(order, F.concat_ws(": ", F.col("day").cast("string"), F.trim("note")).alias("line")))))
    staged = F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), F.struct(order, F.col("stage").alias("line")))))
    out = events.groupBy(*keys).agg(
        status.alias("status"), F.max_by("day", F.when(F.col("status").isNotNull(), F.col(order))).alias("set_on"), F.max("day").alias("last_activity"),
        F.count_if(F.expr("followup")).cast("int").alias("followups"), noted.alias("_n"), staged.alias("_s"),
    )
    return out.select(
        *keys, "status", F.when(F.col("status").isin(*fixed.FINAL_STATES), F.col("set_on")).alias("resolved"), "last_activity", "followups",
        F.array_join(F.transform("_n", lambda x: x["line"]), "\n").alias("notes"), F.array_distinct(F.transform("_s", lambda x: x["line"])).alias("stages"), next_action(F.col("status")).alias("next_action"),
    )


def followup_gate(states: DataFrame, number: Column, today: Column) -> DataFrame:
    """``refusal``: the first rule against follow-up ``number`` today, null if it may go out."""
    rules = (
        F.when(~number.isin(*range(1, fixed.FOLLOW_UPS + 1)), "number").when(F.col("status").isNull(), "unknown_application")
        .when(F.col("followups") >= fixed.FOLLOW_UPS, "limit").when(number != F.col("followups") + 1, "not_consecutive")
        .when(~F.col("status").isin(*fixed.FOLLOW_UP_STATES), "status").when(F.col("last_activity").isNull(), "no_activity")
        .when(F.datediff(today, F.col("last_activity")) < fixed.FOLLOW_UP_DAYS, "too_early")
    )
    return states.withColumn("refusal", rules)
