"""Raw answers of job portals, mapped to common items by a table of fields.

A portal is where its list of items stands in an answer and, for each common field,
a rule that makes a typed column of an item. The table is compiled to one expression
over the parsed answer: nothing is exploded or shuffled, and an answer stays a row.
What a portal cannot search by itself (words, remote work) is filtered here, as is the
number of items asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

FIELDS = ("id", "title", "company", "location", "url", "date", "description", "salary", "remote", "portal", "work_mode")
Rule = Callable[[Column], Column]


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def at(path: str) -> Rule:
    """What stands at a path if it is a string, blank ones as null."""
    return lambda x: F.when(_kind(F.try_variant_get(x, path, "variant")) == "STRING", F.nullif(F.try_variant_get(x, path, "string"), F.lit("")))


def scalar(path: str) -> Rule:
    """A string, number or truth value as a string."""
    return lambda x: F.try_variant_get(x, path, "string")


def truth(path: str) -> Rule:
    return lambda x: F.when(_kind(F.try_variant_get(x, path, "variant")) == "BOOLEAN", F.try_variant_get(x, path, "boolean"))


def constant(value: str | bool) -> Rule:
    return lambda x: F.lit(value)


def first_of(*rules: Rule) -> Rule:
    return lambda x: F.coalesce(*[r(x) for r in rules])


def plain(path: str) -> Rule:
    """HTML as plain text."""
    return lambda x: tx.strip_html(at(path)(x))


def day(path: str) -> Rule:
    """The day of a date-time, as written."""
    return lambda x: F.substring(at(path)(x), 1, 10)


def epoch_day(path: str) -> Rule:
    """The day (UTC) of seconds, or milliseconds, since 1970."""

    def rule(x: Column) -> Column:
        n = F.try_variant_get(x, path, "long")
        return F.date_format(F.timestamp_seconds(F.when(F.abs(n) >= 100_000_000_000, F.floor(n / 1000)).otherwise(n)), "yyyy-MM-dd")

    return rule


def mail_day(path: str) -> Rule:
    """The day of a date as mails and feeds write it: Tue, 21 Jul 2026 10:00:00 +0000."""
    return lambda x: F.date_format(F.try_to_date(F.regexp_extract(at(path)(x), r"\b(\d{1,2} [A-Z][a-z]{2} \d{4})\b", 1), "d MMM yyyy"), "yyyy-MM-dd")


def digest(path: str) -> Rule:
    return lambda x: F.sha2(at(path)(x), 256)


def before(path: str, mark: str) -> Rule:
    """What stands before the first mark; null without one."""
    return lambda x: F.when(F.contains(at(path)(x), F.lit(mark)), F.trim(F.substring_index(at(path)(x), mark, 1)))


def after(path: str, mark: str) -> Rule:
    """What stands after the first mark, or all without one."""

    def rule(x: Column) -> Column:
        text = at(path)(x)
        i = F.instr(text, mark)
        return F.trim(F.when(i > 0, F.substr(text, i + len(mark))).otherwise(text))

    return rule


def listed(path: str) -> Rule:
    """The strings of an array, joined by commas; null if there are none."""
    return lambda x: F.nullif(F.array_join(F.try_variant_get(x, path, "array<string>"), ", "), F.lit(""))


def _number(x: Column, path: str) -> Column:
    n = F.coalesce(F.try_variant_get(x, path, "double"), F.try_variant_get(x, f"{path}.value", "double"))
    return F.when(n > 0, F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string")))


def pay(low: str, high: str, unit: str = "", both: bool = False) -> Rule:
    """'low-high unit' of numbers above 0, the one there is if one is missing (``both``: then null)."""

    def rule(x: Column) -> Column:
        a, b = _number(x, low), _number(x, high)
        span = F.concat_ws("-", a, b)
        told = F.when((a.isNotNull() & b.isNotNull()) if both else (span != ""), span)
        return F.concat(told, F.lit(f" {unit}")) if unit else told

    return rule


def mentions(path: str, *words: str) -> Rule:
    """True where a text holds one of the words, else null."""
    return lambda x: F.when(F.lower(at(path)(x)).rlike("|".join(words)), True)


@dataclass(frozen=True)
class Portal:
    """``items``: the path of the list; ``rules`` by common field (none: items are in the common form); ``words``: what a local search looks through (none: the portal searches); ``skip``: items that are none."""

    items: str
    rules: dict[str, Rule]
    words: tuple[Rule, ...] = ()
    skip: str | None = None
    feed: bool = False


def _unsearched(*fields: str) -> tuple[Rule, ...]:
    return tuple(listed(f) if f == "$.tags" else at(f) for f in fields)


# Names of the fields of each portal's answers.
PORTALS = {
    "adzuna": Portal("$.results", {
        "id": scalar("$.id"), "title": at("$.title"), "company": at("$.company.display_name"), "location": at("$.location.display_name"), "url": at("$.redirect_url"), "date": day("$.created"),
        "description": plain("$.description"), "salary": pay("$.salary_min", "$.salary_max", "EUR")}),
    "remotive": Portal("$.jobs", {
        "id": scalar("$.id"), "title": at("$.title"), "company": at("$.company_name"), "location": at("$.candidate_required_location"), "url": at("$.url"), "date": day("$.publication_date"),
        "description": plain("$.description"), "salary": at("$.salary"), "remote": constant(True)}),
    "remoteok": Portal("$", {
        "id": scalar("$.id"), "title": at("$.position"), "company": at("$.company"), "location": first_of(at("$.location"), constant("Worldwide")), "url": at("$.url"), "date": day("$.date"),
        "description": plain("$.description"), "salary": pay("$.salary_min", "$.salary_max", both=True), "remote": constant(True)}, _unsearched("$.position", "$.tags", "$.description"), skip="$.legal"),
    "arbeitnow": Portal("$.data", {
        "id": scalar("$.slug"), "title": at("$.title"), "company": at("$.company_name"), "location": at("$.location"), "url": at("$.url"), "date": epoch_day("$.created_at"),
        "description": plain("$.description"), "remote": truth("$.remote")}, _unsearched("$.title", "$.tags", "$.description")),
    "wwr": Portal("$.channel.item", {
        "id": digest("$.link"), "title": after("$.title", ": "), "company": before("$.title", ": "), "location": first_of(at("$.region"), constant("Remote")), "url": at("$.link"), "date": mail_day("$.pubDate"),
        "description": plain("$.description"), "remote": constant(True), "portal": constant("wwr")}, _unsearched("$.title", "$.description"), feed=True),
    "himalayas": Portal("$.jobs", {
        "id": first_of(scalar("$.guid"), digest("$.applicationLink")), "title": at("$.title"), "company": at("$.companyName"), "location": first_of(listed("$.locationRestrictions"), constant("Remote")), "url": at("$.applicationLink"),
        "date": epoch_day("$.pubDate"), "description": plain("$.description"), "salary": pay("$.minSalary", "$.maxSalary"), "remote": constant(True), "portal": constant("himalayas")}, _unsearched("$.title", "$.description")),
    # These two answer in the common form.
    "freehire": Portal("$.results", {}), "linkedin": Portal("$.results", {}),
    "infojobs": Portal("$.offers", {
        "id": scalar("$.id"), "title": at("$.title"), "company": at("$.author.name"), "location": first_of(at("$.city"), at("$.province.value")), "url": at("$.link"), "date": day("$.updated"),
        "description": plain("$.requirementMin"), "salary": pay("$.salaryMin", "$.salaryMax"), "remote": mentions("$.teleworking.value", "remoto", "teletrabajo")}),
}
FEED = "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string, region: string>>>"


def _by_portal(source: Column, what: Callable[[Portal], Column]) -> Column:
    """A column by the source's portal, null where there is none."""
    out = None
    for name, portal in PORTALS.items():
        out = F.when(source == name, what(portal)) if out is None else out.when(source == name, what(portal))
    return out


def _wanted(portal: Portal, x: Column, query: Column, remote_only: Column) -> Column:
    """Whether an element of the list is an item that the call asked for."""
    if not portal.rules:
        return F.lit(True)
    keep = _kind(x).startswith("OBJECT")
    if portal.skip:
        keep = keep & F.try_variant_get(x, portal.skip, "variant").isNull()
    if portal.words:
        hay = F.lower(F.concat_ws(" ", *[w(x) for w in portal.words]))
        words = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != "")
        keep = keep & F.forall(words, lambda w: F.contains(hay, w))
        if "remote" in portal.rules:
            keep = keep & (~F.coalesce(remote_only, F.lit(False)) | F.coalesce(portal.rules["remote"](x), F.lit(False)))
    return F.coalesce(keep, F.lit(False))


def _common(portal: Portal, x: Column) -> Column:
    """An item in the common form."""
    if not portal.rules:
        return x
    none = {f: F.lit(None).cast("boolean" if f == "remote" else "string") for f in FIELDS}
    return F.to_variant_object(F.struct(*[(portal.rules[f](x) if f in portal.rules else none[f]).alias(f) for f in FIELDS]))


def decode_portals(answers: DataFrame) -> DataFrame:
    """``answers`` with items (array of variants) and failure, as decode_calls gives them for answers in the common form.

    ``answers``: call_id, portal, body (the portal's own JSON or feed), exit_code and stderr, and as far as there
    are source (which of a portal's sources it is, else the portal itself), query, remote_only and most (items asked
    for). Failures are those of the common form, with MALFORMED_XML for feeds; a portal without a map is UNKNOWN_PORTAL.
    Items that are no objects go one by one; fields of another kind than the map says are null.
    """
    from .files import process_failure

    has = lambda c, kind: F.col(c) if c in answers.columns else F.lit(None).cast(kind)
    source = F.coalesce(has("source", "string"), F.col("portal"))
    names, feeds = [*PORTALS], [p for p, m in PORTALS.items() if m.feed]
    is_feed, body = source.isin(feeds), F.col("body")
    feed = F.from_xml(F.when(is_feed, body), FEED)
    told = answers.withColumn("_v", F.when(is_feed, F.to_variant_object(feed)).otherwise(F.try_parse_json(F.when(~is_feed, body))))
    own = F.try_variant_get(F.col("_v"), _by_portal(source, lambda p: F.lit(p.items)), "variant")
    told = told.withColumn("_list", F.try_variant_get(F.when(_kind(own).startswith("ARRAY"), own), "$", "array<variant>"))
    fail = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(False).alias("expected"))
    rss = F.when(is_feed, F.regexp_like(body, F.lit(r"(?s)<rss\b.*<channel\b.*</rss>")))
    failure = (
        F.when(F.col("exit_code") != 0, process_failure())
        .when(~source.isin(names), fail("UNKNOWN_PORTAL", "no map for this portal"))
        .when(body.isNull(), fail("MALFORMED_JSON", "could not read raw file")).when(F.trim(body) == "", fail("MALFORMED_JSON", "empty stdout"))
        .when(is_feed & ~F.coalesce(rss, F.lit(False)), fail("MALFORMED_XML", "the answer is no feed"))
        .when(~is_feed & F.col("_v").isNull(), fail("MALFORMED_JSON", "stdout is not valid JSON"))
        .when(~is_feed & F.col("_list").isNull(), fail("INVALID_ENVELOPE", "the list of items is missing or not an array"))
    )
    query, remote_only = has("query", "string"), has("remote_only", "boolean")
    wanted = F.filter("_list", lambda x: _by_portal(source, lambda p: _wanted(p, x, query, remote_only)))
    items = F.transform(wanted, lambda x: _by_portal(source, lambda p: _common(p, x)))
    told = told.withColumn("failure", failure).withColumn("items", F.when(F.col("failure").isNull(), F.coalesce(items, F.array().cast("array<variant>"))))
    most = has("most", "int")
    return told.withColumn("items", F.when(most.isNull(), F.col("items")).otherwise(F.slice("items", 1, F.greatest(most, F.lit(0))))).drop("_v", "_list")
