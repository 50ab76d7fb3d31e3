"""Postings: normalisation, transitive dedup, new or seen, order and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, dates, fixed, urls
from ..functions import text as tx
from ..tables import cut, numbered, spread_join
from . import graph


def _string(item: Column, name: str) -> Column:
    """A field of a JSON item if it is a string there, else null."""
    raw = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def normalize(decoded: DataFrame) -> DataFrame:
    """Items of decoded calls (call_id, portal, items) to postings, with their place ``pos`` in the call."""
    rows = decoded.select("call_id", F.col("portal").alias("p"), F.posexplode("items").alias("pos", "item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    item, mode = F.col("item"), _string(F.col("item"), "work_mode")
    flag = F.try_variant_get(item, "$.remote", "boolean")
    number = F.try_variant_get(item, "$.remote", "double")
    remote = (
        F.when(F.col("p") == "freehire", F.when(mode == "remote", True).when(mode == "onsite", False))
        .when(F.col("p").isin("remotive", "remoteok", "wwr"), True)
        .when(F.col("p") == "arbeitnow", F.coalesce(flag, number != 0, F.length(_string(item, "remote")) > 0))
    )
    own = _string(item, "portal")
    return rows.select(
        F.try_variant_get(item, "$.id", "string").alias("id"),
        F.when((F.col("p") == "wwr") & own.isin("wwr", "himalayas"), own).otherwise(F.col("p")).alias("portal"),
        *[_string(item, c).alias(c) for c in ("title", "company", "location", "url")],
        dates.lenient_date(_string(item, "date")).alias("date"),
        _string(item, "description").alias("description"),
        remote.alias("remote"), _string(item, "salary").alias("salary"), F.col("call_id").alias("source_call"), F.lit(False).alias("new"),
        contacts.contact_email(_string(item, "description")).alias("email_contacto"),
        urls.hostile_host(_string(item, "url")).alias("ats_hostil"), "pos",
    )


def components(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(node, root): rows that share any non-null key belong together, transitively; the root is the smallest node.

    Every row of a key is linked to the key's first row, so a key shared by a third of
    all rows makes as many links as rows; hot keys are dealt out.
    """
    links = None
    for k in keys:
        part = rows.where(F.col(k).isNotNull()).select(F.col(node).alias("a"), F.concat(F.lit(f"{k}="), F.col(k)).alias("k"))
        links = part if links is None else links.unionByName(part)
    lows = cut(links.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1"), "key-firsts")
    labels = graph.components(spread_join(links, lows, ["k"], ["a"]).select("a", "b"))
    root = F.coalesce("label", node).alias("root")
    return rows.select(node).join(labels.withColumnRenamed("node", node), node, "left").select(node, root)


def deduplicate(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per group of postings that share a canonical URL or a title and company.

    The earliest row stands for its group and gives the order. ``new`` holds if any
    member is new; source_ids and duplicate_sources list distinct members in order
    of arrival (the reference form may repeat them).
    """
    keyed = rows.withColumn("url_key", urls.canonical_url(F.col("url"))).withColumn("pair_key", tx.title_company_key(F.col("title"), F.col("company")))
    keyed = cut(keyed, "keyed")
    roots = components(keyed, pos, ["url_key", "pair_key"])
    told = cut(keyed.join(roots, pos), "grouped")
    counted = told.groupBy("root").agg(F.count("*").alias("size"), F.bool_or("new").alias("any_new"))
    # Members are made distinct, each with its first arrival, before they are listed.
    name = F.when(F.col("id").isNotNull(), F.concat_ws(":", "portal", "id"))
    lists = {"duplicate_sources": F.col("portal"), "source_ids": name}
    out = keyed.drop("new").join(counted, F.col(pos) == F.col("root")).withColumnRenamed("any_new", "new")
    for column, member in lists.items():
        firsts = told.select("root", member.alias("m"), F.col(pos).alias("p")).where("m IS NOT NULL").groupBy("root", "m").agg(F.min("p").alias("p"))
        listed = firsts.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias(column))
        out = out.join(listed, "root", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out.drop("root", "url_key", "pair_key")


def mark_new(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``new`` where portal:id is not in the seen table; a null id is never new."""
    key = F.when(F.col("id").isNotNull(), F.concat_ws(":", "portal", "id"))
    known = seen.select(F.col("key").alias("_key"), F.lit(True).alias("_seen"))
    return rows.drop("new").withColumn("_key", key).join(known, "_key", "left").withColumn("new", F.col("_key").isNotNull() & F.col("_seen").isNull()).drop("_key", "_seen")


def update_seen(seen: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """Old keys keep their stamps; the others get ``now``."""
    fresh = keys.select("key").where("key IS NOT NULL").distinct().select("key", F.lit(now).alias("_now"))
    return seen.join(fresh, "key", "full_outer").select("key", F.coalesce("first_seen_at", "_now").alias("first_seen_at"))


def latest_order() -> list[Column]:
    """New first, then the latest date (none last), title, company, portal, id."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "portal", "id")]
    return [F.col("new").desc(), F.col("date").desc_nulls_last(), *text]


def run_counters(calls: DataFrame, groups: DataFrame, raw: DataFrame, state_failures: int = 0) -> DataFrame:
    """The twelve counters of a run in one row: calls and their failures (and those of its state), rows before and after dedup, new and seen."""
    a = calls.agg(F.count("*").alias("calls"), F.count_if(F.expr("failure IS NULL")).alias("successful_calls"), F.count_if(F.expr("failure IS NOT NULL AND NOT failure.expected")).alias("failed_calls"), F.count_if(F.expr("failure.expected")).alias("skipped_calls"))
    b = groups.agg(F.count("*").alias("results"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("deduplicated"), F.count_if(F.expr("new")).alias("new"), F.count_if(F.expr("NOT new")).alias("seen"))
    c = raw.agg(F.count("*").alias("raw_results"))
    one = a.join(b).join(c)  # three single rows
    failures = F.col("calls") - F.col("successful_calls") + state_failures
    return one.select("*", F.col("results").alias("normalized_results"), failures.alias("failures"), F.col("skipped_calls").alias("skipped"))


def in_matrix_order(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """Rows of calls (call_id, pos) numbered in the order of the matrix, not of completion: ``arrival`` from 1."""
    placed = rows.join(matrix.select("call_id", "ordinal"), "call_id")
    return numbered(placed, [F.col("ordinal"), F.col("pos")], "arrival").drop("ordinal")


def digest_order() -> list[Column]:
    """New first, then the latest date; what is no plain date last; title, company, portal, id."""
    plain = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date"))
    return [F.col("new").desc(), plain.desc_nulls_last(), *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "portal", "id")]]


def latest_lines(rows: DataFrame) -> DataFrame:
    """The latest postings as rows of a Markdown table in digest order: n from 1, line. Texts stand as they are, a dash for none."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    title = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("["), dash("title"), F.lit("]("), "url", F.lit(")"))).otherwise(dash("title"))
    cells = [F.col("n").cast("string"), F.lit(fixed.PENDING), title, dash("company"), dash("location"), dash("portal"), dash("date"), F.when(F.col("new"), fixed.YES).otherwise(fixed.NO)]
    placed = numbered(rows, digest_order())
    return placed.select("n", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
