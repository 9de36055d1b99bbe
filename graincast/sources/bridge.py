"""The engine's tables from the driver's: postings from orders, companies from customers, fetches from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincast.functions.text import plain_company
from graincast.operators.scoring import Rules
from graincast.session import table

AS_OF = "2001-08-01"
#: What the made-up person looks for.
RULES = Rules(
    career_years=4, primary=["BUILDING", "MACHINERY"], secondary=["AUTOMOBILE"], depth_one=["ASIA"], regions=["NATION_1", "NATION_7"], employment=["REGULAR"], tech_primary=["urgent", "high"], tech_secondary=["1-", "medium"],
    excluded_companies=["Customer#00000001"], excluded_titles=["Not Specified"],
)


def postings(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    low = F.floor(F.col("o_totalprice") / 50000).cast("int")
    due = F.when(F.col("o_orderkey") % 7 == 0, F.lit("상시")).when(F.col("o_orderkey") % 7 == 1, F.lit(None)).otherwise(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd"))
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("title"), F.col("c_name").alias("company"), F.lit("").alias("canonical"),
        F.when(F.col("o_orderstatus") == "F", "platform_a").when(F.col("o_orderstatus") == "O", "platform_b").otherwise("official").alias("source"),
        F.array("r_name").alias("depth_ones"), F.array("c_mktsegment").alias("depth_twos"), F.array("n_name").alias("regions"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("REGULAR"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("CONTRACT"))).otherwise(F.array().cast("array<string>")).alias("employee_types"),
        F.when(F.col("o_orderkey") % 11 != 0, low).alias("career_min"), F.when(F.col("o_orderkey") % 11 != 0, low + (F.col("o_orderkey") % 3).cast("int")).alias("career_max"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), due.alias("deadline"), F.col("o_custkey").alias("custkey"),
    )


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth customer, with an alias; tier by segment."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    tier = F.element_at(F.array(*[F.lit(x) for x in "SABC"]), (F.length("c_mktsegment") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").filter(k % 5 == 0).select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), plain_company(F.col("c_name")).alias("name_key"), F.array(F.concat(F.lit("alias"), (k % 400).cast("string"))).alias("alias_keys"),
        (k % 3 != 0).alias("enabled"), tier.alias("tier"), F.when(k % 2 == 0, (k % 10).cast("int")).alias("priority"),
        F.when(k % 4 != 0, F.concat(F.lit("fam"), (k % 6).cast("string"))).alias("family"), F.when(k % 7 == 0, "generic_adapter_priority").when(k % 7 == 1, "adapter_candidate").when(k % 7 == 2, "restricted_research_needed").when(k % 7 == 3, "job_endpoint_research_needed").alias("status"),
        F.when(k % 2 == 0, F.concat(F.lit("https://jobs.example.com/"), (k % 20).cast("string"))).alias("careers_url"), (k % 8 == 0).alias("has_filter"),
        F.when(k % 3 == 1, F.array(F.lit("urgent"), F.lit("high"))).otherwise(none).alias("roles_include"), F.when(k % 4 == 0, F.array(F.lit("household"))).otherwise(none).alias("roles_exclude"),
        F.when(k % 9 == 0, F.array(F.lit("colour"), F.lit("teir"))).otherwise(none).alias("unknown_keys"),
        F.when(k % 10 == 0, F.array(F.struct(F.lit("official").alias("type"), F.lit("https://jobs.example.com/0").alias("url")), F.struct(F.lit("platform").alias("type"), F.lit("x").alias("url")))).otherwise(F.array().cast("array<struct<type:string,url:string>>")).alias("sources"),
    )


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), ok.alias("ok"), F.when(ok, F.floor(F.col("value") / 50).cast("long")).alias("jobs"))


def requirements(spark: SparkSession, sf: str) -> DataFrame:
    line, flag, status = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(line <= 3, "REQUIRED").when(line <= 5, "PREFERRED").otherwise("CONTEXT").alias("importance"),
        F.when(flag == "A", "FULL").when(flag == "R", "PARTIAL").when((flag == "N") & (status == "F"), "NONE").otherwise("UNKNOWN").alias("match"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("requirement"), F.when(F.col("l_suppkey") % 4 != 0, F.lit("seen")).otherwise(F.lit(" ")).alias("candidate_evidence"), F.lit("high").alias("confidence"),
    )


def seen(spark: SparkSession, sf: str) -> DataFrame:
    """State of earlier runs: postings made before the last thirty days; every third was notified."""
    p = postings(spark, sf).filter(F.col("created") < F.lit("2001-07-02"))
    return p.select("id", F.when(F.col("id") % 13 != 0, F.col("created")).alias("first_seen"), (F.col("id") % 3 == 0).alias("notified"), "created")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """``id, response``: a JSON text a user, its events as requirements."""
    e = table(spark, sf, "events")
    row = F.struct(
        "event_id", F.concat(F.lit(" req "), F.col("event_id").cast("string")).alias("requirement"), F.when(F.col("event_type") == "purchase", "full").when(F.col("event_type") == "click", "Partial").when(F.col("event_type") == "error", "none").otherwise("?").alias("match"),
        F.when(F.col("event_id") % 2 == 0, "seen").otherwise(" N/A ").alias("evidence"), F.when(F.col("event_id") % 3 == 0, "must").when(F.col("event_id") % 3 == 1, "nice to have").otherwise("x").alias("importance"),
    )
    rows = F.array_sort(F.collect_list(row))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.to_json(F.struct(rows.alias("requirements"), F.array(F.lit("a"), F.lit("A"), F.lit("b")).alias("hard_blockers"))).alias("response"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """``id, response``: an answer an order, its lines as requirements; every fourth order has none. Orders modulo 17 have a blocker that counts (0), one of years (1), one of years for newcomers only (2), one that nothing backs (3)."""
    rows = requirements(spark, sf).filter("id % 4 <> 0").withColumn("row", F.struct("requirement", "importance", "match", F.col("candidate_evidence").alias("evidence"), "confidence"))
    kind, years = F.col("id") % 17, F.concat(F.size("requirements").cast("string"), F.lit(" years of experience"))
    detail = F.when(kind == 0, "no licence").when(kind == 1, years).when(kind == 2, F.concat(F.lit("Entry level only, not "), years)).when(kind == 3, "lives abroad")
    barred = F.when(detail.isNotNull(), F.array(F.struct(detail.alias("detail"), F.when(kind == 3, "N/A").otherwise("said").alias("evidence"))))
    return rows.groupBy("id").agg(F.collect_list("row").alias("requirements")).select("id", F.to_json(F.struct("requirements", barred.alias("hard_blockers"))).alias("response"))


def details(spark: SparkSession, sf: str) -> DataFrame:
    """``id, created, body, url``; every fifth posting has none, every ninth one without a date."""
    p = postings(spark, sf).filter("id % 5 <> 0")
    return p.select("id", F.when(F.col("id") % 9 != 0, F.col("created")).otherwise("").alias("created"), F.repeat("title", 20).alias("body"), F.lit("https://x.example.com").alias("url"))


PAGE_KEYS = 800


def landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``source, term, page, status, value``: listing answers, PAGE_KEYS order keys a page.

    A's keywords are priorities, and every tenth order of any is listed under 2-HIGH again, with another title. The third page (from 0, the second) of
    5-LOW failed, page 1 of 4-NOT SPECIFIED is marked as the last, and B's category 2 has an empty page 1.
    """
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("page", F.expr(f"cast(o_orderkey div {PAGE_KEYS} as int)"))
    a = o.filter("o_orderstatus = 'F'")
    again = a.filter("o_orderkey % 10 = 0").withColumn("o_orderpriority", F.lit("2-HIGH")).withColumn("o_clerk", F.lit("again"))
    a = a.withColumn("o_clerk", F.col("o_orderpriority")).select("o_orderkey", "o_orderpriority", "o_clerk", "c_name", "c_mktsegment", "page").unionByName(again.select("o_orderkey", "o_orderpriority", "o_clerk", "c_name", "c_mktsegment", "page"))
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_clerk").alias("title"), F.struct(F.col("c_name").alias("name")).alias("company"), F.array("c_mktsegment").alias("depthTwos"), (F.col("o_orderkey") % 7).alias("careerMin"))
    pages_a = a.groupBy(F.lit("platform_a").alias("source"), F.col("o_orderpriority").alias("term"), "page").agg(F.array_sort(F.collect_list(item)).alias("content"))
    last = (F.col("term") == "4-NOT SPECIFIED") & (F.col("page") == 1)
    body_a = F.to_json(F.struct(F.struct("content", last.alias("last")).alias("data")))
    pages_a = pages_a.select("source", "term", "page", F.when((F.col("term") == "5-LOW") & (F.col("page") == 1), 503).otherwise(200).alias("status"), body_a.alias("value"))
    b = o.filter("o_orderstatus = 'O'").withColumn("term", (F.col("o_orderkey") % 3).cast("string"))
    position = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("c_name").alias("companyName"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00").alias("closedAt"))
    pages_b = b.groupBy(F.lit("platform_b").alias("source"), "term", "page").agg(F.array_sort(F.collect_list(position)).alias("positions"))
    positions = F.when((F.col("term") == "2") & (F.col("page") == 1), F.slice("positions", 1, 0)).otherwise(F.col("positions"))
    return pages_a.unionByName(pages_b.select("source", "term", "page", F.lit(200).alias("status"), F.to_json(F.struct(F.struct(positions.alias("positions")).alias("result"))).alias("value")))


#: The searches that the landed pages answer, and one nobody knows. Pages grow with the orders, so no search has a limit.
SEARCHES = {
    "sources": [
        {"type": "platform", "search": {"keywords": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"], "max_pages": None}}, {"type": "nowhere"},
        {"type": "platform_b", "search": {"job_categories": [0, 1, 2], "max_pages": None}}, {"type": "platform_b", "enabled": False},
    ],
    "filter": {"primary_depth_twos": ["backend"]},
}


def career_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that keep career pages; every 11th without an address, every 13th with one that must not be fetched, every 7th disabled."""
    k, none = F.col("s_suppkey"), F.array().cast("array<string>")
    url = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("https://c.example.com/ko/o/1/apply")).otherwise(F.concat(F.lit("https://c.example.com/"), k.cast("string"), F.lit("/ko/recruiting")))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), F.col("s_name").alias("name"), plain_company(F.col("s_name")).alias("name_key"), none.alias("alias_keys"), (k % 7 != 0).alias("enabled"),
        F.lit("greetinghr").alias("family"), F.when(k % 5 == 0, "restricted_research_needed").otherwise("adapter_candidate").alias("status"), url.alias("careers_url"), F.lit("A").alias("tier"), none.alias("roles_include"), none.alias("roles_exclude"),
    )


def career_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``company_id, at, status, final_url, html, failure``: two landings of each supplier's page, its line items' orders as openings.

    By key modulo 17: 1 has no page, 2 answers 404, 3 has no data in it, 4 broken data, 5 none of openings, 6 openings that aren't a list, 7 an empty list, 8 timed out.
    """
    lines = table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("openingId"), F.col("l_returnflag").alias("title"))
    lines = lines.withColumn("openingId", F.when(F.col("openingId") % 10 != 0, F.col("openingId")))
    openings = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("openingId", "title"))).alias("data"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).join(openings, "k", "left").filter("k % 17 <> 1")
    kind = F.col("k") % 17
    data = F.when(kind == 6, '{"a": 1}').when(kind == 7, "[]").otherwise(F.coalesce(F.to_json("data"), F.lit("[]")))
    key = F.when(kind == 5, "closings").otherwise("openings")
    page = F.concat(F.lit('{"props": {"pageProps": {"dehydratedState": {"queries": [{"queryKey": ["user", 1]}, {"queryKey": ["'), key, F.lit('"], "state": {"data": '), data, F.lit("}}]}}}}"))
    script = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.when(kind == 4, F.substring(page, 1, 60)).otherwise(page), F.lit("</script></html>"))
    html = F.when(kind.isin(2, 8), F.lit(None)).when(kind == 3, "<html></html>").otherwise(script)
    now = s.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("company_id"), F.lit(2).alias("at"), F.when(kind == 2, 404).when(kind != 8, 200).alias("status"), F.lit("https://c.example.com/").alias("final_url"), html.alias("html"), F.when(kind == 8, "timed out").alias("failure"))
    before = now.withColumn("at", F.lit(1)).withColumn("status", F.lit(500))
    return now.unionByName(before)
