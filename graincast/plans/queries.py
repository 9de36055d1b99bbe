"""The posting engine's queries. Each returns scalars under explicit names; the run's date is pinned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincast import outputs
from graincast.functions import text as T
from graincast.operators import dedup, evidence, fit, health, matches, novelty, registry, scoring
from graincast.session import scratch_path, table
from graincast.sources import adapters, careers, collecting, landed
from graincast.sources import bridge as B

R = B.RULES
RUN = matches.Run(as_of=B.AS_OF, judge_budget=200, crawl=True, crawl_budget=30)
TITLE_OUT = ["medium"]
WHOLE = matches.Run(as_of=B.AS_OF, window=400, judge_budget=200, detail_budget=300, retention=365, title_exclude=tuple(TITLE_OUT), rules=B.RULES)


def _scored(s, d) -> DataFrame:
    return scoring.with_rule_score(B.postings(s, d), R)


def _resolved(s, d) -> DataFrame:
    return registry.resolve(B.postings(s, d).withColumn("k", T.plain_company(F.col("company"))), B.companies(s, d), "k", carry=("roles_include", "roles_exclude"))


def postings_union(s, d):
    """Bag union of the sources, source order then arrival."""
    p = B.postings(s, d)
    parts = [p.filter(F.col("source") == x).withColumn("nth", F.lit(i)) for i, x in enumerate(("platform_a", "platform_b", "official"))]
    return collecting.united(parts).select("nth", "seq", "source", "id", "title", "company", "deadline")


def _landed(s, d) -> collecting.Collected:
    """The collection from answers that lie as files: written here from the tables, read by the data source."""
    path = scratch_path(s, "answers")
    B.landed_pages(s, d).write.partitionBy("source", "term", "page", "status").text(path)
    return collecting.from_pages(s, path, B.SEARCHES)


def landed_postings(s, d):
    """What the walks over landed pages give: an id listed again keeps its place and has the last values."""
    return _landed(s, d).postings.select("id", "nth", "source", "title", "company", F.array_join("depth_twos", ",").alias("depths"), "synthetic", "career_min", "deadline")


def landed_sources(s, d):
    """A result of each source: walks that ended early, failed or found nothing don't stop the others."""
    return _landed(s, d).sources


def career_results(s, d):
    """A result of each company's page: failed, empty and full stay apart."""
    return careers.results(careers.fetched(B.career_companies(s, d), B.career_pages(s, d)))


def career_openings(s, d):
    """Postings of the companies whose page could be read."""
    c = B.career_companies(s, d)
    return careers.postings(careers.fetched(c, B.career_pages(s, d)), c).select("id", "title", "company", "canonical", "deadline", "detail_url")


def reposts(s, d):
    """Whole rows of first arrivals, filled from later ones."""
    return dedup.merged(B.postings(s, d)).select("id", "title", "company", "deadline", "n_merged", F.array_join("sources", ",").alias("sources"))


def _run(s, d) -> matches.Outcome:
    seen = B.seen(s, d).withColumn("created_at", F.when(F.col("id") % 2 == 0, F.col("created")))
    crawled = B.postings(s, d).select("id", F.lit("").alias("text")).limit(0)
    return matches.run_all(B.postings(s, d).withColumn("detail_url", F.lit("")), B.companies(s, d), seen, B.details(s, d), crawled, B.answers(s, d), WHOLE)


def run_matches(s, d):
    """A whole run over the tables: names, reposts, rules, watch-list, dates, budgets, evidence, recommendation."""
    return _run(s, d).matches.select("id", "target", "score", "recommendation", "deferred", "n_merged", "jd_source", "created_at")


def run_note(s, d):
    """The first 100 of that run's note, in its order."""
    rows = _run(s, d).matches.filter(matches.in_note(WHOLE)).withColumn("rank", outputs.rank())
    return _placed(rows, 100, F.desc("target"), "rank", F.desc("score"), "seq").select("place", "id", "rank")


def run_cards(s, d):
    """What that run's cards say."""
    return matches.cards(_run(s, d).matches, WHOLE).select("id", "rule", *[F.col(f"card.{c}").alias(c) for c in ("score", "company", "verdict", "deadline", "career", "scored", "recommendation", "target", "tier")])


def run_state(s, d):
    """The state after that run: who was told, and what is old is gone."""
    return _run(s, d).state


def run_counters(s, d):
    """The run's own counters, observed while its tables are written."""
    told = _run(s, d).counters
    return s.createDataFrame([tuple(told.values())], ", ".join(f"{k} long" for k in told))


def run_samples(s, d):
    """The first postings of excluded companies, those that roles left out, and names near the watch-list's."""
    return _run(s, d).samples


def company_normalize(s, d):
    c = table(s, d, "customer").select(F.concat(F.col("c_name"), F.lit(" Co., Ltd.")).alias("raw"))
    u = c.union(table(s, d, "supplier").select(F.concat(F.lit("Inc. "), F.col("s_name"))))
    return u.select("raw", T.normalize_company(F.col("raw")).alias("key"))


def title_keys(s, d):
    return B.postings(s, d).select("id", dedup.loose_key().alias("loose"), dedup.exact_key().alias("exact"))


def dedup_survivors(s, d):
    return dedup.survivors(B.postings(s, d).withColumn("company", F.concat(F.lit("C"), F.col("custkey") % 50))).select("id", "sources", "merged", "deadline", "created")


def ambiguous_keys(s, d):
    return dedup.ambiguous(B.postings(s, d))


def text_dedup(s, d):
    t = table(s, d, "documents").select("doc_id", F.lower(T.squeeze(F.col("text"))).alias("k"))
    return t.groupBy(F.sha2("k", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


def exclusions(s, d):
    return B.postings(s, d).select("id", scoring.company_excluded(R).alias("company_out"), scoring.title_excluded(R).alias("title_out"))


def score_parts(s, d):
    return _scored(s, d).select("id", "p_role", "p_career", "p_tech", "p_region", "p_employment")


def rule_score(s, d):
    return _scored(s, d).select("id", "rule", "qualified")


def rule_topk(s, d):
    return _scored(s, d).filter("qualified").orderBy(F.desc("rule"), "seq").limit(50).select("id", "company", "title", "rule")


def resolve_target(s, d):
    return _resolved(s, d).select("id", "target_id", F.coalesce("target_id", F.nullif(F.col("canonical"), F.lit(""))).alias("canonical_id"))


def alias_collisions(s, d):
    return registry.collisions(B.companies(s, d))


def near_misses(s, d):
    names = table(s, d, "part").select(F.lower(T.squeeze(F.col("p_name"))).alias("raw"))
    words = table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("key"))
    return registry.near_misses(names, words)


def qualify_reason(s, d):
    return registry.qualify(_resolved(s, d), TITLE_OUT, unicode=False).select("id", "target_id", "reason")


def mode_union(s, d):
    """Discovery and target in one pass; a posting that is both counts once."""
    q = registry.qualify(_resolved(s, d), TITLE_OUT, unicode=False)
    q = scoring.with_rule_score(q, R).withColumn("target", F.col("target_id").isNotNull() & F.col("reason").isNull())
    return q.filter("qualified or target").agg(F.count_if("qualified").alias("discovery"), F.count_if("target").alias("target"), F.count(F.lit(1)).alias("both"))


def families(s, d):
    return registry.families(B.companies(s, d))


def collectible_families(s, d):
    return registry.collectible(B.companies(s, d))


def portal_conflicts(s, d):
    return registry.portal_conflicts(B.companies(s, d))


def research_needed(s, d):
    return registry.research_needed(B.companies(s, d))


def tier_listing(s, d):
    return registry.tier_listing(B.companies(s, d))


def seen_upsert(s, d):
    return novelty.upsert(B.seen(s, d), B.postings(s, d), B.AS_OF)


def seen_retention(s, d):
    return novelty.retain(B.seen(s, d), B.AS_OF, 365).select("id", "first_seen")


def not_notified(s, d):
    told = B.seen(s, d).filter("notified").select("id")
    return B.postings(s, d).join(told, "id", "left_anti").select("id", "created")


def created_cache(s, d):
    """Cached date, else the detail's, else first seen."""
    details = B.postings(s, d).filter("id % 5 <> 0").select("id", F.when(F.col("id") % 9 == 0, F.lit("")).otherwise(F.col("created")).alias("detail"))
    cached = B.seen(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("created")).alias("cached"), "first_seen")
    return B.postings(s, d).select("id").join(cached, "id", "left").join(details, "id", "left").select("id", F.coalesce("cached", F.nullif(F.col("detail"), F.lit("")), F.coalesce("first_seen", F.lit(B.AS_OF))).alias("created_at"))


def fresh_window(s, d):
    return novelty.fresh(B.postings(s, d), B.AS_OF, 30).select("id", "age")


def assess_budget(s, d):
    q = novelty.budgeted(_scored(s, d).filter("qualified"), 200)
    return q.select("id", "rule", "in_budget", (~F.col("in_budget")).alias("deferred"))


def detail_budget(s, d):
    """The best 100 of those whose detail can be had: only successes use the budget."""
    details = B.postings(s, d).filter("id % 5 <> 0").select("id")
    return _scored(s, d).join(details, "id", "left_semi").orderBy(F.desc("rule"), "seq").limit(100).select("id", "rule")


def thin_bodies(s, d):
    body = table(s, d, "documents").select("doc_id", F.char_length("text").alias("n"))
    return body.filter("n < 400").orderBy("doc_id").limit(15)


def deadline_states(s, d):
    label, days, state = novelty.deadline_state("deadline", B.AS_OF)
    return B.postings(s, d).select("id", label.alias("label"), days.alias("days"), state.alias("state"))


def requirement_normalize(s, d):
    return fit.normalize(B.requirements(s, d)).groupBy("importance", "match", "confidence", "demoted").agg(F.count(F.lit(1)).alias("n"))


def match_axis(s, d):
    return fit.match_axes(fit.normalize(B.requirements(s, d)))


def _fit(s, d) -> DataFrame:
    a = fit.match_axes(fit.normalize(B.requirements(s, d)))
    j = _scored(s, d).join(a, "id")
    axes = {"required": F.col("required"), "preferred": F.col("preferred"), "tech": F.col("p_tech"), "career": F.col("p_career"), "preference": (F.col("p_region") + F.col("p_employment")) / 2}
    j = j.withColumn("fit", fit.fit_score(axes)).withColumn("gap", fit.career_gap("career_min", R.career_years))
    known, total = F.col("required_known"), F.col("required_total")
    barred = F.when(F.col("id") % 17 == 0, F.array(F.struct(F.lit("no licence").alias("detail")))).otherwise(F.array().cast("array<struct<detail:string>>"))
    args = (F.col("fit"), known, total, F.col("gap"), F.col("title").contains("URGENT"))
    return j.withColumns({"recommendation": fit.recommendation(*args, F.col("id") % 17 == 0), "why": fit.reasons(*args, barred)})


def fit_score(s, d):
    return _fit(s, d).select("id", "fit", "gap")


def recommend(s, d):
    return _fit(s, d).select("id", "recommendation")


def _matches(s, d) -> DataFrame:
    label, days, state = novelty.deadline_state("deadline", B.AS_OF)
    m = _fit(s, d).withColumn("target", F.col("custkey") % 5 == 0).withColumn("score", F.coalesce("fit", "rule"))
    m = m.withColumns({"days": days, "state": state, "deferred": F.col("id") % 19 == 0})
    top = F.col("recommendation").isin("STRONG_APPLY", "APPLY")
    return m.withColumn("eligible", ~F.col("deferred") & F.when(F.col("recommendation").isNotNull(), top).otherwise(F.col("score") >= 60))


def _placed(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows with their ``place``: numbered after the limit, so over ``n`` rows only."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def note_rank(s, d):
    m = _matches(s, d).filter(matches.in_note(RUN)).withColumn("rank", outputs.rank())
    return _placed(m, 100, F.desc("target"), "rank", F.desc("score"), "seq").select("id", "target", "rank", "score", "place")


def push_top8(s, d):
    return _placed(outputs.pushed(_matches(s, d), 60.0), outputs.PUSHED, F.desc("target"), F.desc("score"), "seq").select("id", "target", "score", "place")


def push_overflow(s, d):
    told = outputs.pushed(_matches(s, d), 60.0)
    return told.agg(F.count(F.lit(1)).alias("told"), F.count_if("target").alias("targets"), F.greatest(F.lit(0), F.count(F.lit(1)) - outputs.PUSHED).alias("more"))


def final_order(s, d):
    """Matches best first; equal scores keep the order of rule scores, then of arrival."""
    return _placed(_matches(s, d), 60, F.desc("score"), F.desc("rule"), "seq").select("id", "score", "place")


def recommend_why(s, d):
    return _fit(s, d).select("id", F.array_join("why", "; ").alias("why"))


def _dashboard(s, d) -> DataFrame:
    m = _matches(s, d)
    card = F.struct("score", "company", "title", F.lit("#").alias("url"), F.lit(None).cast("string").alias("verdict"), "deadline", F.lit("").alias("one_liner"), F.lit("-").alias("career"), F.lit("-").alias("region"), F.col("fit").isNotNull().alias("scored"), F.lit(B.AS_OF).alias("date"), "recommendation", "target", F.lit("A").alias("tier"))
    return outputs.dashboard_rows(m.select("id", F.col("created").alias("first_seen"), card.alias("card")), RUN)


def dashboard_rank(s, d):
    return _dashboard(s, d).select("id", "score", "hot", "urgent", "expired", "dsort", "verdict")


def dashboard_order(s, d):
    """The page's two orders: by score, and by deadline."""
    rows = _dashboard(s, d)
    best = _placed(rows, 40, F.desc("score"), "dsort", "id").withColumn("by", F.lit("score"))
    due = _placed(rows, 40, "dsort", F.desc("score"), "id").withColumn("by", F.lit("due"))
    return best.unionByName(due).select("by", "id", "place")


def dashboard_search(s, d):
    return outputs.searched(_dashboard(s, d), " 0000012 ").select("id", "company")


def dashboard_kpis(s, d):
    return dashboard_rank(s, d).agg(F.count(F.lit(1)).alias("total"), F.count_if("hot").alias("hot"), F.count_if("urgent").alias("urgent"))


def run_stats(s, d):
    return _matches(s, d).agg(F.count(F.lit(1)).alias("matches"), F.count_if("deferred").alias("deferred"), F.count_if("eligible").alias("eligible"), F.count_if("target").alias("targets"), F.count_if(F.col("recommendation").isNull()).alias("unjudged"))


def health_rollup(s, d):
    return health.rollup(B.fetches(s, d)).select("source_id", "n_fetches", "jobs_seen", "consecutive_failures", "last_nonzero")


def health_warnings(s, d):
    return health.warnings(health.rollup(B.fetches(s, d))).select("source_id", "warning")


def health_summary(s, d):
    return health.summary(B.fetches(s, d))


def health_stale(s, d):
    return health.rollup(B.fetches(s, d)).select("source_id", F.datediff(F.lit("2024-02-01").cast("date"), F.col("last_success").cast("date")).alias("days"))


def page_extract(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.parse_url("url", F.lit("PATH")).rlike("^/en/").alias("english_path"))


def event_json(s, d):
    e = table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("k").alias("n"))


def positions_fold(s, d):
    """Widest range and distinct values over an opening's positions, in one aggregation."""
    li = table(s, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.min("l_quantity").alias("career_from"), F.max("l_quantity").alias("career_to"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("fields"))


def last_value_upsert(s, d):
    """By-id upsert of pages of results: the last value wins, the first place is kept."""
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.min("event_id").alias("place"), F.max_by("event_type", "event_id").alias("event_type"))


def robots_guard(s, d):
    """Addresses that must not be fetched: the pages' own, and forms, mobile and admin pages beside them."""
    p = table(s, d, "pages").filter("url is not null")
    site = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    beside = [F.col("url"), F.concat(site, F.lit("/ko/o/"), F.col("page_id"), F.lit("/apply?from="), F.col("url")), F.concat(site, F.lit("/m/"), F.col("page_id")), F.concat(site, F.lit("/en/a/"), F.col("page_id")), F.concat(F.col("url"), F.lit("/apply"))]
    urls = p.select("page_id", F.posexplode(F.array(*beside)).alias("nth", "url"))
    return urls.select("page_id", "nth", adapters.forbidden(F.col("url")).alias("blocked"))


def role_names(s, d):
    return table(s, d, "part").select(F.concat(F.lit("Back-end / "), F.col("p_name")).alias("raw")).distinct().select("raw", T.role_text(F.col("raw"), unicode=False).alias("key"))


def company_legal(s, d):
    """Korean and bracketed legal forms, glued or apart."""
    marks = F.array(*map(F.lit, ("주식회사", "( 주 )", "(有) ", "유한책임회사 ")))
    raw = F.concat(F.element_at(marks, (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, " Pte. Ltd.").otherwise(""))
    return table(s, d, "customer").select(raw.alias("raw"), T.normalize_company(raw).alias("key"))


def key_typos(s, d):
    return registry.key_typos(B.companies(s, d))


def unclassified(s, d):
    return registry.unclassified(B.companies(s, d))


def official_urls(s, d):
    return registry.official_urls(B.companies(s, d)).select("id", F.array_join("urls", " ").alias("urls"), F.array_join("types", " ").alias("types"))


def adapted_companies(s, d):
    return registry.adapted(B.companies(s, d), ["fam1", "fam2"]).select("id", "family")


def blocker_adoption(s, d):
    """Which candidate blockers of the answers count, and why the others don't."""
    told = evidence.typed(B.answers(s, d)).select("evidence.hard_blockers")
    counts, rejected = evidence.adopted(F.col("hard_blockers"))
    rows = told.select(F.explode(F.concat(counts, rejected)).alias("b"))
    return rows.groupBy("b.kind", "b.detail", F.coalesce("b.reject", F.lit("adopted")).alias("reject")).agg(F.count(F.lit(1)).alias("n"))


def evidence_narrow(s, d):
    """Responses narrowed: capped rows, demoted claims, blockers told once."""
    e = evidence.typed(B.responses(s, d))
    rows = F.col("evidence.requirements")
    full = F.size(F.filter(rows, lambda r: r["match"] == "FULL"))
    must = F.size(F.filter(rows, lambda r: r["importance"] == "REQUIRED"))
    return e.select("id", F.size(rows).alias("n_rows"), F.col("evidence.truncated").alias("truncated"), F.col("evidence.demoted").alias("demoted"), rows[0]["requirement"].alias("first"), full.alias("n_full"), must.alias("n_required"), F.array_join(F.transform("evidence.hard_blockers", lambda b: b["detail"]), ",").alias("blockers"))


def evidence_deferral(s, d):
    """What is over the budget, or asked without an answer, is put off."""
    best = _scored(s, d).filter("qualified")
    answers = best.filter("id % 3 <> 0").select("id", F.lit('{"requirements": []}').alias("response"))
    return matches.assessed(best, answers, RUN).select("id", "in_budget", "failed", "deferred")


def body_sources(s, d):
    """Thin bodies are crawled within a budget; what came back too short doesn't count."""
    best = _scored(s, d).filter("qualified")
    details = best.select("id", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), 300)).otherwise("short").alias("body"), F.when(F.col("id") % 5 != 0, "https://x.example.com").alias("url"), "created")
    crawled = best.select("id", F.repeat(F.lit("y"), F.when(F.col("id") % 7 == 0, F.lit(100)).otherwise(7000).cast("int")).alias("text"))
    return matches.bodies(best, details, crawled, RUN).select("id", "jd_source", F.char_length("body").alias("n"))


def _told(s, d, seed: bool) -> DataFrame:
    m = _matches(s, d)
    listed, seen = B.postings(s, d), B.seen(s, d).withColumn("created_at", F.when(F.col("id") % 2 == 0, F.col("created")))
    fresh = m.filter("id % 4 = 0").select("id", F.col("created").alias("created_at"))
    return matches.next_state(seen, listed, fresh, m.filter(matches.in_note(RUN)), matches.Run(as_of=B.AS_OF, seed=seed))


def told_marking(s, d):
    return _told(s, d, False)


def seed_marking(s, d):
    """A seeding run marks what is fresh and shows nothing."""
    return _told(s, d, True).agg(F.count(F.lit(1)).alias("n"), F.count_if("notified").alias("told"))


def platform_b_postings(s, d):
    """Pages list an id again; the roles asked for stand in for depths and are marked as made up."""
    o = table(s, d, "orders")
    raw = o.select((F.col("o_orderkey") % 1000).alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 9 != 0, "c").alias("companyName"), F.lit(1).alias("minCareer"), F.lit(5).alias("maxCareer"), F.array(F.lit("서울")).alias("locations"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00").alias("closedAt"), (F.col("o_orderkey") % 5 == 0).alias("alwaysOpen"))
    out = adapters.PlatformB(roles=("backend",), site="https://b.example.com").postings(raw)
    return out.select("id", "seq", "title", (F.col("company") == "?").alias("unnamed"), F.array_join("depth_twos", ",").alias("depths"), "synthetic", "deadline", "detail_url")


def platform_b_details(s, d):
    c = table(s, d, "customer")
    raw = c.select(F.col("c_custkey").alias("id"), F.lit("2001-01-02").alias("publishedAt"), F.col("c_name").alias("responsibility"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("qualifications"), F.lit(None).cast("string").alias("preferredRequirements"), F.lit("tea").alias("welfares"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Spark"), F.lit(""), F.lit("SQL"))).alias("techStacks"))
    return adapters.PlatformB().details(raw).select("id", "body")


def career_postings(s, d):
    """Openings of career pages: regions from addresses, home work, widest range, kinds of employment, ids with family and company."""
    place = lambda i: F.element_at(F.array(*map(F.lit, ("서울특별시 강남구 역삼동", "경기도 성남시", "Base Camp", ""))), ((F.col("o_orderkey") + i) % 4 + 1).cast("int"))
    position = lambda i: F.struct(
        F.struct(F.lit("IT").alias("field")).alias("workspaceField"), F.struct(F.col("o_orderpriority").alias("occupation")).alias("workspaceOccupation"), F.struct(F.lit("HQ").alias("location"), place(i).alias("place"), (F.col("o_orderkey") % 6 == 0).alias("workFromHome")).alias("workspacePlace"),
        F.struct((F.col("o_orderkey") % 5 + i).cast("int").alias("careerFrom"), (F.col("o_orderkey") % 5 + 2 * i).cast("int").alias("careerTo")).alias("jobPositionCareer"), F.struct(F.lit("INTERN" if i else "FULL_TIME_WORKER").alias("employmentType")).alias("jobPositionEmployment"))
    item = F.struct(F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderkey")).cast("long").alias("openingId"), F.lit("").alias("title"), F.lit("2001-01-01").alias("openDate"), F.when(F.col("o_orderkey") % 3 == 0, "2001-09-01T10").alias("dueDate"), F.struct(F.array(position(0), position(1)).alias("openingJobPositions")).alias("openingJobPosition"))
    raw = table(s, d, "orders").select(F.lit("acme").alias("company_id"), F.lit("Acme").alias("company"), F.lit("https://acme.example.com/ko/jobs").alias("careers_url"), F.lit("greetinghr").alias("family"), F.col("o_orderkey").alias("seq"), item.alias("item"))
    out = adapters.CareerPages().postings(raw)
    return out.select("id", "title", F.array_join("regions", ",").alias("regions"), F.array_join("employee_types", ",").alias("kinds"), "career_min", "career_max", "deadline", "detail_url")


def rich_text_flatten(s, d):
    """Text leaves of nested bodies, with a line of tags."""
    leaf = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.array(leaf("role")).alias("content")), F.struct(F.array(leaf("text")).alias("content"))).alias("content")))
    tags = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    c = table(s, d, "conversations").filter("text is not null and role is not null")
    return c.select("conv_id", "turn", landed.detail_text(F.lit(""), landed.rich_text(tree), tags).alias("body"))


def embedded_json_pick(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit('so {"x": 1, "y": {"z": 2}, "w": 3} then {"requirements": [], "n": '), F.col("turn").cast("string"), F.lit("} and { left")).alias("answer"))
    picked = landed.embedded_json("answer")
    return c.select("conv_id", "turn", F.get_json_object(picked, "$.n").cast("long").alias("n"))


def health_order(s, d):
    return _placed(health.warnings(health.rollup(B.fetches(s, d))), 50, "source_id").select("place", "source_id", "warning")


def source_badges(s, d):
    p = B.postings(s, d)
    return p.select("id", outputs.badge(F.array("source", F.lit("platform_a")), {"platform_a": "A", "platform_b": "B"}).alias("badge"))


QUERIES = {f.__name__: f for f in (postings_union, landed_postings, landed_sources, career_results, career_openings, reposts, run_matches, run_note, run_cards, run_state, run_counters, run_samples, company_normalize, company_legal, role_names, title_keys, dedup_survivors, ambiguous_keys, text_dedup, exclusions, score_parts, rule_score, rule_topk, resolve_target, alias_collisions, near_misses, qualify_reason, mode_union, families, collectible_families, adapted_companies, portal_conflicts, research_needed, tier_listing, key_typos, unclassified, official_urls, seen_upsert, seen_retention, not_notified, created_cache, fresh_window, assess_budget, detail_budget, evidence_deferral, body_sources, thin_bodies, deadline_states, requirement_normalize, evidence_narrow, blocker_adoption, match_axis, fit_score, recommend, recommend_why, final_order, note_rank, push_top8, push_overflow, told_marking, seed_marking, dashboard_rank, dashboard_order, dashboard_search, dashboard_kpis, run_stats, source_badges, health_rollup, health_warnings, health_order, health_summary, health_stale, page_extract, event_json, positions_fold, last_value_upsert, platform_b_postings, platform_b_details, career_postings, rich_text_flatten, embedded_json_pick, robots_guard)}
