"""A run's stages: which postings are candidates, what body and evidence they have, and what becomes of them.

Network edges are tables: ``details`` (id, created, body, url), ``crawled`` (id, text), ``responses`` (id, response).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graincast.functions.text import normalize_company
from graincast.operators import dedup, evidence, fit, novelty, registry, scoring
from graincast.session import written

MODES = ("discovery", "target", "all")
LEAST_CRAWLED, MOST_BODY = 200, 6000
#: Rows that a report shows of a kind: names near the watch-list's, postings its roles left out, postings of excluded companies.
SAMPLES = {"near": 8, "role": 8, "excluded": 5}


@dataclass(frozen=True)
class Run:
    """Settings of a run."""

    as_of: str
    window: int = 3
    mode: str = "all"
    judge: bool = True
    seed: bool = False
    judge_budget: int = 40
    detail_budget: int = 200
    crawl_budget: int = 15
    crawl: bool = False
    thin_chars: int = 100
    retention: int = 90
    note_score: float = 50.0
    notify_score: float = 60.0
    title_exclude: tuple[str, ...] = ()
    rules: scoring.Rules = field(default_factory=scoring.Rules)
    fit: fit.FitConfig = field(default_factory=fit.FitConfig)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode}: one of {', '.join(MODES)}")


def prepared(postings: DataFrame, companies: DataFrame | None) -> DataFrame:
    """What a run scans: ``company_key``, ``canonical`` where the watch-list knows the name (official postings have it), and one row however often it was posted."""
    keyed = postings.withColumn("company_key", normalize_company(F.col("company")))
    if companies is not None:
        keyed = registry.resolve(keyed, companies, "company_key")
        keyed = keyed.withColumn("canonical", F.coalesce(F.nullif(F.col("canonical"), F.lit("")), F.col("target_id"), F.lit(""))).drop("target_id")
    return dedup.merged(keyed)


def marked(postings: DataFrame, companies: DataFrame | None, run: Run, key: str = "company_key") -> DataFrame:
    """All postings with ``excluded`` (company), ``rule``, ``qualified``, ``target_id``, ``tier``, ``reason``, ``target`` and ``picked``: by discovery or the watch-list."""
    listed = scoring.with_rule_score(postings, run.rules).withColumn("excluded", scoring.company_excluded(run.rules))
    want_target = run.mode != "discovery" and companies is not None
    if want_target:
        listed = registry.resolve(listed, companies, key, carry=("tier", "roles_include", "roles_exclude"))
        listed = registry.qualify(listed, list(run.title_exclude))
    else:
        none = F.array().cast("array<string>")
        listed = listed.withColumns({"target_id": F.lit(None).cast("string"), "tier": F.lit(None).cast("string"), "roles_include": none, "roles_exclude": none, "reason": F.lit("not_target")})
    target = F.col("target_id").isNotNull() & F.col("reason").isNull() & ~F.col("excluded")
    picked = (F.col("qualified") if run.mode != "target" else F.lit(False)) | F.col("target")
    return listed.withColumn("target", target).withColumn("picked", picked & ~F.col("excluded"))


def candidates(postings: DataFrame, companies: DataFrame | None, run: Run, key: str = "company_key") -> DataFrame:
    """The picked of ``marked``, one row each."""
    return marked(postings, companies, run, key).filter("picked").drop("picked", "excluded")


def samples(scanned: DataFrame, companies: DataFrame | None) -> DataFrame:
    """``kind, place, name, detail``: the first rows of each kind in SAMPLES, in order of arrival, from a ``marked`` table.

    Near are names that the list's keys begin or end and that aren't on it, with the ids of those companies: aliases may lack.
    """
    shown = F.concat_ws(" / ", F.coalesce("company", F.lit("?")), F.coalesce("title", F.lit("?")))
    first = lambda kind, rows, name: rows.orderBy("seq", name).limit(SAMPLES[kind]).select(F.lit(kind).alias("kind"), "seq", name.alias("name") if isinstance(name, Column) else F.col(name).alias("name"))
    none = F.lit(None).cast("string")
    out = first("excluded", scanned.filter("excluded"), shown).withColumn("detail", none)
    if companies is None:
        return out.withColumnRenamed("seq", "at")
    out = out.unionByName(first("role", scanned.filter("reason = 'role' and not excluded"), shown).withColumn("detail", none))
    names = scanned.filter("target_id is null and not excluded and length(company_key) >= 2").groupBy(F.col("company_key").alias("raw")).agg(F.min("seq").alias("seq"), F.min_by("company", "seq").alias("name"))
    keys = registry.keys(companies)
    near = registry.near_misses(names, keys).join(keys, "key").groupBy("raw").agg(F.array_join(F.array_sort(F.collect_set("company_id")), ",").alias("detail"))
    near = names.join(near, "raw").orderBy("seq", "name").limit(SAMPLES["near"]).select(F.lit("near").alias("kind"), "seq", "name", "detail")
    return out.unionByName(near).withColumnRenamed("seq", "at")


def dated(found: DataFrame, seen: DataFrame, details: DataFrame, run: Run) -> DataFrame:
    """``found`` that nobody was told of, with ``created_at`` and ``age``: the state's date, else, within the budget of successes, the detail's, else first seen.

    A date that can't be read counts as none, so its detail is asked for again, and ``date_unread`` tells of it. Rows without a date in the end go.
    """
    known = seen.select("id", F.col("created_at").alias("cached"), "first_seen", F.coalesce("notified", F.lit(False)).alias("told"))
    rows = found.join(known, "id", "left").filter(~F.coalesce("told", F.lit(False)))
    asked = novelty.age_days(F.col("cached"), run.as_of).isNull()
    got = details.select("id", F.col("created").alias("detail_created"), F.lit(True).alias("has_detail"))
    rows = rows.join(got, "id", "left").withColumn("asks", asked)
    served = novelty.budgeted(rows.filter(F.col("asks") & F.coalesce("has_detail", F.lit(False))).select("id", "rule", "seq"), run.detail_budget).filter("in_budget").select("id", F.lit(True).alias("served"))
    rows = rows.join(served, "id", "left").filter(~F.col("asks") | F.col("served"))
    fallback = F.coalesce(F.nullif(F.col("detail_created"), F.lit("")), "first_seen", F.lit(run.as_of))
    rows = rows.withColumn("created_at", F.when(F.col("asks"), fallback).otherwise(F.col("cached"))).withColumn("date_unread", F.col("asks") & F.col("cached").isNotNull())
    return novelty.fresh(rows, run.as_of, run.window, "created_at").drop("told", "has_detail", "detail_created", "asks", "served", "cached")


def bodies(found: DataFrame, details: DataFrame, crawled: DataFrame, run: Run) -> DataFrame:
    """Adds ``body`` and ``jd_source``: ``crawled`` if a thin body could be crawled (long enough, cut), else ``thin`` or ``platform``."""
    rows = found.join(details.select("id", F.coalesce("body", F.lit("")).alias("base"), F.col("url").alias("redirect")), "id", "left")
    rows = rows.withColumn("base", F.coalesce("base", F.lit(""))).withColumn("thin", F.char_length("base") < run.thin_chars)
    sought = rows.filter("thin and coalesce(redirect, '') <> ''").orderBy(F.desc("rule"), "seq").limit(run.crawl_budget if run.crawl else 0).select("id")
    texts = crawled.filter(F.char_length("text") > LEAST_CRAWLED).join(sought, "id", "left_semi").select("id", F.substring("text", 1, MOST_BODY).alias("fetched"))
    rows = rows.join(texts, "id", "left")
    source = F.when(F.col("fetched").isNotNull(), "crawled").when(F.col("thin"), "thin").otherwise("platform")
    return rows.withColumns({"body": F.coalesce("fetched", "base"), "jd_source": source}).drop("base", "thin", "fetched")


def assessed(found: DataFrame, responses: DataFrame, run: Run) -> DataFrame:
    """Adds evidence and ``deferred``: over the budget, or asked without an answer. If nothing is judged, nothing is deferred."""
    if not run.judge:
        nothing = found.withColumns({"evidence": F.lit(None).cast(evidence.RESPONSE), "failed": F.lit(False), "in_budget": F.lit(False)})
        return nothing.withColumn("deferred", F.lit(False))
    rows = novelty.budgeted(found, run.judge_budget)
    answers = responses.join(rows.filter("in_budget").select("id"), "id", "left_semi")
    rows = evidence.with_response(rows, answers).withColumn("failed", F.col("failed") & F.col("in_budget"))
    return rows.withColumn("deferred", F.col("failed") | ~F.col("in_budget"))


def eligible(threshold: float) -> Column:
    """Worth telling: never if deferred; a recommendation decides if there is one, else the score."""
    rec = F.col("recommendation")
    return ~F.col("deferred") & F.when(rec.isNotNull(), rec.isin("STRONG_APPLY", "APPLY")).otherwise(F.col("score") >= threshold)


def apply_url(detail_url: str = "redirect", own: str = "detail_url") -> Column:
    return F.coalesce(F.nullif(F.col(detail_url), F.lit("")), F.nullif(F.col(own), F.lit("")), F.lit("#"))


def matched(judged: DataFrame, run: Run) -> DataFrame:
    """The wide rows of matches, in no order."""
    rows = fit.evaluate(judged, run.rules.career_years, run.fit)
    bound = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    joined = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("-"))
    verdict = F.create_map(*[F.lit(x) for pair in fit.LABELS.items() for x in pair])
    rows = rows.withColumns({
        "score": F.coalesce("fit", "rule"), "career": F.concat(bound("career_min"), F.lit("~"), bound("career_max"), F.lit("년")), "region": joined("regions"), "depth": joined("depth_twos"),
        "due": F.coalesce(F.nullif(F.col("deadline"), F.lit("")), F.col("evidence.deadline")), "verdict": F.try_element_at(verdict, F.coalesce("recommendation", F.lit(""))),
        "origin": F.when(F.col("target"), "target").otherwise("discovery"), "structured": F.coalesce(F.col("evidence.structured"), F.lit(False)), "demoted": F.coalesce(F.col("evidence.demoted"), F.lit(0)),
    })
    return rows


#: Best first; equal scores keep judged rows before the others, then order of arrival. Outputs that show matches in their own order sort by it.
BEST_FIRST = ("score desc", "in_budget desc", "rule desc", "seq")


def best_first(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*[F.expr(c.split()[0]).desc() if c.endswith("desc") else F.col(c) for c in BEST_FIRST])


def in_note(run: Run) -> Column:
    """What the note shows, and so what counts as told: the two must be one condition."""
    return ~F.col("deferred") & ((F.col("score") >= run.note_score) | F.col("target"))


def cards(matches: DataFrame, run: Run) -> DataFrame:
    """``id, rule, card`` of the matches in the note."""
    card = F.struct("score", "company", "title", "url", "verdict", F.col("due").alias("deadline"), F.col("evidence.summary").alias("one_liner"), "career", "region", F.col("fit").isNotNull().alias("scored"), F.lit(run.as_of).alias("date"), "recommendation", "target", "tier")
    return matches.filter(in_note(run)).select("id", "rule", card.alias("card"))


def next_state(seen: DataFrame, listed: DataFrame, found: DataFrame, told: DataFrame, run: Run) -> DataFrame:
    """The state after a run: new ids, dates found, and who was told (all fresh ones if the run only seeds)."""
    state = novelty.upsert(seen, listed, run.as_of).join(seen.select("id", F.col("created_at").alias("was_created")), "id", "left")
    state = state.join(found.select("id", F.col("created_at").alias("now_created")), "id", "left")
    marks = (found.select("id") if run.seed else told.select("id")).distinct().withColumn("marked", F.lit(True))
    state = state.join(marks, "id", "left")
    return state.select("id", "first_seen", F.coalesce("now_created", "was_created").alias("created_at"), (F.col("notified") | F.coalesce("marked", F.lit(False))).alias("notified"))


@dataclass
class Outcome:
    """What a run found: its ``matches`` and next ``state``, ``counters`` and ``samples`` for reports, and what it ``scanned``."""

    matches: DataFrame
    state: DataFrame
    counters: dict[str, int]
    samples: DataFrame
    scanned: DataFrame


def _counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def run_all(postings: DataFrame, companies: DataFrame | None, seen: DataFrame, details: DataFrame, crawled: DataFrame, responses: DataFrame, run: Run) -> Outcome:
    """A run over collected postings (see ``prepared``); a seeding run has no matches.

    The scan, what is fresh and the matches are each made once, as scratch tables, and their counters are observed while they are
    written: what else a run gives reads these tables.
    """
    every = F.count(F.lit(1))
    scan = marked(prepared(postings, companies), companies, run)
    scan, scan_counts = _counted(
        scan, "scan", scanned=every, merged=F.coalesce(F.sum("n_merged"), F.lit(0)) - every, company_excluded=F.count_if("excluded"), discovery_candidates=F.count_if(F.col("qualified") & ~F.col("excluded")), target_candidates=F.count_if("target"),
        target_role_dropped=F.count_if((F.col("reason") == "role") & ~F.col("excluded")), rule_pass=F.count_if("picked"),
    )
    scan = written(scan, "scan")
    fresh, fresh_counts = _counted(dated(scan.filter("picked").drop("picked", "excluded"), seen, details, run), "fresh", fresh=every, target_fresh=F.count_if("target"), dates_unread=F.count_if("date_unread"))
    fresh = written(fresh, "fresh")
    found = matched(assessed(bodies(fresh, details, crawled, run).withColumn("url", apply_url()), responses, run), run)
    found, match_counts = _counted(
        found, "matches", scored=F.count_if(F.col("evidence").isNotNull()), structured=F.count_if("structured"), demoted=F.coalesce(F.sum("demoted"), F.lit(0)), blocked=F.count_if(F.size("blockers") > 0), enriched=F.count_if(F.col("jd_source") == "crawled"),
        deferred=F.count_if("deferred"), failed=F.count_if("failed"),
    )
    found = written(found if not run.seed else found.limit(0), "matches")
    counters = {**scan_counts.get, **fresh_counts.get, **(match_counts.get if not run.seed else {})}
    state = next_state(seen, scan.filter("not excluded"), fresh, found.filter(in_note(run)), run)
    return Outcome(found, novelty.retain(state, run.as_of, run.retention), counters, samples(scan, companies), scan)
