"""One run from the command line over landed tables: ``python -m graincast.cli --config config.json``.

The settings' ``landed`` names folders that fetching and judging fill beforehand: ``pages`` (answers of the enabled sources' lists as files, see
``sources.pages``) or ``postings`` (a table), ``careers`` (a table of the companies' own pages), and the tables ``details``, ``crawled``, ``responses`` and ``fetches``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graincast import outputs
from graincast.operators import fit, health, matches, registry, scoring
from graincast.sources import careers, collecting, registry_file
from graincast.sources import state as state_store

STATE = "id string, first_seen string, created_at string, notified boolean, card struct<score:double,company:string,title:string,url:string,verdict:string,deadline:string,one_liner:string,career:string,region:string,scored:boolean,date:string,recommendation:string,target:boolean,tier:string>"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graincast")
    p.add_argument("--no-llm", action="store_true", help="don't use evidence: rule scores only")
    p.add_argument("--seed", action="store_true", help="mark what is fresh as told, show nothing")
    p.add_argument("--dry-run", action="store_true", help="write neither note nor state")
    p.add_argument("--config", default="config.json", help="the settings of a profile")
    p.add_argument("--days", type=int, metavar="N", help="days that count as fresh, instead of the settings'")
    p.add_argument("--test-telegram", action="store_true", help="print the message a push would send, and stop")
    p.add_argument("--mode", choices=matches.MODES, default="all", help="what to look for")
    p.add_argument("--list-targets", action="store_true", help="print the watch-list, and stop")
    p.add_argument("--official", action="store_true", help="also take postings of career pages")
    p.add_argument("--source-health", action="store_true", help="print the health of sources, and stop")
    return p


def run_of(settings: dict, args: argparse.Namespace, as_of: str) -> matches.Run:
    llm, enrich, search, out = (settings.get(k) or {} for k in ("llm", "enrich", "search", "output"))
    return matches.Run(
        as_of=as_of, window=args.days if args.days is not None else search.get("new_within_days", 3), mode=args.mode, judge=not args.no_llm, seed=args.seed,
        judge_budget=llm.get("max_calls_per_run", 40), detail_budget=search.get("max_detail_fetches", 200), crawl_budget=enrich.get("max_crawls_per_run", 15), crawl=bool(enrich.get("enabled")), thin_chars=enrich.get("min_chars", 100),
        retention=out.get("seen_retention_days", 90), rules=scoring.Rules.of(settings), note_score=out.get("min_score_in_note", 50), notify_score=(settings.get("scoring") or {}).get("notify_threshold", 60), title_exclude=tuple((settings.get("filter") or {}).get("exclude_title_keywords", ())), fit=fit.FitConfig.of(settings),
    )


FETCHES = "source_id string, at string, seq long, ok boolean, jobs long, error string, http_status int, final_url string, parser_version int"


def load_env(path: str) -> None:
    """Sets what a file of KEY=VALUE lines has and the environment hasn't; no file is no fault. Lines of # are remarks, quotes around a value go."""
    if not os.path.isfile(path):
        return
    with open(path, encoding="utf-8", errors="replace") as f:
        for name, given, value in (line.strip().partition("=") for line in f):
            if given and name.strip() and not name.startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def profile_text(settings: dict, root: str) -> str:
    """What a judge is told of the person; nothing without the file."""
    path = os.path.join(root, (settings.get("output") or {}).get("profile_file") or "profile.md")
    if not os.path.isfile(path):
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read()


def fetch_history(spark: SparkSession, settings: dict, root: str, state_path: str):
    """All fetches known: those that were landed, and those of earlier runs."""
    kept = [f"{state_store.beside(state_path)}/{name}" for name in (sorted(os.listdir(state_store.beside(state_path))) if os.path.isdir(state_store.beside(state_path)) else [])]
    known = [spark.read.schema(FETCHES).parquet(*kept)] if kept else []
    if "fetches" in settings["landed"]:
        known.append(spark.read.parquet(os.path.join(root, settings["landed"]["fetches"])))
    own = ("source_id", "at", "seq", "ok", "jobs")
    rows = [k.select(F.col("source_id").cast("string").alias("source_id"), F.col("at").cast("string").alias("at"), F.col("seq").cast("long").alias("seq"), "ok", F.col("jobs").cast("long").alias("jobs")) for k in known]
    return collecting.united(rows) if rows else spark.createDataFrame([], FETCHES).select(*own)


def collect(spark: SparkSession, settings: dict, root: str, official, companies) -> collecting.Collected:
    """The run's postings: from landed pages, else from the table of postings; the companies' own pages with them if ``official``."""
    at = lambda name: os.path.join(root, settings["landed"][name])
    if "pages" in settings["landed"]:
        got = collecting.from_pages(spark, at("pages"), settings)
    else:
        got = collecting.Collected(spark.read.parquet(at("postings")), spark.createDataFrame([], collecting.RESULT))
        if not official:
            got.postings = got.postings.filter("source <> 'official'")
    if official and "careers" in settings["landed"]:
        got = collecting.with_official(spark, got, companies, spark.read.parquet(at("careers")))
    return got


def warnings_of(got: collecting.Collected, found: matches.Outcome) -> list[str]:
    """What a person should look at: sources and companies that failed, postings that roles left out, names near the watch-list's."""
    lines = [f"! source {r['source']}: {r['error']}" for r in got.sources.filter("not ok").orderBy("nth").collect()]
    if got.companies is not None:
        lines += [f"! {r['source_id']}: {r['error']}" for r in got.companies.filter("not ok").orderBy("source_id").collect()]
    said = {"near": "near the watch-list, not on it", "role": "left out by its roles", "excluded": "of an excluded company"}
    return lines + [f"! {said[r['kind']]}: {r['name']}{' ~ ' + r['detail'] if r['detail'] else ''}" for r in found.samples.orderBy("kind", "at").collect()]


def listing(companies) -> list[str]:
    """The watch-list by tier, and what is wrong or missing in it."""
    lines = [f"{r['tier']} {r['priority']:>3} {r['id']}" for r in registry.tier_listing(companies).collect()]
    lines += [f"collect {r['family']}: {r['ids']}" for r in registry.collectible(companies).collect()]
    lines += [f"research {r['status']}: {r['n']}" for r in registry.research_needed(companies).collect()]
    lines += [f"unknown fields of {r['id']}: {r['unknown']}" for r in registry.key_typos(companies).collect()]
    lines += [f"no status: {r['id']}" for r in registry.unclassified(companies).collect()]
    return lines + [f"shared portal {r['careers_url']}: {r['lacking']}" for r in registry.portal_conflicts(companies).collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, as_of: str | None = None) -> int:
    args = parser().parse_args(argv)
    with open(args.config, encoding="utf-8") as f:
        settings = json.load(f)
    root = os.path.dirname(os.path.abspath(args.config))
    load_env(os.path.join(root, ".env"))
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        companies = registry_file.load(spark, settings, root)
    except registry.RegistryError as e:
        print(f"watch-list: {e}")
        if args.mode == "target" or args.list_targets:
            return 2
        companies = registry_file.table(spark, [])
    if args.list_targets:
        print("\n".join(listing(companies)) or "no companies")
        return 0
    at = lambda name: os.path.join(root, settings["landed"][name])
    state_path = os.path.join(root, settings.get("state", "state"))
    if args.source_health:
        state = health.rollup(fetch_history(spark, settings, root, state_path))
        print("\n".join(f"{r['source_id']}: failures {r['consecutive_failures']}, jobs {r['jobs_seen']}, last success {r['last_success']}" for r in state.orderBy("source_id").collect()))
        print("\n".join(f"! {r['source_id']}: {r['warning']}" for r in health.warnings(state).collect()))
        return 0
    run = run_of(settings, args, as_of or dt.date.today().isoformat())
    seen = state_store.load(spark, state_path, STATE)
    watched = companies if companies.limit(1).count() else None
    official = args.official and watched is not None and args.mode != "discovery"
    if args.official and not official:
        print("! --official: career pages are left out, " + ("discovery doesn't look at them" if watched is not None else "the watch-list is empty"))
    got = collect(spark, settings, root, official, companies)
    found = matches.run_all(got.postings, watched, seen, *(spark.read.parquet(at(n)) for n in ("details", "crawled", "responses")), run)
    shown = found.matches
    if args.test_telegram:
        print(outputs.caption(shown, run, run.notify_score, settings.get("name", "")) or "nothing to tell")
        return 0
    print("\n".join([*outputs.console(shown, run), *warnings_of(got, found)]))
    if args.dry_run:
        return 0
    new = matches.cards(shown, run).select("id", F.col("card").alias("new_card"))
    state = found.state.join(seen.select("id", F.col("card").alias("old_card")), "id", "left").join(new, "id", "left")
    state = state.select("id", "first_seen", "created_at", "notified", F.coalesce("new_card", "old_card").alias("card"))
    now = dt.datetime.now()
    state_store.save(state, state_path, f"{run.as_of}-{now:%H%M%S%f}", int(settings.get("state_buckets", state_store.BUCKETS)))
    if got.companies is not None:
        told = got.companies.select("source_id", F.lit(run.as_of).alias("at"), F.lit(int(now.timestamp() * 1e6)).alias("seq"), "ok", "jobs", "error", "http_status", "final_url", F.lit(careers.PARSER_VERSION).alias("parser_version"))
        told.write.parquet(f"{state_store.beside(state_path)}/{run.as_of}-{now:%H%M%S%f}")
    if not run.seed:
        folder = os.path.join(root, settings.get("output", {}).get("matches_dir", "matches"))
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"{run.as_of}.md"), "w", encoding="utf-8") as f:
            f.write(outputs.note(shown, found.counters, run, settings.get("name", "")))
        outputs.dashboard(state_store.load(spark, state_path, STATE), run, os.path.abspath(folder), settings.get("name", ""))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
