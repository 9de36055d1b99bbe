"""Landed pages, career pages, reposts, settings, and runs from files to the note."""

import datetime
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graincast import cli
from graincast.operators import dedup, matches, scoring
from graincast.plans import oracle, queries
from graincast.sources import adapters, bridge, cards, careers, collecting, pages
from graincast.sources import state as state_store

DAY = "2026-03-10"


def land(root, source, term, page, body, status=200):
    """An answer as a fetcher lands it."""
    folder = root / f"source={source}" / f"term={pages.escaped(term)}" / f"page={page}" / f"status={status}"
    folder.mkdir(parents=True)
    (folder / "body.json").write_bytes(body if isinstance(body, bytes) else json.dumps(body).encode())


def a_page(*items, **more):
    return {"data": {"content": list(items), **more}}


def item(i, **more):
    return {"id": i, "title": f"Engineer {i}", "company": {"name": "Other"}, "depthTwos": ["backend"], "regions": ["Seoul"], "employeeTypes": ["정규직"], "careerMin": 3, "careerMax": 7, **more}


def test_ranges_of_pages_and_broken_ones(spark, tmp_path):
    for n in range(5):
        land(tmp_path, "a", "x y/z", n, a_page(item(n)))
    land(tmp_path, "a", "x y/z", 7, b"\xff\xfe")
    land(tmp_path, "a", "x y/z", 8, {}, 500)
    land(tmp_path, "a", "x y/z", 8, {}, 200)
    (tmp_path / "source=a" / "term=x y%2Fz" / "page=9").mkdir()
    (tmp_path / "source=a" / "term=x y%2Fz" / "page=0" / "status=200" / "_SUCCESS").write_text("")
    wanted = [("a", "x y/z", 10), ("a", "none", 10)]
    reader = pages.PageReader(str(tmp_path), [list(w) for w in wanted], 3)
    assert [(p.term, p.first, p.after) for p in reader.partitions()] == [("x y/z", 0, 3), ("x y/z", 3, 6), ("x y/z", 6, 9), ("x y/z", 9, 10), ("none", 0, 3), ("none", 3, 6), ("none", 6, 9), ("none", 9, 10)]
    for path in (str(tmp_path), f"file:{tmp_path}"):
        got = {(r["term"], r["page"]): r for r in pages.read_pages(spark, path, wanted, 3).collect()}
        assert set(got) == {*(("x y/z", n) for n in (0, 1, 2, 3, 4, 7, 8, 9)), ("none", 0)}
        assert json.loads(got["x y/z", 2]["body"]) == a_page(item(2)) and got["x y/z", 2]["status"] == 200
        assert [got["x y/z", n]["error"] is None for n in (0, 7, 8, 9)] == [True, False, False, False] and got["none", 0]["error"] == pages.NOT_LANDED


WALKS = [
    # pages as (status, body or None for a broken one), ids found, pages read, error
    ([(200, a_page(item(1))), (200, a_page(item(2))), (200, a_page())], ["1", "2"], 3, None),
    ([(200, a_page(item(1), last=True)), (200, a_page(item(2)))], ["1"], 1, None),
    ([(200, a_page(item(1))), (503, a_page(item(9))), (200, a_page(item(2)))], ["1"], 2, "HTTP 503"),
    ([(404, {})], [], 1, "HTTP 404"),
    ([(200, b"{"), (200, a_page(item(2)))], [], 1, "no JSON object"),
    ([(200, b"[" * 5000)], [], 1, "no JSON object"),
    ([(200, {"data": {"content": "x"}})], [], 1, None),
    ([(200, {"data": {"content": [None, 3, {"title": "no id"}, {"id": "k", "careerMin": "x", "regions": ["r", None, ""]}]}})], ["k"], 1, None),
]


@pytest.mark.parametrize("given,ids,n_pages,error", WALKS)
def test_walks_end_where_a_fetcher_would(spark, tmp_path, given, ids, n_pages, error):
    for n, (status, body) in enumerate(given):
        land(tmp_path, "platform_a", "-", n, body, status)
    got = collecting.from_pages(spark, str(tmp_path), {"search": {"max_pages": 5}})
    assert sorted(r["id"] for r in got.postings.collect()) == ids
    row = got.sources.first()
    assert (row["n_pages"], row["ok"], row["error"], row["jobs"]) == (n_pages, error is None or bool(ids), error if not ids else None, len(ids))


def test_a_gap_ends_a_walk_and_pages_beyond_the_settings_are_not_read(spark, tmp_path):
    for n in (0, 1, 3):
        land(tmp_path, "platform_a", "-", n, a_page(item(n)))
    ids = lambda most: sorted(r["id"] for r in collecting.from_pages(spark, str(tmp_path), {"search": {"max_pages": most}}).postings.collect())
    assert ids(9) == ["0", "1"] and ids(1) == ["0"]


def test_searches_without_a_limit_read_all_pages_that_landed(spark, tmp_path):
    for n in range(7):
        land(tmp_path, "platform_a", "-", n, a_page(item(n)))
    got = collecting.from_pages(spark, str(tmp_path), {"search": {"max_pages": None}})
    assert sorted(r["id"] for r in got.postings.collect()) == [str(n) for n in range(7)]
    assert [(r["n_pages"], r["jobs"]) for r in got.sources.collect()] == [(7, 7)]
    reader = pages.PageReader(str(tmp_path), [["platform_a", "-", None], ["platform_a", "none", None]], 3)
    assert [(p.term, p.first, p.after) for p in reader.partitions()] == [("-", 0, 3), ("-", 3, 6), ("-", 6, 7), ("none", 0, 1)]


def test_orders_beyond_a_thousand_pages_are_listed(spark, tmp_path):
    for n in (0, 1, 1023, 1024, 1030):
        land(tmp_path, "platform_a", "1-URGENT", n, a_page(item(n)))
    found = [(s["type"], t, s["most"]) for s in pages.searches(bridge.SEARCHES) if s["type"] == "platform_a" for t in s["terms"]]
    assert [r["page"] for r in pages.read_pages(spark, str(tmp_path), found).filter("term = '1-URGENT'").orderBy("page").collect()] == [0, 1, 1023, 1024, 1030]


def test_landed_sources_equal_their_sql_beyond_a_thousand_pages(spark, tmp_path):
    d, day = str(tmp_path), datetime.datetime(1998, 1, 2)
    rows = [(bridge.PAGE_KEYS * n + 10, 1, "F", "1-URGENT", day) for n in range(1030)]  # each is listed under 2-HIGH again
    rows += [(k, 1, "F", term, day) for k, term in enumerate(("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))] + [(k, 1, "O", "5-LOW", day) for k in (4, 5, 6)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, "c", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    with duckdb.connect() as db:
        for name in ("orders", "customer"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
        want = db.sql(oracle.SQL["landed_sources"]).fetchall()
    got = [tuple(r) for r in queries.landed_sources(spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(r[5] for r in got) > 1024


def test_sources_outlive_each_other(spark, tmp_path):
    land(tmp_path, "platform_a", "k1", 0, a_page(item(1, title="first"), item(2)))
    land(tmp_path, "platform_a", "k2", 0, a_page(item(3), item(1, title="last")))
    land(tmp_path, "platform_b", "7", 0, {"result": {"positions": [{"id": 1, "title": "", "companyName": None, "alwaysOpen": True}, {"id": 5, "closedAt": "2026-04-01T10"}], "emptyPosition": True}})
    settings = {"sources": [{"type": "zzz"}, {"type": "platform", "search": {"keywords": ["k1", "k2", "k3"]}}, {"type": "platform_b", "search": {"job_categories": [7]}}, {"type": "platform_b", "enabled": False}], "filter": {"primary_depth_twos": ["backend"]}}
    got = collecting.from_pages(spark, str(tmp_path), settings)
    rows = got.postings.orderBy("seq").collect()
    assert [(r["source"], r["id"], r["title"], r["company"]) for r in rows] == [("platform_a", "1", "last", "Other"), ("platform_a", "2", "Engineer 2", "Other"), ("platform_a", "3", "Engineer 3", "Other"), ("platform_b", "1", "?", "?"), ("platform_b", "5", "?", "?")]
    assert (rows[3]["deadline"], rows[4]["deadline"], rows[4]["synthetic"], rows[4]["depth_twos"]) == ("상시", "2026-04-01", True, ["backend"])
    assert [(r["source"], r["ok"], r["error"], r["n_walks"]) for r in got.sources.orderBy("nth").collect()] == [("zzz", False, "unknown source", 0), ("platform_a", True, None, 3), ("platform_b", True, None, 1)]
    nothing = collecting.from_pages(spark, str(tmp_path), {"sources": [{"type": "zzz"}]})
    assert nothing.postings.count() == 0 and nothing.sources.count() == 1


def test_searches_of_settings():
    assert [s["type"] for s in pages.searches({"sources": [{"type": "x"}, {"type": "y", "enabled": False}, {}]})] == ["x", "platform_a"]
    one = pages.searches({"search": {"keywords": [1], "pages_per_keyword": 3}})
    assert [(s["type"], s["terms"], s["most"]) for s in one] == [("platform_a", ["1"], 3)] and pages.searches({})[0]["terms"] == [pages.ANY_TERM]


def career_page(data, key=("openings",)):
    state = {"props": {"pageProps": {"dehydratedState": {"queries": [{"queryKey": ["me"]}, 5, {"queryKey": list(key), "state": {"data": data}}]}}}}
    return f'<p><script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script>'


COMPANY = "id string, name string, enabled boolean, family string, status string, careers_url string"


def test_a_broken_page_loses_only_its_company(spark):
    opening = {"openingId": 7, "title": "Dev", "dueDate": None, "openingJobPosition": {"openingJobPositions": [{"workspacePlace": {"place": "서울특별시 강남구 역삼동", "workFromHome": True}, "jobPositionCareer": {"careerFrom": 3, "careerTo": 5}}, {"jobPositionCareer": {"careerFrom": 1, "careerTo": 9}, "jobPositionEmployment": {"employmentType": "INTERN"}}]}}
    deep = '<script id="__NEXT_DATA__">' + "[" * 100_000 + "</script>"
    given = {"good": career_page([opening, {"title": "no id"}, 4]), "empty": career_page([]), "deep": deep, "list": career_page({}), "other": career_page([], ("me2",)), "none": "<p>", "broken": '<script id="__NEXT_DATA__">{</script>', "odd": '<script id="__NEXT_DATA__">[1]</script>'}
    names = [*given, "missing", "gone", "nourl", "apply", "off", "unread"]
    url = {"nourl": None, "apply": "https://c.example.com/o/1/apply"}
    companies = spark.createDataFrame([(n, n.upper(), n != "off", "greetinghr" if n != "unread" else "zzz", "adapter_candidate", url.get(n, f"https://{n}.example.com/ko/jobs")) for n in names], COMPANY)
    rows = [(n, 2, 200, "u", h, None) for n, h in given.items()] + [("good", 1, 500, "u", None, "before"), ("gone", 1, 410, "u", None, None), ("apply", 1, 200, "u", career_page([opening]), None), ("stranger", 1, 200, "u", career_page([opening]), None)]
    landed_pages = spark.createDataFrame(rows, "company_id string, at int, status int, final_url string, html string, failure string")
    found = careers.fetched(companies, landed_pages)
    got = {r["company_id"]: (r["ok"], r["jobs"], r["error"]) for r in careers.results(found).collect()}
    assert got == {
        "good": (True, 1, None), "empty": (True, 0, None), "deep": (False, None, "broken data"), "list": (False, None, "openings aren't a list"), "other": (False, None, "no openings query"), "none": (False, None, "no embedded data"),
        "broken": (False, None, "broken data"), "odd": (False, None, "no openings query"), "missing": (False, None, "no page landed"), "gone": (False, None, "HTTP 410"), "nourl": (False, None, "no careers_url"), "apply": (False, None, "robots rules forbid the address"),
    }
    row = careers.postings(found, companies).collect()
    assert [(r["id"], r["company"], r["canonical"], r["regions"], r["career_min"], r["career_max"], r["employee_types"], r["deadline"], r["detail_url"]) for r in row] == [("greetinghr:good:7", "GOOD", "good", ["서울특별시 강남구", "재택"], 1, 9, ["인턴"], "상시", "https://good.example.com/ko/o/7")]
    assert careers.fetched(companies.limit(0), landed_pages).count() == 0


POSTING = "id string, seq long, source string, title string, company string, canonical string, depth_ones array<string>, depth_twos array<string>, synthetic boolean, regions array<string>, employee_types array<string>, career_min int, career_max int, created string, deadline string, detail_url string"


def post(i, seq, source="a", title="Dev (X)", company="Acme Inc", canonical="", deadline=None, url=None, lo=3, regions=("r1", "r2")):
    return (i, seq, source, title, company, canonical, ["d"], ["backend"], False, list(regions), [], lo, 7, None, deadline, url)


def test_reposts_keep_the_first_row_and_fill_it(spark):
    rows = [post("b", 2, "b", deadline="2026-05-01", url=""), post("a", 1, deadline=""), post("c", 3, "a", deadline="2026-06-01", url="https://c", regions=("r2", "r1")), post("d", 4, title="dev x!"), post("e", 5, title="Dev (Y)"), post("f", 6, lo=4), post("g", 7, company=None, title=None), post("h", 8, company="other", canonical="acmeinc")]
    df = spark.createDataFrame(rows, POSTING).withColumn("key", F.lit("own"))
    got = {r["id"]: r for r in dedup.merged(df).collect()}
    assert set(got) == {"a", "e", "f", "g"} and got["a"]["n_merged"] == 5 and got["a"]["sources"] == ["a", "b"]
    assert (got["a"]["deadline"], got["a"]["detail_url"], got["a"]["title"], got["a"]["key"], got["a"]["regions"]) == ("2026-05-01", "https://c", "Dev (X)", "own", ["r1", "r2"])
    assert dedup.merged(df.limit(0)).count() == 0


def test_rules_of_settings():
    rules = scoring.Rules.of({"profile": {"career_years": 6, "tech_primary": ["spark"]}, "filter": {"primary_depth_twos": ["x"], "exclude_companies": ["Y"]}, "scoring": {"weights": {"tech_title": 50}, "rule_threshold": 10, "career_tolerance_over": 0}})
    assert (rules.career_years, rules.tech_primary, rules.primary, rules.excluded_companies, rules.weights["tech"], rules.weights["role"], rules.threshold, rules.tolerance) == (6, ["spark"], ["x"], ["Y"], 50.0, 35.0, 10, 0)
    assert scoring.Rules.of({}) == scoring.Rules() and scoring.Rules().primary == []
    with pytest.raises(ValueError, match="weights"):
        scoring.Rules.of({"scoring": {"weights": dict.fromkeys(("role", "career", "tech_title", "region", "employment"), 0)}})


def test_env_file_and_profile(tmp_path, monkeypatch):
    monkeypatch.setenv("GRAINCAST_SET", "own")
    monkeypatch.delenv("GRAINCAST_NEW", raising=False)
    (tmp_path / ".env").write_text("# x\nGRAINCAST_SET=file\nGRAINCAST_NEW = 'v=1' \nnothing\n=x\n")
    cli.load_env(str(tmp_path / ".env"))
    assert (os.environ["GRAINCAST_SET"], os.environ["GRAINCAST_NEW"]) == ("own", "v=1")
    cli.load_env(str(tmp_path / "none"))
    monkeypatch.delenv("GRAINCAST_NEW")
    assert cli.profile_text({}, str(tmp_path)) == ""
    (tmp_path / "me.md").write_text("I sort.")
    assert cli.profile_text({"output": {"profile_file": "me.md"}}, str(tmp_path)) == "I sort."


@pytest.fixture
def profile(spark, tmp_path):
    """Settings over landed answers: a job posted by two sources under two names, one of a company with a career page, one near the list."""
    root = tmp_path / "pages"
    land(root, "platform_a", "-", 0, a_page(item(1, title="Spark Engineer", company={"name": "(주)에이스"}), item(2, title="Chef", company={"name": "Acme"}), item(3, title="Spark Dev", company={"name": "Acme Labs"}), item(4, title="Spark Lead", company={"name": "Spam Corp"})))
    land(root, "platform_b", "1", 0, {"result": {"positions": [{"id": 91, "title": "Spark Engineer", "companyName": "Acme", "minCareer": 3, "maxCareer": 7, "locations": ["Seoul"], "closedAt": "2026-04-01"}], "emptyPosition": True}})
    tables = {
        "careers": ([("acme", 1, 200, "u", career_page([{"openingId": 5, "title": "Spark Analyst", "openDate": "2026-03-09"}]), None), ("beta", 1, 500, "u", None, None)], "company_id string, at int, status int, final_url string, html string, failure string"),
        "details": ([("1", "2026-03-09", "body " * 50, "https://y"), ("3", "2026-03-09", "b", ""), ("91", "2026-03-09", "b", "")], "id string, created string, body string, url string"),
        "crawled": ([], "id string, text string"),
        "responses": ([("1", "Here it is: " + json.dumps({"requirements": [{"requirement": f"r{i}", "importance": "REQUIRED", "match": "FULL", "evidence": "done"} for i in range(6)]}) + " {")], "id string, response string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    listed = [{"id": "acme", "name": "Acme", "aliases": ["(주)에이스"], "platform_family": "greetinghr", "collection_status": "adapter_candidate", "careers_url": "https://acme.example.com/ko/jobs", "roles": {"include": ["spark"]}}, {"id": "beta", "name": "Beta", "platform_family": "greetinghr", "collection_status": "adapter_candidate", "careers_url": "https://beta.example.com"}]
    (tmp_path / "companies.json").write_text(json.dumps({"companies": listed}))
    settings = {
        "landed": {n: n for n in ("pages", *tables)}, "targets": {"file": "companies.json"}, "sources": [{"type": "platform"}, {"type": "platform_b", "search": {"job_categories": [1]}}, {"type": "zzz"}], "search": {"new_within_days": 3},
        "filter": {"primary_depth_twos": ["backend"], "regions_preferred": ["Seoul"], "exclude_companies": ["spam"]}, "profile": {"career_years": 4, "tech_primary": ["spark"]}, "output": {"seen_retention_days": 30}, "state_buckets": 2,
    }
    (tmp_path / "config.json").write_text(json.dumps(settings))
    return tmp_path, settings


def test_a_run_from_landed_files_to_the_note(spark, profile, capsys):
    root, settings = profile
    config = ["--config", str(root / "config.json"), "--official"]
    old = spark.createDataFrame([("old", "2026-01-01", None, True, None), ("kept", "2026-03-01", None, True, None)], cli.STATE)
    state_store.save(old, str(root / "state"), "0")
    assert cli.main(config, spark, DAY) == 0
    told = capsys.readouterr().out
    for line in ("! source zzz: unknown source", "! greetinghr:beta: HTTP 500", "left out by its roles: Acme / Chef", "of an excluded company: Spam Corp / Spark Lead", "near the watch-list, not on it: Acme Labs ~ acme"):
        assert line in told
    state = {r["id"]: r for r in state_store.load(spark, str(root / "state"), cli.STATE).collect()}
    # the repost of platform B is the first one's; what is old went, excluded companies aren't kept
    assert set(state) == {"1", "2", "3", "greetinghr:acme:5", "kept"}
    assert state["1"]["notified"] and state["1"]["card"]["recommendation"] == "STRONG_APPLY" and state["1"]["card"]["deadline"] == "2026-04-01" and state["1"]["card"]["target"]
    note = (root / "matches" / f"{DAY}.md").read_text()
    assert note.count("Spark Engineer") >= 1 and "target_role_dropped 1" in note and "company_excluded 1" in note and "merged 1" in note
    assert cli.main(config, spark, "2026-03-11") == 0  # the second failure on end is a warning
    assert "matched: 0" in (root / "matches" / "2026-03-11.md").read_text()
    capsys.readouterr()
    assert cli.main([*config, "--source-health"], spark, "2026-03-11") == 0
    health = capsys.readouterr().out
    assert "greetinghr:beta: failures 2" in health and "! greetinghr:beta: failed" in health and "greetinghr:acme: failures 0, jobs 1" in health


def test_settings_change_a_run(spark, profile, capsys):
    root, settings = profile
    config = ["--config", str(root / "config.json"), "--dry-run", "--no-llm", "--mode", "discovery"]
    assert cli.main(config, spark, DAY) == 0 and "Spark Dev" in capsys.readouterr().out
    settings["filter"]["exclude_title_keywords"] = ["dev"]
    (root / "config.json").write_text(json.dumps(settings))
    assert cli.main(config, spark, DAY) == 0 and "| Spark Dev" not in capsys.readouterr().out


def test_counters_and_samples(spark):
    rows = [post(f"p{i}", i, title=f"T{i}", company="Bad Co" if i < 9 else "Good", lo=i) for i in range(20)]
    companies = spark.createDataFrame([("g", "good", [], True, "A", ["zzz"], [])], "id string, name_key string, alias_keys array<string>, enabled boolean, tier string, roles_include array<string>, roles_exclude array<string>")
    none = lambda schema: spark.createDataFrame([], schema)
    run = matches.Run(as_of=DAY, rules=scoring.Rules(excluded_companies=["bad"]))
    found = matches.run_all(spark.createDataFrame(rows, POSTING), companies, none(cli.STATE), none("id string, created string, body string, url string"), none("id string, text string"), none("id string, response string"), run)
    assert (found.counters["scanned"], found.counters["company_excluded"], found.counters["target_role_dropped"], found.counters["rule_pass"], found.counters["fresh"], found.counters["deferred"]) == (20, 9, 11, 0, 0, 0)
    got = [(r["kind"], r["name"]) for r in found.samples.orderBy("kind", "at").collect()]
    assert got == [("excluded", f"Bad Co / T{i}") for i in range(5)] + [("role", f"Acme Inc / T{i}".replace("Acme Inc", "Good")) for i in range(9, 17)]
    assert found.matches.count() == 0 and found.state.count() == 11
    empty = matches.run_all(none(POSTING), None, none(cli.STATE), none("id string, created string, body string, url string"), none("id string, text string"), none("id string, response string"), run)
    assert empty.counters["scanned"] == 0 and empty.matches.count() == 0 and empty.samples.count() == 0


def test_a_dashboard_is_written_by_tasks_and_seen_at_once(spark, tmp_path):
    path = tmp_path / "d"
    rows = lambda n: spark.range(n).select(F.col("id"), F.col("id").cast("double").alias("score"), (F.col("id") % 2 == 0).alias("hot"), F.lit(False).alias("urgent"), F.lit("</script> x").alias("title"), F.lit("c").alias("company")).repartition(5).orderBy(F.desc("score"))

    def shown():
        page = (path / "index.html").read_text()
        files = json.loads(page.split("files=")[1].split(";")[0])
        return page, files, [r["id"] for f in files for r in json.loads((path / f).read_text().removeprefix("rows.push(...").removesuffix(")"))]

    cards.write(spark, rows(1000), str(path), "N <x>", DAY, 100)
    page, files, ids = shown()
    assert ids == list(range(999, -1, -1)) and len(files) >= 10 and f"{DAY} · 1000 · 🔥 500 · ⏰ 0" in page and "N &lt;x&gt;" in page
    failing = rows(200).withColumn("title", F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="stop"):
        cards.write(spark, failing, f"file://{path}", "N", DAY, 10)
    assert shown() == (page, files, ids)  # a run that fails leaves the last dashboard
    cards.write(spark, rows(3), f"file://{path}", "", DAY)
    assert shown()[2] == [2, 1, 0] and len([f for f in os.listdir(path) if f.startswith("cards-")]) == 1 and not [f for f in os.listdir(path) if f.startswith(".draft")]
    cards.write(spark, rows(0), str(path), "", DAY)
    assert shown()[1:] == ([], [])


def test_fetching_is_refused_by_path(spark):
    urls = {"https://j.example.com/o/12/apply": True, "https://j.example.com/ko/o/1/apply?x=1": True, "https://j.example.com/m/x": True, "https://j.example.com/ko/apply": False, "https://j.example.com/en/a/1": True, "https://j.example.com/x/o/1/apply": False, "https://j.example.com": False}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", adapters.forbidden(F.col("u")).alias("no"))
    assert {r["u"]: r["no"] for r in got.collect()} == urls
