import math
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graincast.functions import scan
from graincast.functions import terms as term_list
from graincast.functions.text import contains_any
from graincast.operators import dedup, fit, novelty, registry, scoring
from graincast.plans import oracle, queries
from graincast.sources import landed

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        v = v.item() if hasattr(v, "item") else v
        return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(oracle.SQL[name]).df())


POSTING = "id long, seq long, title string, company string, canonical string, source string, depth_ones array<string>, depth_twos array<string>, regions array<string>, employee_types array<string>, career_min int, career_max int, created string, deadline string"


def posting(i, **kw):
    base = dict(id=i, seq=i, title="Dev", company="Acme", canonical="", source="a", depth_ones=["X"], depth_twos=["BUILDING"], regions=["r"], employee_types=["REGULAR"], career_min=3, career_max=7, created=None, deadline=None) | kw
    return tuple(base.values())


@pytest.mark.parametrize("lo,hi,expected", [(3, 7, 1.0), (None, None, 0.7), (6, 10, 0.3), (9, 15, 0.1), (0, 2, 0.5), (0, 1, 0.3)])
def test_career(spark, lo, hi, expected):
    df = spark.createDataFrame([posting(1, career_min=lo, career_max=hi)], POSTING)
    assert df.select(scoring.score_career(scoring.Rules(career_years=4))).first()[0] == pytest.approx(expected)


def test_dedup_keeps_first_identity_and_fills(spark):
    df = spark.createDataFrame([posting(2, source="b", deadline="2026-01-02"), posting(1, deadline=""), posting(3, career_min=4), posting(4, title="Dev (x)")], POSTING)
    got = {r["id"]: r for r in dedup.survivors(df).collect()}
    assert set(got) == {1, 3, 4} and got[1]["sources"] == "a,b" and got[1]["deadline"] == "2026-01-02"


def test_recommendation_table(spark):
    df = spark.createDataFrame([(95.0, 6, 6, 0, False, False, "STRONG_APPLY"), (85.0, 6, 6, 1, True, False, "APPLY"), (75.0, 6, 6, 0, False, False, "REVIEW"), (65.0, 6, 6, 0, False, False, "ARCHIVE"), (59.0, 6, 6, 0, False, False, "SKIP"), (95.0, 3, 6, 0, False, False, "REVIEW"), (95.0, 6, 8, 0, False, False, "STRONG_APPLY"), (95.0, 6, 6, 2, False, False, "REVIEW"), (95.0, 6, 6, 3, True, False, "SKIP"), (95.0, 6, 6, None, True, False, "STRONG_APPLY"), (None, 0, 0, None, False, True, "SKIP"), (None, 0, 0, None, False, False, None)], "fit double, known int, total int, gap int, senior boolean, blocked boolean, want string")
    from pyspark.sql import functions as F

    out = df.select("want", fit.recommendation(*(F.col(c) for c in ("fit", "known", "total", "gap", "senior", "blocked"))).alias("got")).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_near_misses_both_ways(spark):
    names = spark.createDataFrame([("alphalabs",), ("alphas",), ("xalphax",), ("alpha",), ("al",)], "raw string")
    keys = spark.createDataFrame([("alpha",)], "key string")
    assert {tuple(r) for r in registry.near_misses(names, keys).collect()} == {("alphalabs", "alpha"), ("al", "alpha")}


def test_second_run_tells_nothing_twice(spark):
    seen = spark.createDataFrame([(1, "2026-01-01", True)], "id long, first_seen string, notified boolean")
    listed = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r["id"]: (r["first_seen"], r["notified"]) for r in novelty.upsert(seen, listed, "2026-01-05").collect()}
    assert got == {1: ("2026-01-01", True), 2: ("2026-01-05", False)}


def test_openings(spark):
    page = '<script id="__NEXT_DATA__" type="a">{"props":{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["openings"],"state":{"data":[{"openingId":1,"title":"t","openingJobPosition":{"openingJobPositions":[{"jobPositionCareer":{"careerFrom":3,"careerTo":5}},{"jobPositionCareer":{"careerFrom":7,"careerTo":10}}]}}]}}]}}}}</script>'
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(page,), ("<p>",)], "h string").select(landed.openings(F.col("h")).alias("o"))
    good, none = df.collect()
    assert good["o"]["error"] is None and len(good["o"]["items"]) == 1 and none["o"]["error"] == "no embedded data"
    folded = landed.fold_positions(df.select(F.explode("o.items").alias("item"))).first()
    assert (folded["career_min"], folded["career_max"]) == (3, 10)


def test_embedded_json_and_rich_text():
    assert scan.best_object('x {"a":1,"b":2} {"requirements":[]} {') == '{"requirements":[]}'
    assert scan.best_object("none") is None
    assert landed.flatten_text({"type": "doc", "content": [{"type": "text", "text": "a"}, {"content": [{"type": "text", "text": "b"}]}]}) == "a b"


def test_long_lists_of_terms_equal_short_ones(spark):
    rng = random.Random(6)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    texts = [None, "", "zzz"] + ["".join(rng.choice("abcz") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for given in (terms, terms[:40], ["", *terms[:40]]):
        got = df.select("t", term_list.count_terms(F.col("t"), given).alias("n"), contains_any(F.col("t"), given).alias("any")).collect()
        assert [(r["n"], r["any"]) for r in got] == [(0, False) if t is None else (sum(x in t for x in given), any(x in t for x in given)) for t in texts]
    size = lambda n: len(df.select(contains_any(F.col("t"), [f"term{i}" for i in range(n)]))._jdf.queryExecution().optimizedPlan().toString())
    assert size(5000) == size(100)
    rules = [scoring.Rules(regions=[f"r{i}" for i in range(n)] + ["seoul"], tech_primary=[f"t{i}" for i in range(n)] + ["dev"], excluded_companies=[f"x{i}" for i in range(n)] + ["acme"]) for n in (3, 200)]
    rows = spark.createDataFrame([posting(1, regions=["x", "in seoul"]), posting(2, title="t1 ops", company="Other", regions=["sE"]), posting(3, regions=[])], POSTING)
    few, many = ([tuple(r) for r in scoring.with_rule_score(rows, r).select("id", "p_region", "p_tech", "rule", "qualified").collect()] for r in rules)
    assert few == many and [r[1] for r in few] == [1.0, 0.3, 0.8]
