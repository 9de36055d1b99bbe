"""Rule scores of postings, all as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.functions.terms import count_terms
from graincast.functions.text import contains_any, plain_company, squeeze


#: What a regular job is called, and what the weights' names stand for in settings. Fixed values.
REGULAR = "정규"
WEIGHTS = {"role": 35.0, "career": 25.0, "tech": 20.0, "region": 10.0, "employment": 10.0}
SETTINGS_WEIGHT = {"tech": "tech_title"}


@dataclass(frozen=True)
class Rules:
    """What a person looks for; nothing by default."""

    career_years: int = 0
    tolerance: int = 2
    primary: list[str] = field(default_factory=list)
    secondary: list[str] = field(default_factory=list)
    depth_one: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    employment: list[str] = field(default_factory=lambda: [REGULAR])
    tech_primary: list[str] = field(default_factory=list)
    tech_secondary: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    threshold: float = 45.0
    excluded_companies: list[str] = field(default_factory=list)
    excluded_titles: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, settings: dict) -> Rules:
        """From a profile's ``filter``, ``profile`` and ``scoring``; what isn't set keeps its default."""
        places = {
            "career_years": ("profile", "career_years"), "tech_primary": ("profile", "tech_primary"), "tech_secondary": ("profile", "tech_secondary"),
            "primary": ("filter", "primary_depth_twos"), "secondary": ("filter", "secondary_depth_twos"), "depth_one": ("filter", "target_depth_ones"), "regions": ("filter", "regions_preferred"),
            "excluded_companies": ("filter", "exclude_companies"), "excluded_titles": ("filter", "exclude_title_keywords"), "tolerance": ("scoring", "career_tolerance_over"), "threshold": ("scoring", "rule_threshold"),
        }
        given = {name: (settings.get(block) or {}).get(key) for name, (block, key) in places.items()}
        weights = (settings.get("scoring") or {}).get("weights") or {}
        own = {k: float(weights.get(SETTINGS_WEIGHT.get(k, k), w)) for k, w in WEIGHTS.items()}
        if sum(own.values()) <= 0:
            raise ValueError("scoring.weights: the weights' sum must be above 0")
        return cls(weights=own, **{k: v for k, v in given.items() if v is not None})


def _strings(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def score_role(r: Rules) -> Column:
    return F.when(F.arrays_overlap("depth_twos", _strings(r.primary)), 1.0).when(F.arrays_overlap("depth_twos", _strings(r.secondary)), 0.6).when(F.arrays_overlap("depth_ones", _strings(r.depth_one)), 0.35).otherwise(0.0)


def score_career(r: Rules, lo: str = "career_min", hi: str = "career_max") -> Column:
    low, high, years = F.coalesce(F.col(lo), F.lit(0)), F.coalesce(F.col(hi), F.lit(100)), F.lit(r.career_years)
    gap = low - years
    under = F.when(gap <= r.tolerance, F.greatest(F.lit(0.3), F.lit(1.0) - F.lit(0.35) * gap)).otherwise(F.lit(0.1))
    return F.when(F.col(lo).isNull() & F.col(hi).isNull(), 0.7).when((years >= low) & (years <= high), 1.0).when(years < low, under).when(high >= 2, 0.5).otherwise(0.3)


def score_region(r: Rules) -> Column:
    # terms have no line end, so a term in the joined regions is in one of them; an automaton can't stand within a lambda
    return F.when(F.size("regions") == 0, 0.8).when(contains_any(F.array_join("regions", "\n"), [x for x in r.regions if "\n" not in x]), 1.0).otherwise(0.3)


def score_employment(r: Rules) -> Column:
    return F.when(F.exists("employee_types", lambda x: contains_any(x, r.employment)), 1.0).when(F.size("employee_types") == 0, 0.7).otherwise(0.4)


def score_tech(r: Rules) -> Column:
    title = F.lower("title")
    return F.least(F.lit(1.0), F.lit(0.5) * count_terms(title, r.tech_primary) + F.lit(0.25) * count_terms(title, r.tech_secondary))


def company_excluded(r: Rules, name: str = "company") -> Column:
    """Any excluded name is a part of the company's; empty names in the list are skipped."""
    return contains_any(plain_company(F.col(name)), [x for x in ("".join(c for c in p if c.isalnum()).lower() for p in r.excluded_companies if p)])


def title_excluded(r: Rules, title: str = "title") -> Column:
    return contains_any(F.lower(title), [t.lower() for t in r.excluded_titles])


def with_rule_score(postings: DataFrame, r: Rules) -> DataFrame:
    """Adds the five parts, ``rule`` (weighted, of all weights, one decimal) and ``qualified``."""
    parts = {"role": score_role(r), "career": score_career(r), "tech": score_tech(r), "region": score_region(r), "employment": score_employment(r)}
    out = postings.select("*", *[c.alias(f"p_{k}") for k, c in parts.items()])
    weighted = sum((F.col(f"p_{k}") * F.lit(r.weights[k]) for k in parts), F.lit(0.0))
    out = out.withColumn("rule", F.round(weighted / F.lit(sum(r.weights.values())) * 100, 1))
    ok = ~company_excluded(r) & ~title_excluded(r) & (F.col("rule") >= r.threshold) & (F.col("p_role") != 0)
    return out.withColumn("qualified", ok)


__all__ = ["Rules", "company_excluded", "score_career", "score_employment", "score_region", "score_role", "score_tech", "squeeze", "title_excluded", "with_rule_score"]
