"""What a run shows: a note, a dashboard, a message. Rows are chosen, ordered and worded in Spark; only what is shown is collected.

A run shows a digest, which the budgets of judging and the note's score bound; the push takes eight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.operators import fit, novelty
from graincast.operators.matches import Run, best_first, eligible, in_note
from graincast.sources import cards

PUSHED, CONSOLE, CAPTION = 8, 12, 1024
#: What axes are called. Fixed values.
AXIS_LABELS = {"required": "필수", "preferred": "우대", "career": "경력", "tech": "기술", "preference": "선호"}


def rank() -> Column:
    """Place of a recommendation, best first; a match without one stands with REVIEW."""
    return F.array_position(F.array(*[F.lit(x) for x in reversed(fit.RANKS)]), F.coalesce("recommendation", F.lit("REVIEW"))).cast("int")


def note_rows(matches: DataFrame, run: Run) -> DataFrame:
    """The note's matches: the watch-list first, then by recommendation, then score."""
    return matches.filter(in_note(run)).orderBy(F.desc("target"), rank(), F.desc("score"), "seq")


def pushed(matches: DataFrame, threshold: float) -> DataFrame:
    """What a message tells: worth telling, or of the watch-list and not SKIP; the watch-list first, then by score."""
    told = ~F.col("deferred") & (eligible(threshold) | (F.col("target") & (F.coalesce("recommendation", F.lit("")) != "SKIP")))
    return matches.filter(told).orderBy(F.desc("target"), F.desc("score"), "seq")


def badge(sources: Column, names: dict[str, str]) -> Column:
    """Names of sources, unknown ones as they are."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    of = (lambda s: F.coalesce(F.try_element_at(known, s), s)) if names else (lambda s: s)
    return F.array_join(F.array_distinct(F.transform(sources, of)), " ")


def axis_summary() -> Column:
    """Axes that are known, in per cent."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(f"x_{k}").isNotNull(), F.concat(F.lit(f"{label} "), F.round(F.col(f"x_{k}") * 100).cast("int").cast("string"))) for k, label in AXIS_LABELS.items()])), " · ")


def _hot(run: Run) -> Column:
    return eligible(run.notify_score)


def note(matches: DataFrame, counters: dict, run: Run, person: str = "") -> str:
    """The note as Markdown: a head, a table, and a section a match."""
    label, days, state = novelty.deadline_state("due", run.as_of)
    soon = F.coalesce((state == "date") & (days <= 3), F.lit(False))
    rows = note_rows(matches, run).select(
        "score", "target", "tier", "company", "title", "url", "career", "region", "depth", "age", "jd_source", "rule", "fit", "verdict", "why", "required_known", "required_total", "demoted",
        F.col("evidence.summary").alias("summary"), F.col("evidence.strengths").alias("good"), F.col("evidence.risks").alias("bad"), F.col("evidence.strategy").alias("strategy"),
        F.transform("blockers", lambda b: b["detail"]).alias("barred"), F.array_sort(F.array_distinct(F.transform("blockers_rejected", lambda b: b["reject"]))).alias("passed"),
        label.alias("due_label"), soon.alias("soon"), F.coalesce(days >= 0, F.lit(False)).alias("ahead"), _hot(run).alias("hot"), axis_summary().alias("axes"),
    ).collect()
    late = matches.filter("deferred").count()
    shown_target = any(r["target"] for r in rows)
    out = ["---", f"date: {run.as_of}", "type: job-match-digest", *([f"person: {person}"] if person else []), f"window_days: {run.window}", f"scanned: {counters.get('scanned', 0)}", f"fresh: {counters.get('fresh', 0)}", f"matched: {len(rows)}"]
    out += [*([f"targets: {sum(r['target'] for r in rows)}"] if shown_target else []), "tags: [job-hunt]", "---", "", f"# {person + ' · ' if person else ''}{run.as_of}", ""]
    out.append("> " + " · ".join(f"{k} {v}" for k, v in counters.items()))
    if late:
        out += [">", f"> {late} not judged yet: the next run judges them."]
    if not rows:
        return "\n".join([*out, "", "_Nothing new above the bounds._"])
    head = ["점수", *(["🎯"] if shown_target else []), "판정", "마감", "회사", "공고", "경력", "지역"]
    out += ["", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows:
        cells = [f"**{r['score']}**{'🔥' if r['hot'] else ''}", *([f"**{r['tier']}**" if r["target"] else ""] if shown_target else []), r["verdict"] or ("-" if r["fit"] is not None else "⚙️ 근거 미확보"), ("⏰" if r["soon"] else "") + r["due_label"], r["company"], f"[{r['title']}]({r['url']})", r["career"], r["region"]]
        out.append("| " + " | ".join(cells) + " |")
    for r in rows:
        out += ["", f"## {'🎯 ' if r['target'] else ''}{r['score']}점{' 🔥' if r['hot'] else ''} · {r['company']} — {r['title']}", "", f"- [{r['url']}]({r['url']}) · {r['jd_source']}", f"- 직무: {r['depth']} | 경력: {r['career']} | 지역: {r['region']}" + (f" | 등록 {r['age']}일 전" if r["age"] is not None else "")]
        out.append(f"- 마감: {r['due_label']}{' ⏰' if r['soon'] and r['ahead'] else ''}")
        out.append(f"- 규칙 {r['rule']} → 적합도 {r['fit']} ({r['axes']}); 필수 {r['required_total']}건 중 {r['required_known']}건 판정, 강등 {r['demoted']}건" if r["fit"] is not None else f"- 규칙 {r['rule']}, 적합도 미산출")
        for name, items in (("판정 사유", r["why"]), ("총평", [r["summary"]] if r["summary"] else []), ("부합", r["good"]), ("리스크", r["bad"]), ("결격", r["barred"]), ("결격 아님", r["passed"]), ("전략", r["strategy"] if r["hot"] else [])):
            if items:
                out.append(f"- {name}: " + " / ".join(items))
    return "\n".join(out)


def dashboard_rows(state: DataFrame, run: Run, keep_days: int = 90) -> DataFrame:
    """Cards of the state within retention, best first, with what the page shows and sorts by."""
    cut = F.date_sub(F.lit(run.as_of).cast("date"), keep_days).cast("string")
    rows = state.filter(F.col("card").isNotNull() & (F.coalesce("first_seen", F.lit("9999")) >= cut)).select("id", "card.*")
    label, days, kind = novelty.deadline_state("deadline", run.as_of)
    order = F.when(kind == "date", days).when(kind == "rolling", 100_000).otherwise(100_001)
    hot = (F.col("score") >= run.notify_score) & (F.coalesce("recommendation", F.lit("")) != "SKIP")
    verdict = F.coalesce("verdict", F.when(F.col("scored"), F.lit("-")).otherwise(F.lit("⚙️ 근거 미확보")))
    rows = rows.select("id", "score", hot.alias("hot"), verdict.alias("verdict"), label.alias("deadline"), kind.alias("dstate"), order.alias("dsort"), F.coalesce(days.between(0, 3), F.lit(False)).alias("urgent"), F.coalesce(days < 0, F.lit(False)).alias("expired"), "company", "title", "url", "career", "region", "one_liner", "target", "tier", "date")
    return rows.orderBy(F.desc("score"), "id")


def searched(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose company or title holds the query, in any case."""
    return rows.filter(F.lower(F.concat("company", "title")).contains(query.strip().lower())) if query.strip() else rows


def dashboard(state: DataFrame, run: Run, path: str, person: str = "", keep_days: int = 90) -> None:
    """Writes the dashboard into the folder ``path``: tasks write its cards, best first, and the driver its page. See ``sources.cards``."""
    cards.write(state.sparkSession, dashboard_rows(state, run, keep_days), path, person, run.as_of)


def caption(matches: DataFrame, run: Run, threshold: float, person: str = "") -> str | None:
    """The message: a head, the first eight and how many more; None if nothing is worth it."""
    told = pushed(matches, threshold)
    total, targets = told.agg(F.count(F.lit(1)), F.count_if("target")).first()
    if not total:
        return None
    lines = [f"🎯 {person + ' · ' if person else ''}{total}건 (≥{threshold:g}점 · 최근 {run.window}일{f' · 🎯{targets}' if targets else ''})"]
    for r in told.select("score", "target", "tier", "company", "title", _hot(run).alias("hot")).limit(PUSHED).collect():
        mark = f"🎯{r['tier']}" if r["target"] else "🔥" if r["hot"] else "•"
        lines.append(f"{mark} {r['score']}점 · {r['company']} — {r['title']}")
    if total > PUSHED:
        lines.append(f"…외 {total - PUSHED}건")
    return "\n".join(lines)[:CAPTION]


def console(matches: DataFrame, run: Run) -> list[str]:
    """The first matches in their own order."""
    rows = best_first(matches).limit(CONSOLE).select("score", "target", "tier", "company", "title", _hot(run).alias("hot")).collect()
    return [f"{'🔥' if r['hot'] else '  '} {r['score']:>5}{' 🎯' + r['tier'] if r['target'] else ''} | {r['company']} | {r['title'][:34]}" for r in rows]
