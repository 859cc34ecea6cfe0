"""Deterministic scoring with explained evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsmill import rules
from newsmill.functions import classify as C, text as T


def _criterion(when: Column, name: str, points: int, evidence: Column | str) -> Column:
    ev = F.lit(evidence) if isinstance(evidence, str) else evidence
    return F.when(
        when,
        F.struct(
            F.lit(name).alias("criterion"), F.lit(points).alias("points"), ev.alias("evidence")
        ),
    )


def score_sum(breakdown: Column) -> Column:
    return F.aggregate(breakdown, F.lit(0), lambda acc, b: acc + b["points"])


def is_long_video(seconds: Column) -> Column:
    return F.coalesce(seconds.between(*rules.LONG_VIDEO_SECONDS), F.lit(False))


def score_youtube(
    has_transcript: Column, seconds: Column, dedicated: Column, relevant: Column
) -> dict[str, Column]:
    points = (
        F.lit(45)
        + F.when(dedicated | relevant, 15).otherwise(0)
        + F.lit(10)
        + F.when(is_long_video(seconds), 10).otherwise(0)
    )
    score = F.when(has_transcript, points).otherwise(0)
    return {
        "score": score,
        "eligible": has_transcript & (score > rules.YOUTUBE_ELIGIBLE_ABOVE),
        "reason": F.when(has_transcript, F.lit("scored")).otherwise(F.lit("transcript-unavailable")),
    }


def youtube_relevant(source: Column, title: Column, description: Column) -> Column:
    text = C.article_text(title, description)
    return (
        source.isin(rules.DEDICATED_AI_CHANNELS)
        | T.has_any(text, rules.YOUTUBE_AI_TERMS.lower())
        | T.has_any(text, rules.AI_TERMS)
    )


def youtube_breakdown(source: Column, relevant: Column, seconds: Column, kind: Column, chars: Column) -> Column:
    dedicated = source.isin(rules.DEDICATED_AI_CHANNELS)
    topic = F.when(dedicated, F.lit("dedicated AI channel")).otherwise(F.lit("AI terms in title/description"))
    has = chars.isNotNull()
    return F.array_compact(
        F.array(
            _criterion(has, "youtube-curated-channel", 45, F.concat(F.lit("source="), source)),
            _criterion(has & relevant, "youtube-ai-topic", 15, topic),
            _criterion(
                has, "youtube-transcript-verified", 10, F.concat(kind, F.lit(", "), chars.cast("string"), F.lit(" chars"))
            ),
            _criterion(
                has & is_long_video(seconds),
                "youtube-long-form-priority",
                10,
                F.concat(F.lit("duration="), seconds.cast("string"), F.lit("s (4–45 min)")),
            ),
        )
    )


def open_artifact(repo_found: Column, links: Column) -> Column:
    return repo_found | F.exists(links, lambda link: link.rlike(rules.ARTIFACT_LINK_PATTERN))


def is_science_row(is_science: Column, source: Column) -> Column:
    return F.coalesce(is_science, F.lit(False)) | F.coalesce(source.isin(rules.TIER1_SOURCES + rules.TIER2_SOURCES), F.lit(False))


def article_evidence(title: Column, page_text: Column, repo_description: Column, repo_topics: Column) -> Column:
    topics = F.array_join(F.coalesce(repo_topics, F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", T.or_empty(title), T.or_empty(page_text), T.or_empty(repo_description), topics)


def article_breakdown(now: Column) -> Column:
    """Breakdown of one article that is not a video.

    Works on the columns ``title, section, source, is_science, original_url,
    page_text, links, repo, repo_found, stars, license, repo_created_at,
    repo_description, repo_topics, trending_rank, hn_points, altmetric`` and
    the derived ``evidence`` and ``invention`` columns.
    """
    c = F.col
    links = c("links")
    science = is_science_row(c("is_science"), c("source"))
    source_ev = F.concat(F.lit("source="), c("source"))

    tier1 = c("source").isin(rules.TIER1_SOURCES)
    tier2 = c("source").isin(rules.TIER2_SOURCES) | T.has_any(c("evidence"), rules.CONFERENCE_TERMS)
    arxiv = (
        c("original_url").rlike(r"arxiv\.org")
        | (c("source") == "arxiv")
        | F.exists(links, lambda link: link.rlike(r"arxiv\.org"))
    )
    artifact = open_artifact(c("repo_found"), links)
    code_ev = F.concat(F.lit("openArtifact=true, repo="), F.coalesce(c("repo"), F.lit("n/a")))
    ai_domain = T.has_any(c("evidence_lower"), rules.AI_TERMS) & T.has_any(c("evidence_lower"), rules.SCIENCE_DOMAIN_TERMS)

    rank, stars = c("trending_rank"), c("stars")
    rank_ev = F.concat(F.lit("rank="), rank.cast("string"))
    stars_ev = F.concat(F.lit("stars="), stars.cast("string"))
    new_repo = c("repo_created_at") >= now - F.expr("interval 30 days")
    social = F.greatest(F.coalesce(c("hn_points"), F.lit(0)), F.lit(0))
    social_ev = F.concat(F.lit("best="), social.cast("string"))
    tech = ~science

    return F.array_compact(
        F.array(
            _criterion(
                c("invention") & (c("section") != "invention-tools"),
                "invention-reroute", 0, "science article matches invention terms",
            ),
            _criterion(c("invention"), "invention-tool-bonus", 25, "AI-for-science tool/discovery signals"),
            _criterion(science & tier1, "tier1-source", 45, source_ev),
            _criterion(science & ~tier1 & tier2, "tier2-source", 30, source_ev),
            _criterion(science & arxiv & artifact, "arxiv-with-code", 35, code_ev),
            _criterion(science & arxiv & ~artifact, "arxiv-preprint", 10, "no open artifact found"),
            _criterion(
                science & (c("altmetric") >= 50), "altmetric-buzz", 20,
                F.concat(F.lit("altmetric="), c("altmetric").cast("string")),
            ),
            _criterion(
                science & ai_domain, "ai-domain-intersection", 15,
                "AI + chemistry/materials/biology/medicine/physics",
            ),
            _criterion(tech & (rank <= 10), "github-trending-top10", 40, rank_ev),
            _criterion(tech & (rank > 10) & (rank <= 50), "github-trending-top50", 25, rank_ev),
            _criterion(tech & (stars > 10000), "github-stars-10k", 30, stars_ev),
            _criterion(tech & (stars > 1000) & (stars <= 10000), "github-stars-1k", 20, stars_ev),
            _criterion(
                tech & (stars > 500) & (stars <= 1000) & new_repo, "github-stars-500-new", 25,
                F.concat(stars_ev, F.lit(", age<30d")),
            ),
            _criterion(tech & (social > 100), "social-traction-100", 30, social_ev),
            _criterion(tech & (social > 30) & (social <= 100), "social-traction-30", 15, social_ev),
            _criterion(tech & T.has_any(c("evidence_lower"), rules.TECH_TREND_TERMS), "tech-trend-bonus", 15, "MCP/Agent/RAG detected"),
            _criterion(
                tech & c("license").isin(rules.OPEN_LICENSES), "open-license", 10,
                F.concat(F.lit("license="), c("license")),
            ),
        )
    )


def score_articles(df, now: Column):
    """Add ``invention, section, sphere_tags, breakdown, score`` to scored-signal rows."""
    context = C.invention_context(F.col("title"), F.col("page_text"))
    scored = df.withColumns(
        {
            "evidence": article_evidence(
                F.col("title"), F.col("page_text"), F.col("repo_description"), F.col("repo_topics")
            ),
            "invention_text": F.lower(context),
        }
    ).withColumn("evidence_lower", F.lower("evidence")).withColumn("invention", C.is_invention(F.col("invention_text")))
    scored = scored.withColumn("breakdown", article_breakdown(now))
    reroute = F.col("invention") & (F.col("section") != "invention-tools")
    return scored.withColumns(
        {
            "score": score_sum(F.col("breakdown")),
            "sphere_tags": F.when(reroute, C.sphere_tags(F.col("invention_text"))).otherwise(F.col("sphere_tags")),
            "section": F.when(F.col("invention"), F.lit("invention-tools")).otherwise(F.col("section")),
        }
    ).drop("invention_text", "evidence", "evidence_lower")


def criteria_counts(scored):
    """(criterion, n): how many articles satisfy each criterion that any satisfies.

    An inner explode makes Spark look for empty breakdowns below the projections,
    where the whole evidence text is built and lower-cased anew for each term that
    is looked for.  The outer one doesn't; its rows of empty breakdowns are left out.
    """
    criteria = scored.select(F.explode_outer("breakdown").alias("_b")).select(F.col("_b.criterion").alias("criterion"))
    return criteria.filter(F.col("criterion").isNotNull()).groupBy("criterion").agg(F.count("*").alias("n"))
