"""Source health, plans, run metrics and processing cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsmill.operators.skew import bucketed_previous


def check_status() -> Column:
    return F.when(~F.col("accessible"), "failed").when(~F.col("selector_works"), "degraded").otherwise("healthy")


def source_health(checks: DataFrame) -> DataFrame:
    """One row per source after all its checks in time order.

    The fold needs no ordered pass: fails in a row are the checks after the last
    healthy one, and the other figures are plain aggregates.
    """
    d = checks.withColumn("status", check_status()).withColumn("_at", F.struct("ts", "event_id"))
    healthy = F.col("status") == "healthy"
    last = d.groupBy("source_id").agg(
        F.max_by("status", "_at").alias("status"), F.max(F.when(healthy, F.col("_at"))).alias("_healthy"), F.max("ts").alias("last_checked_at"),
        F.max(F.when(healthy, F.col("ts"))).alias("last_success_at"), F.avg(F.col("accessible").cast("int")).alias("success_rate"),
        F.avg("response_ms").alias("avg_response_ms"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("_at"))).alias("last_error"),
        F.count("*").alias("n_checks"),
    )
    marks = last.select("source_id", F.col("_healthy").alias("_since"))
    later = d.join(marks, "source_id").filter(F.col("_since").isNull() | (F.col("_at") > F.col("_since")))
    fails = later.groupBy("source_id").agg(F.count("*").alias("consecutive_fails"))
    return last.join(fails, "source_id", "left").withColumn("consecutive_fails", F.coalesce("consecutive_fails", F.lit(0))).drop("_healthy")


def source_plan(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Enabled sources worth fetching, with priority and number of articles, most reliable first."""
    d = sources.filter("enabled").join(health.select(F.col("source_id").alias("id"), "status", "consecutive_fails", "success_rate"), "id", "left")
    fails, rate = F.coalesce("consecutive_fails", F.lit(0)), F.coalesce("success_rate", F.lit(1.0))
    d = d.filter(~((fails >= 5) | ((rate < 0.2) & (fails >= 3))))
    level = F.when(F.coalesce(F.col("status") == "failed", F.lit(False)) | (fails >= 3), 2).when(fails >= 1, 1).otherwise(0)
    amount = F.when(fails > 0, 20).when(level == 2, 10).otherwise(50)
    d = d.withColumns({"_level": level, "max_articles": amount, "priority": F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), level + 1)})
    return d.orderBy("_level", "id").drop("_level")


def health_transitions(checks: DataFrame) -> DataFrame:
    """Checks at which a source stopped being healthy; a busy source is looked at day by day."""
    d = checks.withColumn("status", check_status())
    d = bucketed_previous(d, "source_id", ["ts", "event_id"], F.to_date("ts"), "status", "previous")
    return d.filter((F.col("previous") == "healthy") & (F.col("status") != "healthy"))


def sources_with_health(sources: DataFrame, health: DataFrame) -> DataFrame:
    d = sources.join(health.select(F.col("source_id").alias("id"), "status", "consecutive_fails"), "id", "left")
    return d.withColumns({"status": F.coalesce("status", F.lit("unknown")), "consecutive_fails": F.coalesce("consecutive_fails", F.lit(0))})


def log_rollup(logs: DataFrame) -> DataFrame:
    return logs.groupBy("source_id").agg(
        F.sum("articles_found").alias("found"), F.sum("articles_new").alias("new"), F.count_if(F.col("status") == "failed").alias("failures"), F.count("*").alias("runs")
    )


def run_metrics(logs: DataFrame) -> DataFrame:
    """Totals over all runs, with the distinct error messages in order."""
    return logs.agg(
        F.sum("articles_found").alias("found"), F.sum("articles_new").alias("new"), F.count_if(F.col("status") == "failed").alias("errors"),
        F.array_join(F.sort_array(F.collect_set("error_message")), "; ").alias("messages"),
    )


def run_messages(logs: DataFrame) -> DataFrame:
    """(message, n, first_at, last_at): a row per error message, however many there are, where ``run_metrics`` joins them into one text."""
    seen = [F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")]
    return logs.filter("error_message is not null").groupBy(F.col("error_message").alias("message")).agg(*seen)


def cycle_stages(reports: DataFrame) -> DataFrame:
    """State of each stage of a cycle: of every field the last value reported."""
    at = F.struct("ts", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return reports.groupBy("cycle_id", "stage").agg(last("total"), last("processed"), last("error"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"))


def latest_cycle(stages: DataFrame) -> DataFrame:
    """Rows of the cycle that was updated last."""
    newest = stages.agg(F.max_by("cycle_id", F.struct("updated_at", "cycle_id"))).scalar()
    return stages.filter(F.col("cycle_id") == newest)


def link_class(status: Column, dns_error: Column) -> Column:
    return F.when(dns_error | status.isin(404, 410), "dead").when(status.between(200, 399), "alive").otherwise("unknown")


def link_audit(news: DataFrame, probes: DataFrame, apply: bool = True) -> DataFrame:
    """Adds ``link`` (dead, alive, unknown) by each article's latest probe; dead ones are rejected if ``apply``."""
    last = probes.groupBy(F.col("news_id").alias("id")).agg(
        F.max_by(F.struct("http_status", "dns_error"), F.struct("ts", "event_id")).alias("_p")
    )
    d = news.join(last, "id", "left")
    d = d.withColumn("link", F.coalesce(link_class(F.col("_p.http_status"), F.col("_p.dns_error")), F.lit("unknown"))).drop("_p")
    return d.withColumn("status", F.when(F.col("link") == "dead", "rejected").otherwise(F.col("status"))) if apply else d


def link_audit_summary(audited: DataFrame) -> DataFrame:
    n = lambda what: F.count_if(F.col("link") == what).alias(what)
    return audited.agg(F.count("*").alias("total"), n("alive"), n("dead"), n("unknown"), F.count_if(F.col("status") == "rejected").alias("rejected"))
