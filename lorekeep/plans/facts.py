"""Queries over facts: ranking, filters, pages, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.expr import days_between, live, micros_of, seconds_between
from lorekeep.operators import filters, search
from lorekeep.operators.aggregates import top_per_group
from lorekeep.plans.registry import query
from lorekeep.sources.domain import AS_OF_TS, as_of, facts, with_tables
from lorekeep.sources.tables import table
from lorekeep.streaming import markers

AGE = f"date_diff('microsecond', last_reinforced, {AS_OF_TS}) / 86400e6"
DECAYED = f"confidence * exp(-decay_rate * ({AGE}))"
LIVE = "NOT suppressed AND invalid_at IS NULL"


@query(with_tables("facts", f"""SELECT id, subject, predicate, confidence, round({DECAYED}, 6) AS decayed_score
FROM facts WHERE {LIVE}
ORDER BY CASE WHEN tier = 'probationary' THEN 1 ELSE 0 END, {DECAYED} DESC, last_reinforced DESC, id LIMIT 30"""))
def decay_ranked_top(spark, sf_dir):
    """Top 30 live facts by tier, then decayed confidence."""
    return search.decay_ranked(facts(spark, sf_dir), as_of()).select("id", "subject", "predicate", "confidence", F.round("decayed_score", 6).alias("decayed_score"))


@query(with_tables("facts", f"""SELECT id, subject, round({DECAYED} + outcome_bias, 6) AS decayed_score
FROM facts WHERE {LIVE} ORDER BY {DECAYED} + outcome_bias DESC, last_reinforced DESC, id LIMIT 30"""))
def decay_ranked_with_bias(spark, sf_dir):
    """The same without tiers, outcomes' bias added."""
    return search.decay_ranked(facts(spark, sf_dir), as_of(), tiers=False, bias=True).select("id", "subject", F.round("decayed_score", 6).alias("decayed_score"))


@query(with_tables("facts", f"""SELECT id, project_id, subject, predicate, object FROM facts WHERE {LIVE}"""))
def live_facts(spark, sf_dir):
    return filters.live_facts(facts(spark, sf_dir)).select("id", "project_id", "subject", "predicate", "object")


@query(with_tables("facts", f"""SELECT id, predicate, tier FROM facts WHERE {LIVE} AND project_id = 'p3' AND predicate = 'error'"""))
def facts_by_given_parameters(spark, sf_dir):
    """Only the parameters that are given filter: no tier here."""
    return filters.where_given(filters.live_facts(facts(spark, sf_dir)), project_id="p3", predicate="error", tier=None).select("id", "predicate", "tier")


@query(with_tables("facts", """SELECT id, subject, object FROM facts WHERE subject LIKE 'user_1%' AND object ILIKE '%"K": 8%'"""))
def facts_by_prefix_and_part(spark, sf_dir):
    return filters.matching(facts(spark, sf_dir), prefix={"subject": "user_1"}, contains={"object": '"K": 8'}).select("id", "subject", "object")


@query(with_tables("facts", """SELECT id, predicate FROM facts WHERE predicate IN ('click', 'error') AND project_id NOT IN ('p1', 'p2')"""))
def facts_among_lists(spark, sf_dir):
    keep = filters.among("predicate", ["click", "error"]) & filters.not_among("project_id", ["p1", "p2"]) & filters.not_among("subject", [])
    return facts(spark, sf_dir).filter(keep).select("id", "predicate")


@query(with_tables("facts", f"""SELECT id, strftime(last_reinforced, '%Y-%m-%d %H') AS hour FROM facts
WHERE last_reinforced >= {AS_OF_TS} - INTERVAL 150 DAY AND last_reinforced < {AS_OF_TS} - INTERVAL 130 DAY"""))
def facts_within_days(spark, sf_dir):
    x = facts(spark, sf_dir).filter(filters.within_days("last_reinforced", as_of(), 150) & filters.older_than_days("last_reinforced", as_of(), 130))
    return x.select("id", F.date_format("last_reinforced", "yyyy-MM-dd HH").alias("hour"))


@query(with_tables("facts", """SELECT id, CAST(date_diff('microsecond', created_at, last_reinforced) / 1e6 AS DOUBLE) AS seconds FROM facts
WHERE date_diff('microsecond', created_at, last_reinforced) / 1e6 > 86400"""))
def facts_reinforced_after_a_day(spark, sf_dir):
    """Difference of times in seconds, fractions kept."""
    x = facts(spark, sf_dir).withColumn("seconds", seconds_between(F.col("last_reinforced"), F.col("created_at")))
    return x.filter(F.col("seconds") > 86400).select("id", "seconds")


@query(with_tables("facts", f"""SELECT id, subject, predicate, object, pinned FROM facts
WHERE project_id = 'p2' AND suppressed AND suppression_kind = 'superseded' AND last_reinforced < {AS_OF_TS} - INTERVAL 140 DAY"""))
def prune_preview(spark, sf_dir):
    c = filters.prune_criteria("p2", as_of(), suppressed=True, kind="superseded", older_than=140)
    return filters.prune_preview(facts(spark, sf_dir), c)


@query(with_tables("facts", f"""SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM facts
WHERE NOT coalesce(project_id = 'p2' AND suppressed AND suppression_kind = 'superseded' AND last_reinforced < {AS_OF_TS} - INTERVAL 140 DAY AND NOT pinned, false)"""))
def prune_delete(spark, sf_dir):
    c = filters.prune_criteria("p2", as_of(), suppressed=True, kind="superseded", older_than=140)
    return filters.pruned(facts(spark, sf_dir), c).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(with_tables("facts", """SELECT id, subject FROM facts ORDER BY id LIMIT 1000 OFFSET 400"""))
def facts_page(spark, sf_dir):
    """Limit (held to 1000) and offset, by id."""
    return filters.page(facts(spark, sf_dir).select("id", "subject"), ["id"], limit=5000, offset=400)


@query(with_tables("facts", """SELECT id, tier FROM facts WHERE tier IS DISTINCT FROM 'probationary'"""))
def facts_not_probationary(spark, sf_dir):
    """NULL-safe inequality: facts older than tiers count."""
    return facts(spark, sf_dir).filter(~F.col("tier").eqNullSafe("probationary")).select("id", "tier")


@query(with_tables("facts", f"""SELECT id, predicate FROM facts WHERE {LIVE} AND predicate IN ('error', 'purchase', 'signup')
  AND NOT coalesce(reality_check = 'mismatch', false)"""))
def fat_card_input(spark, sf_dir):
    """Live facts of a card's predicates whose state isn't settled."""
    x = facts(spark, sf_dir).filter(live() & F.col("predicate").isin("error", "purchase", "signup") & ~F.coalesce(F.col("reality_check") == "mismatch", F.lit(False)))
    return x.select("id", "predicate")


@query(with_tables("facts", """SELECT id, subject, suppression_kind FROM facts WHERE suppressed AND subject = 'user_1' ORDER BY created_at DESC, id DESC LIMIT 20"""))
def suppressed_history(spark, sf_dir):
    return search.history(facts(spark, sf_dir), "user_1").select("id", "subject", "suppression_kind")


@query(with_tables("facts", f"""SELECT id, subject, place FROM (
  SELECT id, subject, confidence, last_reinforced, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, last_reinforced DESC, id) AS place FROM facts WHERE {LIVE})
WHERE place <= 5 ORDER BY confidence DESC, last_reinforced DESC, id LIMIT 50"""))
def capped_per_subject(spark, sf_dir):
    """At most 5 facts of a subject and 50 in all."""
    order = [F.desc("confidence"), F.desc("last_reinforced"), F.asc("id")]
    return top_per_group(filters.live_facts(facts(spark, sf_dir)), "subject", order, 5, 50).select("id", "subject", F.col("place").cast("long").alias("place"))


@query(with_tables("facts", """SELECT subject, predicate, min(id) AS first_id, min_by(object, id) AS first_object FROM facts
WHERE NOT suppressed AND object <> '{"k": 1}' GROUP BY subject, predicate"""))
def first_that_differs(spark, sf_dir):
    """The first live fact of each key that says something else than given."""
    x = facts(spark, sf_dir).filter(~F.col("suppressed") & (F.col("object") != '{"k": 1}'))
    return x.groupBy("subject", "predicate").agg(F.min("id").alias("first_id"), F.min_by("object", "id").alias("first_object"))


@query(with_tables("facts", f"""SELECT id, round({AGE}, 4) AS days, CASE WHEN tier = 'probationary' THEN '[p] ' ELSE '' END || subject AS label FROM facts
WHERE {LIVE} AND confidence >= 9 AND date_diff('microsecond', created_at, last_reinforced) / 1e6 > 86400"""))
def promotion_candidates(spark, sf_dir):
    from lorekeep.operators.state import promotable

    label = F.concat(F.when(F.col("tier") == "probationary", "[p] ").otherwise(""), "subject")
    return promotable(facts(spark, sf_dir)).select("id", F.round(days_between(as_of(), F.col("last_reinforced")), 4).alias("days"), label.alias("label"))


@query(with_tables("facts", """SELECT subject, max_by(session_id, created_at) AS last_session, max(epoch_us(created_at)) AS last_us FROM facts GROUP BY subject"""))
def latest_session(spark, sf_dir):
    x = facts(spark, sf_dir)
    return x.groupBy("subject").agg(F.max_by("session_id", "created_at").alias("last_session"), F.max(micros_of(F.col("created_at"))).alias("last_us"))


@query("""SELECT o_orderkey AS id, upper(split_part(o_orderpriority, '-', 2)) AS severity FROM orders WHERE o_orderstatus = 'F' AND upper(split_part(o_orderpriority, '-', 2)) = 'HIGH'""")
def findings_by_severity(spark, sf_dir):
    """A listing by status and severity, in any case."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.upper(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("severity"), F.col("o_orderdate").alias("created_at"))
    return filters.findings(o, status="F", severity="high").select("id", "severity")


@query(with_tables("facts", """SELECT * FROM (SELECT 'pinned' AS part, id FROM facts WHERE pinned ORDER BY created_at DESC, id DESC LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'suppressed', id FROM facts WHERE suppressed ORDER BY created_at DESC, id DESC LIMIT 5) UNION ALL SELECT * FROM (SELECT 'error', id FROM facts WHERE predicate = 'error' ORDER BY created_at DESC, id DESC LIMIT 5)"""))
def status_view(spark, sf_dir):
    """The five newest of three kinds."""
    f = facts(spark, sf_dir)
    part = lambda name, where: filters.latest(f, 5, where=where).select(F.lit(name).alias("part"), "id")
    return part("pinned", F.col("pinned")).unionByName(part("suppressed", F.col("suppressed"))).unionByName(part("error", F.col("predicate") == "error"))


@query(with_tables("facts", "SELECT predicate, count(*) AS n, round(avg(value), 6) AS mean FROM facts WHERE pinned GROUP BY predicate"))
def user_sql(spark, sf_dir):
    """The user's own SQL over the store's tables."""
    return filters.raw_sql({"facts": facts(spark, sf_dir)}, "SELECT predicate, count(*) AS n, round(avg(value), 6) AS mean FROM {facts} WHERE pinned GROUP BY predicate")


@query(with_tables("facts", """SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM facts WHERE created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR"""))
def stale_markers(spark, sf_dir):
    m = facts(spark, sf_dir).select("id", F.col("created_at").alias("ts"))
    return filters.stale_markers(m, F.lit("2024-01-20").cast("timestamp_ntz")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(with_tables("facts", """SELECT session, event, opened_us, opened_us + CASE event WHEN 'stale' THEN 86400000000 ELSE 604800000000 END AS at_us
FROM (SELECT session, kind, us AS opened_us, lead(us) OVER (PARTITION BY session ORDER BY us, kind DESC) AS next_us FROM (
  SELECT subject AS session, CASE WHEN id % 3 = 0 THEN 'close' ELSE 'open' END AS kind, epoch_us(created_at) AS us FROM facts)), (VALUES ('stale'), ('prompt')) e(event)
WHERE kind = 'open' AND opened_us + CASE event WHEN 'stale' THEN 86400000000 ELSE 604800000000 END <= epoch_us(TIMESTAMP '2024-06-01 00:00:00')
  AND (next_us IS NULL OR next_us > opened_us + CASE event WHEN 'stale' THEN 86400000000 ELSE 604800000000 END)"""))
def marker_lives(spark, sf_dir):
    """Facts as opened and closed markers of their subjects: which went stale after a day, and which were due for a prompt after a week."""
    rows = facts(spark, sf_dir).select(F.col("subject").alias("session"), F.when(F.pmod("id", F.lit(3)) == 0, "close").otherwise("open").alias("kind"), micros_of(F.col("created_at")).alias("us"))
    return markers.life(rows, micros_of(as_of()))
