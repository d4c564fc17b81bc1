"""Queries of state transitions: what a table looks like after a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.expr import live, micros_of
from lorekeep.operators import state
from lorekeep.plans.registry import query
from lorekeep.sources.domain import AS_OF_TS, as_of, facts, outcomes, turn_usage, with_tables
from lorekeep.sources.tables import table

US = "epoch_us(invalid_at)"
CHANGES = """changes AS (SELECT DISTINCT project_id, subject, predicate, object FROM facts WHERE id % 97 = 3)"""


def _changes(f):
    return f.filter(F.pmod("id", F.lit(97)) == 3).select("project_id", "subject", "predicate", "object").distinct()


def _state(df):
    return df.select("id", "suppressed", micros_of(F.col("invalid_at")).alias("invalid_us"), "suppression_kind")


HIT = """CASE WHEN predicate IN ('signup', 'purchase') THEN EXISTS (SELECT 1 FROM changes c WHERE c.project_id = f.project_id AND c.subject = f.subject AND c.predicate = f.predicate)
  ELSE EXISTS (SELECT 1 FROM changes c WHERE c.project_id = f.project_id AND c.subject = f.subject AND c.predicate = f.predicate AND c.object = f.object) END"""


def _closed_sql(hit: str, kind: str, tables: str = "facts", *more: str) -> str:
    return with_tables(tables, f"""SELECT id, suppressed OR hit AS suppressed, CASE WHEN hit THEN epoch_us({AS_OF_TS}) ELSE {US} END AS invalid_us, CASE WHEN hit THEN '{kind}' ELSE suppression_kind END AS suppression_kind
FROM (SELECT *, {hit} AS hit FROM facts f)""", *more)


@query(_closed_sql(f"NOT suppressed AND NOT pinned AND ({HIT})", "superseded", "facts", CHANGES))
def superseded_facts(spark, sf_dir):
    """1:1 predicates lose every live fact of the key, others only the same object; pinned facts stay."""
    f = facts(spark, sf_dir)
    return _state(state.superseded(f, _changes(f), ["signup", "purchase"], as_of()))


@query(_closed_sql("NOT suppressed AND invalid_at IS NULL AND EXISTS (SELECT 1 FROM changes c WHERE c.project_id = f.project_id AND c.subject = f.subject AND c.predicate = f.predicate)", "retired", "facts", CHANGES))
def retired_facts(spark, sf_dir):
    """By order, pinned facts too."""
    f = facts(spark, sf_dir)
    return _state(state.retired(f, _changes(f), as_of(), with_object=False))


@query(with_tables("facts", f"""SELECT id, CASE WHEN id % 5 = 2 AND NOT suppressed AND invalid_at IS NULL THEN epoch_us({AS_OF_TS}) ELSE epoch_us(last_reinforced) END AS reinforced_us FROM facts"""))
def reinforced_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    ids = f.filter(F.pmod("id", F.lit(5)) == 2).select("id")
    return state.reinforced(f, ids, as_of()).select("id", micros_of(F.col("last_reinforced")).alias("reinforced_us"))


@query(with_tables("facts", f"""SELECT id, suppressed AND NOT hit AS suppressed, CASE WHEN NOT hit THEN {US} END AS invalid_us, CASE WHEN NOT hit THEN suppression_kind END AS suppression_kind
FROM (SELECT *, id % 3 = 0 AND coalesce(suppression_kind = 'downvoted_probation', false) AS hit FROM facts)"""))
def rehabilitated_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    return _state(state.rehabilitated(f, f.filter(F.pmod("id", F.lit(3)) == 0).select("id")))


@query("""SELECT coalesce(o.c_custkey, n.k) AS c_custkey, CASE WHEN n.k IS NOT NULL THEN n.name ELSE c_name END AS c_name, coalesce(n.seg, c_mktsegment) AS c_mktsegment, CASE WHEN o.c_custkey IS NOT NULL THEN c_nationkey ELSE n.nat END AS c_nationkey, o.c_custkey IS NULL AS inserted
FROM customer o FULL JOIN (SELECT c_custkey * 3 AS k, 'new ' || c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'SPECIAL' END AS seg, 7 AS nat FROM customer WHERE c_custkey % 4 = 1) n ON o.c_custkey = n.k""")
def upserted_customers(spark, sf_dir):
    """Replace one column, keep another where the new value is NULL, leave a third, and flag inserts."""
    c = table(spark, sf_dir, "customer")
    new = c.filter(F.pmod("c_custkey", F.lit(4)) == 1).select((F.col("c_custkey") * 3).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, "SPECIAL").alias("c_mktsegment"), F.lit(7).alias("c_nationkey"))
    return state.upserted(c.drop("c_acctbal"), new, ["c_custkey"], keep_when_null=["c_mktsegment"], replace=["c_name"])


@query(with_tables("turn_usage", """SELECT project_id, session_id, max_by(provider, struct_pack(k := turn * 10 + line, p := provider)) AS provider, max(turn * 10 + line) AS k FROM turn_usage GROUP BY ALL"""))
def last_write_wins(spark, sf_dir):
    """The last of many changes of a key, without a window."""
    t = turn_usage(spark, sf_dir).select("project_id", "session_id", "provider", (F.col("turn") * 10 + F.col("line")).alias("k"))
    t = t.withColumn("written", F.struct("k", "provider"))
    return state.last_of(t, ["project_id", "session_id"], "written").drop("written")


@query("""SELECT c_custkey, c_name FROM customer UNION ALL SELECT o_custkey + 1000000, 'from order' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 0) UNION ALL SELECT o_custkey, 'from order' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def inserted_if_absent(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select("o_custkey").distinct()
    new = o.select(F.col("o_custkey").alias("c_custkey")).unionByName(o.filter(F.pmod("o_custkey", F.lit(3)) == 0).select((F.col("o_custkey") + 1_000_000).alias("c_custkey")))
    return state.inserted_only(c, new.withColumn("c_name", F.lit("from order")), ["c_custkey"])


@query("""WITH p AS (SELECT 'p' || (n_nationkey % 4) AS project_id, 'r' || (n_nationkey % 3) AS role, CAST(n_nationkey AS INTEGER) AS version, 'm' || n_nationkey AS model, n_nationkey >= 13 AS active FROM nation),
c AS (SELECT DISTINCT 'p' || (s_suppkey % 6) AS project_id, 'r1' AS role, 'fresh' AS model FROM supplier)
SELECT project_id, role, version, model, active AND NOT EXISTS (SELECT 1 FROM c WHERE c.project_id = p.project_id AND c.role = p.role) AS active FROM p
UNION ALL SELECT c.project_id, c.role, CAST(coalesce((SELECT max(version) FROM p WHERE p.project_id = c.project_id AND p.role = c.role), 0) + 1 AS INTEGER), c.model, true FROM c""")
def versioned_profiles(spark, sf_dir):
    """Old versions are switched off, the next one is active."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    p = n.select(F.concat(F.lit("p"), F.pmod(k, F.lit(4))).alias("project_id"), F.concat(F.lit("r"), F.pmod(k, F.lit(3))).alias("role"), k.cast("int").alias("version"), F.concat(F.lit("m"), k).alias("model"), (k >= 13).alias("active"))
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.pmod("s_suppkey", F.lit(6))).alias("project_id"), F.lit("r1").alias("role"), F.lit("fresh").alias("model")).distinct()
    return state.next_profiles(p, c)


@query(with_tables("facts", """SELECT c.id AS claim_id, CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.project_id = c.project_id AND f.subject = c.subject AND f.predicate = c.predicate AND f.object = c.object AND f.session_id <> c.session_id)
  AND EXISTS (SELECT 1 FROM facts f WHERE f.project_id = c.project_id AND f.subject = c.subject AND f.predicate = c.predicate AND f.object = c.object AND f.session_id <> c.session_id AND (f.reality_check = 'verified' OR f.pinned)) THEN 'consolidated' ELSE 'probationary' END AS tier
FROM facts c WHERE c.id % 3 = 0"""))
def consolidation_gate(spark, sf_dir):
    """Consolidated only on another session's word, one of whose facts is trustworthy."""
    f = facts(spark, sf_dir)
    claims = f.filter(F.pmod("id", F.lit(3)) == 0).select(F.col("id").alias("claim_id"), "session_id", "project_id", "subject", "predicate", "object")
    return state.consolidation(claims, f).select("claim_id", "tier")


@query(with_tables("facts", """SELECT id FROM facts c WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.id % 2 = 0 AND f.project_id = c.project_id AND f.subject = c.subject AND f.predicate = c.predicate AND f.object = c.object AND f.session_id = c.session_id)"""))
def claims_new_to_session(spark, sf_dir):
    f = facts(spark, sf_dir).select("id", "project_id", "subject", "predicate", "object", "session_id")
    return state.new_claims(f.filter(F.pmod("id", F.lit(2)) == 1), f.filter(F.pmod("id", F.lit(2)) == 0)).select("id")


@query(with_tables("facts outcomes", """SELECT id, greatest(-3.0, least(3.0, outcome_bias + CASE WHEN pinned AND d < 0 THEN 0 ELSE d END)) AS outcome_bias FROM (
  SELECT f.id, f.outcome_bias, f.pinned, coalesce(d, 0) AS d FROM facts f LEFT JOIN (SELECT id, CAST(sum(CASE outcome WHEN 'success' THEN 0.5 WHEN 'failure' THEN -0.75 WHEN 'irrelevant' THEN -0.25 ELSE 0 END) AS DOUBLE) AS d
    FROM (SELECT DISTINCT event_id % 300 AS id, age_days // 4 AS s, outcome FROM outcomes) GROUP BY id) u ON u.id = f.id)"""))
def outcome_feedback(spark, sf_dir):
    """Bias by outcomes, once a session, clamped; pinned facts aren't lowered."""
    used = outcomes(spark, sf_dir).select(F.pmod("event_id", F.lit(300)).alias("id"), F.floor(F.col("age_days") / 4).cast("string").alias("session_id"), "outcome")
    return state.biased(facts(spark, sf_dir), used).select("id", "outcome_bias")


@query(with_tables("outcomes", """SELECT event_id, CASE WHEN outcome = 'pending' AND age_days > 14 THEN 'irrelevant' ELSE outcome END AS outcome, CASE WHEN outcome = 'pending' AND age_days > 14 THEN 'timeout_decay' END AS outcome_source FROM outcomes"""))
def pending_timeouts(spark, sf_dir):
    return state.timed_out(outcomes(spark, sf_dir), 14).select("event_id", "outcome", "outcome_source")


@query(with_tables("outcomes", """SELECT kind, CAST(budget AS INTEGER) AS old_budget, CAST(budget + CASE WHEN kind = best THEN moved ELSE 0 END - CASE WHEN kind = worst THEN moved ELSE 0 END AS INTEGER) AS budget FROM (
  SELECT b.kind, b.budget, e.*, CASE WHEN worst IS NOT NULL AND worst <> best THEN greatest(0, least(100, wb - 100)) ELSE 0 END AS moved FROM b,
    (SELECT arg_max(b.kind, struct_pack(r := rate, k := b.kind)) FILTER (total >= 10 AND rate > 0.1) AS worst, arg_max(b.budget, struct_pack(r := rate, k := b.kind)) FILTER (total >= 10 AND rate > 0.1) AS wb,
       arg_min(b.kind, struct_pack(r := rate, k := b.kind)) FILTER (total >= 10) AS best FROM b LEFT JOIN r ON b.kind = r.kind) e)""",
    """r AS (SELECT kind, count(*) AS total, round(count(*) FILTER (outcome IN ('failure', 'irrelevant')) / count(*), 6) AS rate
  FROM (SELECT unnest(string_split(regexp_extract(query_text, 'kinds=([a-z,]+)', 1), ',')) AS kind, outcome FROM outcomes WHERE age_days < 30 AND outcome <> 'pending') WHERE kind <> '' GROUP BY kind)""",
    "b AS (SELECT * FROM (VALUES ('assertion', 800), ('entity', 400), ('graph', 150), ('vector', 300)) v(kind, budget))"))
def evolved_budgets(spark, sf_dir):
    """Tokens move from the kind that fails most to the one that fails least."""
    from lorekeep.operators.aggregates import outcome_rates

    b = spark.createDataFrame([("assertion", 800), ("entity", 400), ("graph", 150), ("vector", 300)], "kind string, budget int")
    x = state.evolved_budgets(b, outcome_rates(outcomes(spark, sf_dir), 30), above=0.1)
    return x.select("kind", "old_budget", F.col("budget").cast("int").alias("budget"))


@query(with_tables("facts", """SELECT f.id, CASE WHEN p.subject IS NULL THEN reality_check WHEN p.v IS NULL THEN 'unverifiable' WHEN p.v = f.object THEN 'verified' ELSE 'mismatch' END AS reality_check
FROM facts f LEFT JOIN (SELECT subject, predicate, CASE WHEN min(id) % 3 > 0 THEN min_by(object, id) END AS v FROM facts WHERE id % 7 = 0 GROUP BY ALL) p ON p.subject = f.subject AND p.predicate = f.predicate"""))
def reality_tags(spark, sf_dir):
    f = facts(spark, sf_dir)
    p = f.filter(F.pmod("id", F.lit(7)) == 0).groupBy(F.col("subject").alias("p_subject"), F.col("predicate").alias("p_predicate")).agg(F.when(F.pmod(F.min("id"), F.lit(3)) > 0, F.min_by("object", "id")).alias("p_value"))
    return state.reality_tagged(f, p).select("id", "reality_check")


@query(with_tables("facts", """SELECT f.id, f.predicate, f.predicate = 'click' AS excluded FROM facts f
LEFT JOIN (SELECT subject, predicate, CASE WHEN min(id) % 3 > 0 THEN min_by(object, id) END AS v FROM facts WHERE id % 7 = 0 GROUP BY ALL) p ON p.subject = f.subject AND p.predicate = f.predicate
WHERE NOT f.suppressed AND f.invalid_at IS NULL AND CASE WHEN p.subject IS NULL THEN reality_check = 'mismatch' ELSE p.v <> f.object END"""))
def stale_facts(spark, sf_dir):
    """Live facts that a probe contradicts, those of an annotating predicate set apart."""
    from lorekeep.operators import verify

    f = facts(spark, sf_dir)
    p = f.filter(F.pmod("id", F.lit(7)) == 0).groupBy(F.col("subject").alias("p_subject"), F.col("predicate").alias("p_predicate")).agg(F.when(F.pmod(F.min("id"), F.lit(3)) > 0, F.min_by("object", "id")).alias("p_value"))
    return verify.stale_unreconciled(state.reality_tagged(f, p), ["click"]).select("id", "predicate", "excluded")


@query(with_tables("facts", f"""SELECT id, CASE WHEN predicate = 'view' THEN 'click' ELSE predicate END AS predicate, suppressed OR hit AS suppressed, CASE WHEN hit THEN epoch_us({AS_OF_TS}) ELSE {US} END AS invalid_us
FROM (SELECT *, predicate = 'view' AND NOT suppressed AND invalid_at IS NULL AND EXISTS (SELECT 1 FROM facts g WHERE g.project_id = f.project_id AND g.subject = f.subject AND g.predicate = 'click' AND NOT g.suppressed AND g.invalid_at IS NULL) AS hit FROM facts f)"""))
def renamed_predicate(spark, sf_dir):
    """A rename closes what would collide first."""
    x = state.predicate_renamed(facts(spark, sf_dir), "view", "click", as_of())
    return x.select("id", "predicate", "suppressed", micros_of(F.col("invalid_at")).alias("invalid_us"))


@query(with_tables("facts", """SELECT CASE predicate WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'interaction' ELSE predicate END AS predicate, count(*) AS n FROM facts GROUP BY 1"""))
def normalised_predicates(spark, sf_dir):
    x = state.predicates_normalised(facts(spark, sf_dir), {"click": "interaction", "view": "interaction"})
    return x.groupBy("predicate").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN upper(s_name) || '!' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 9 <> 2 UNION ALL SELECT s_suppkey + 5000000, s_name FROM supplier WHERE s_suppkey < 4)
SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN 'INSERT' WHEN n.s_suppkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation, '{"s_name":"' || o.s_name || '"}' AS before, '{"s_name":"' || n.s_name || '"}' AS after
FROM supplier o FULL JOIN n ON o.s_suppkey = n.s_suppkey WHERE o.s_name IS DISTINCT FROM n.s_name""")
def audit_log(spark, sf_dir):
    """Before and after images of all rows that a change touched."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("s_suppkey")
    n = s.filter(F.pmod(k, F.lit(9)) != 2).withColumn("s_name", F.when(F.pmod(k, F.lit(7)) == 0, F.concat(F.upper("s_name"), F.lit("!"))).otherwise(F.col("s_name")))
    n = n.unionByName(s.filter(k < 4).withColumn("s_suppkey", k + 5_000_000))
    return state.audit_rows(s, n, "s_suppkey", ["s_name"])


ALL_THREADS = """threads AS (SELECT s_suppkey AS id, 'T' || (CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey - 1 ELSE s_suppkey END) AS key, s_suppkey % 13 = 0 AS suppressed FROM supplier),
deltas AS (SELECT s_suppkey AS n, CASE s_suppkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'updated' ELSE 'added' END AS kind, (CASE WHEN s_suppkey % 7 = 0 THEN 'X' ELSE 'T' END) || s_suppkey AS key FROM supplier),
o AS (SELECT key, count(*) AS c FROM threads WHERE NOT suppressed GROUP BY key),
d AS (SELECT n, kind, deltas.key, CASE WHEN kind = 'added' THEN 'applied' WHEN c IS NULL THEN 'zero_match' WHEN c > 1 THEN 'ambiguous' ELSE 'applied' END AS state FROM deltas LEFT JOIN o ON o.key = deltas.key)"""


def _all_threads(spark, sf_dir):
    """All suppliers as threads, some of which share a key, and as deltas, some of which match none."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    none = F.lit(None)
    shared = F.when(F.pmod(k, F.lit(4)) == 0, k - 1).otherwise(k)
    threads = s.select(k.alias("id"), F.concat(F.lit("T"), shared).alias("key"), (F.pmod(k, F.lit(13)) == 0).alias("suppressed"), none.cast("timestamp_ntz").alias("invalid_at"), none.cast("string").alias("suppression_kind"), F.lit("open").alias("carryover_status"))
    kind = F.when(F.pmod(k, F.lit(3)) == 0, "resolved").when(F.pmod(k, F.lit(3)) == 1, "updated").otherwise("added")
    return threads, s.select(k.alias("n"), kind.alias("kind"), F.concat(F.when(F.pmod(k, F.lit(7)) == 0, "X").otherwise("T"), k).alias("key"))


@query(f"WITH {ALL_THREADS} SELECT n, kind, key, state FROM d")
def carryover_report(spark, sf_dir):
    """What each delta met: one live thread, none, or several."""
    return state.carryover(*_all_threads(spark, sf_dir), as_of())[1]


@query(f"""WITH {ALL_THREADS} SELECT id, t.key, suppressed OR g.kind IS NOT NULL AS suppressed, CASE WHEN g.kind = 'resolved' THEN 'resolved' ELSE 'open' END AS carryover_status
FROM threads t LEFT JOIN (SELECT DISTINCT key, kind FROM d WHERE state = 'applied' AND kind <> 'added') g ON g.key = t.key AND NOT t.suppressed""")
def carryover_threads(spark, sf_dir):
    return state.carryover(*_all_threads(spark, sf_dir), as_of())[0].select("id", "key", "suppressed", "carryover_status")


@query(f"WITH {ALL_THREADS} SELECT n, kind, key, state FROM d")
def all_carryover_report(spark, sf_dir):
    """What each delta met, over all keys."""
    return state.carryover(*_all_threads(spark, sf_dir), as_of())[1]


@query(f"""WITH {ALL_THREADS} SELECT id, t.key, suppressed OR g.kind IS NOT NULL AS suppressed, CASE WHEN g.kind = 'resolved' THEN 'resolved' ELSE 'open' END AS carryover_status
FROM threads t LEFT JOIN (SELECT DISTINCT key, kind FROM d WHERE state = 'applied' AND kind <> 'added') g ON g.key = t.key AND NOT t.suppressed""")
def all_carryover_threads(spark, sf_dir):
    return state.carryover(*_all_threads(spark, sf_dir), as_of())[0].select("id", "key", "suppressed", "carryover_status")


@query(with_tables("facts", f"""SELECT * FROM (SELECT project_id, subject, predicate, object, pinned FROM facts WHERE NOT suppressed AND invalid_at IS NULL AND pinned
  UNION ALL SELECT DISTINCT c.project_id, c.subject, c.predicate, c.object, true FROM facts c WHERE c.id % 41 = 0 AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.project_id = c.project_id AND f.subject = c.subject AND f.predicate = c.predicate AND f.object = c.object AND f.pinned AND NOT f.suppressed AND f.invalid_at IS NULL))"""))
def operator_pins(spark, sf_dir):
    """Pins by order, each once."""
    f = facts(spark, sf_dir)
    k = ["project_id", "subject", "predicate", "object"]
    have = f.filter(live() & F.col("pinned")).select(*k, "pinned")
    want = f.filter(F.pmod("id", F.lit(41)) == 0).select(*k).distinct().withColumn("pinned", F.lit(True))
    return state.inserted_only(have, want, k)


@query(with_tables("entries", """SELECT id, CASE WHEN id % 4 = 1 THEN upper(name) ELSE name END AS name, CASE WHEN id % 4 = 1 AND upper(name) <> name THEN CASE WHEN id % 8 = 1 THEN 'new' END ELSE 'old' END AS embedding FROM entries"""))
def edited_entries(spark, sf_dir):
    """A new text without a vector clears the old vector (here a word)."""
    from lorekeep.sources.domain import entries

    e = entries(spark, sf_dir).select("id", "name", F.lit("old").alias("embedding"))
    new = e.filter(F.pmod("id", F.lit(4)) == 1).select("id", F.upper("name").alias("name"), F.when(F.pmod("id", F.lit(8)) == 1, "new").alias("embedding"))
    return state.edited(e, new, ["id"], "name")


@query(with_tables("entities", """SELECT name, suppressed AND NOT hit AS suppressed, CASE WHEN hit AND suppressed THEN 'revived' END AS outcome FROM (SELECT *, id % 2 = 0 AS hit FROM entities)
UNION ALL SELECT 'new_' || n_name, false, 'created' FROM nation"""))
def revived_entities(spark, sf_dir):
    """Created names: suppressed ones come back, unknown ones are added."""
    from lorekeep.sources.domain import entities

    e = entities(spark, sf_dir)
    names = e.filter(F.pmod("id", F.lit(2)) == 0).select("project_id", "name", "entity_type").unionByName(table(spark, sf_dir, "nation").select(F.lit("geo").alias("project_id"), F.concat(F.lit("new_"), "n_name").alias("name"), F.lit("nation").alias("entity_type")))
    return state.revived(e, names).select("name", "suppressed", "outcome")


@query(with_tables("facts", """SELECT order_id, n_live, CASE WHEN n_live = 1 THEN 'applied' WHEN n_live = 0 THEN 'not_found' ELSE 'ambiguous' END AS state FROM (
  SELECT c.id AS order_id, count(f.id) AS n_live FROM facts c LEFT JOIN facts f ON f.project_id = c.project_id AND f.subject = c.subject AND f.predicate = c.predicate AND NOT f.suppressed AND f.invalid_at IS NULL
  WHERE c.id % 53 = 5 GROUP BY c.id)"""))
def optimistic_updates(spark, sf_dir):
    """An update applies only if exactly one live fact is meant."""
    f = facts(spark, sf_dir)
    orders = f.filter(F.pmod("id", F.lit(53)) == 5).select(F.col("id").alias("order_id"), "project_id", "subject", "predicate")
    return state.replaced_exactly_one(f, orders, as_of())[1].select("order_id", "n_live", "state")


@query("""WITH h AS (SELECT 'c' || (n_nationkey % 5) AS name, CAST(n_nationkey // 5 + 1 AS INTEGER) AS version, 'b' || (n_nationkey % 7) AS body FROM nation)
SELECT * FROM h UNION ALL SELECT 'c' || s, CAST(coalesce((SELECT max(version) FROM h WHERE name = 'c' || s), 0) + 1 AS INTEGER), 'b1' FROM (SELECT unnest(range(0, 7)) AS s)
WHERE (SELECT max_by(body, version) FROM h WHERE name = 'c' || s) IS DISTINCT FROM 'b1'""")
def contract_versions(spark, sf_dir):
    """A change that says the same is none."""
    k = F.col("n_nationkey")
    h = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.pmod(k, F.lit(5))).alias("name"), (F.floor(k / 5) + 1).cast("int").alias("version"), F.concat(F.lit("b"), F.pmod(k, F.lit(7))).alias("body"))
    return state.contract_versions(h, spark.range(7).select(F.concat(F.lit("c"), "id").alias("name"), F.lit("b1").alias("body")))
