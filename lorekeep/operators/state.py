"""State transitions as pure functions: new rows of a table from its rows and a table of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.expr import live, micros_of, not_pinned

BIAS = {"success": 0.5, "failure": -0.75, "irrelevant": -0.25}
MOST_BIAS = 3.0
DAY_S = 86_400


def closed(df: DataFrame, when: Column, as_of: Column, kind: str) -> DataFrame:
    """Rows for which ``when`` holds become suppressed, invalid from as_of, for the reason named."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns(
        {
            "suppression_kind": F.when(hit, F.lit(kind)).otherwise(F.col("suppression_kind")),
            "invalid_at": F.when(hit, as_of).otherwise(F.col("invalid_at")),
            "suppressed": hit | F.col("suppressed"),
        }
    )


def _keys(changes: DataFrame, *cols: str) -> DataFrame:
    return changes.select(*[F.col(c).alias(f"c_{c}") for c in cols]).distinct()


def _on(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & (F.col(c) == F.col(f"c_{c}"))
    return out


def flagged(df: DataFrame, changes: DataFrame, *cols: str, name: str = "hit") -> DataFrame:
    """df with whether its key is among the changes' keys."""
    k = _keys(changes, *cols).withColumn(f"in_{name}", F.lit(True))
    return df.join(k, _on(*cols), "left").withColumn(name, F.coalesce(f"in_{name}", F.lit(False))).drop(f"in_{name}", *[f"c_{c}" for c in cols])


def superseded(facts: DataFrame, changes: DataFrame, one_to_one: list[str], as_of: Column) -> DataFrame:
    """Close what new facts (project_id, subject, predicate, object) replace: every live fact of a 1:1 predicate, else
    the same object's; pinned facts stay."""
    single = F.col("predicate").isin(*one_to_one)
    x = flagged(facts, changes.filter(single), "project_id", "subject", "predicate", name="one")
    x = flagged(x, changes.filter(~single), "project_id", "subject", "predicate", "object", name="many")
    return closed(x, (F.col("one") | F.col("many")) & ~F.col("suppressed") & not_pinned(), as_of, "superseded").drop("one", "many")


def retired(facts: DataFrame, orders: DataFrame, as_of: Column, with_object: bool) -> DataFrame:
    """Close live facts by order, pinned ones too: of the same object, or all of the subject and predicate."""
    cols = ("project_id", "subject", "predicate") + (("object",) if with_object else ())
    x = flagged(facts, orders, *cols)
    return closed(x, F.col("hit") & live(), as_of, "retired").drop("hit")


def reinforced(facts: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Live facts that were returned count as reinforced now."""
    x = flagged(facts, ids, "id")
    return x.withColumn("last_reinforced", F.when(F.col("hit") & live(), as_of).otherwise(F.col("last_reinforced"))).drop("hit")


def rehabilitated(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts downvoted on probation come back to life; no others do."""
    x = flagged(facts, ids, "id").withColumn("hit", F.col("hit") & F.coalesce(F.col("suppression_kind") == "downvoted_probation", F.lit(False)))
    return (
        x.withColumn("suppressed", F.col("suppressed") & ~F.col("hit"))
        .withColumn("invalid_at", F.when(~F.col("hit"), F.col("invalid_at")))
        .withColumn("suppression_kind", F.when(~F.col("hit"), F.col("suppression_kind")))
        .drop("hit")
    )


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep_when_null: list[str] = (), replace: list[str] = ()) -> DataFrame:
    """old merged with new by key, with ``inserted``: replaced columns take the new value, kept ones only a new value that isn't NULL.

    Keys are unique in old; of several new rows of a key, see ``last_of``.
    """
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns]).withColumn("n_is", F.lit(True))
    o = old.withColumn("o_is", F.lit(True))
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    cols = []
    for c in old.columns:
        if c in key:
            cols.append(F.when(F.col("o_is"), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c))
        elif c in keep_when_null:
            cols.append(F.coalesce(f"n_{c}", c).alias(c))
        elif c in replace:
            cols.append(F.when(F.col("n_is"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c) if f"n_{c}" not in n.columns else F.when(F.col("o_is"), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c))
    return o.join(n, on, "full_outer").select(*cols, F.col("o_is").isNull().alias("inserted"))


def last_of(changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*key, "v.*")


def inserted_only(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks."""
    return old.unionByName(flagged(new, old, *key).filter("not hit").drop("hit"))


def collisions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows that an insert would refuse."""
    return flagged(new, old, *key).filter("hit").drop("hit")


def next_profiles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Profiles with a new active version for each (project, role) that changes; older versions are no longer active."""
    k = ["project_id", "role"]
    top = profiles.groupBy(*k).agg(F.max("version").alias("v"))
    new = changes.select(*k, "model").join(top.select(F.col("project_id").alias("tp"), F.col("role").alias("tr"), "v"), (F.col("project_id") == F.col("tp")) & (F.col("role") == F.col("tr")), "left")
    new = new.select(*k, (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("version"), "model", F.lit(True).alias("active"))
    old = flagged(profiles, changes, *k).withColumn("active", F.col("active") & ~F.col("hit")).drop("hit")
    return old.select(*k, "version", "model", "active").unionByName(new)


def consolidation(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Tier of new claims (claim_id, session_id, project_id, subject, predicate, object): consolidated only if another session said
    the same before, and one of those facts is verified or pinned."""
    k = ["project_id", "subject", "predicate", "object"]
    prior = facts.groupBy(*k).agg(F.min("session_id").alias("s0"), F.max("session_id").alias("s1"), F.max(F.when((F.col("reality_check") == "verified") | F.col("pinned"), F.struct("session_id"))).alias("t1"), F.min(F.when((F.col("reality_check") == "verified") | F.col("pinned"), F.struct("session_id"))).alias("t0"))
    p = prior.select(*[F.col(c).alias(f"c_{c}") for c in k], "s0", "s1", "t0", "t1")
    x = claims.join(p, _on(*k), "left")
    here = F.col("session_id")
    other = (F.col("s0") != here) | (F.col("s1") != here)
    trusted = (F.col("t0.session_id") != here) | (F.col("t1.session_id") != here)
    return x.select(*claims.columns, F.when(F.coalesce(other & trusted, F.lit(False)), "consolidated").otherwise("probationary").alias("tier"))


def new_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims that their session hasn't made yet; a repeat only touches."""
    return flagged(claims, facts, "project_id", "subject", "predicate", "object", "session_id").filter("not hit").drop("hit")


def biased(facts: DataFrame, used: DataFrame) -> DataFrame:
    """Facts with outcomes' bias: used (id, session_id, outcome) counts once a session, the sum is clamped, pinned facts aren't lowered."""
    per = used.dropDuplicates(["id", "session_id", "outcome"])
    delta = F.lit(0.0)
    for outcome, v in BIAS.items():
        delta = F.when(F.col("outcome") == outcome, v).otherwise(delta)
    sums = per.groupBy(F.col("id").alias("u_id")).agg(F.sum(delta).alias("delta"))
    x = facts.join(sums, F.col("id") == F.col("u_id"), "left")
    d = F.coalesce("delta", F.lit(0.0))
    d = F.when(F.col("pinned") & (d < 0), 0.0).otherwise(d)
    return x.withColumn("outcome_bias", F.greatest(F.lit(-MOST_BIAS), F.least(F.lit(MOST_BIAS), F.col("outcome_bias") + d))).drop("u_id", "delta")


def timed_out(events: DataFrame, days: int) -> DataFrame:
    """Pending outcomes older than the limit count as irrelevant."""
    late = (F.col("outcome") == "pending") & (F.col("age_days") > days)
    return events.withColumn("outcome_source", F.when(late, "timeout_decay")).withColumn("outcome", F.when(late, "irrelevant").otherwise(F.col("outcome")))


def evolved_budgets(budgets: DataFrame, rates: DataFrame, step: int = 100, floor: int = 100, least_events: int = 10, above: float = 0.5) -> DataFrame:
    """Tokens move from the kind that fails most to the one that fails least: (kind, budget), a handful of kinds; the total stays."""
    x = budgets.join(rates.select(F.col("kind").alias("r_kind"), "rate", "total"), F.col("kind") == F.col("r_kind"), "left")
    known = F.col("total") >= least_events
    ends = x.agg(
        F.max(F.when(known & (F.col("rate") > above), F.struct("rate", "kind", "budget"))).alias("worst"),
        F.min(F.when(known, F.struct("rate", "kind"))).alias("best"),
    )
    y = x.crossJoin(ends)  # one row
    moved = F.when(F.col("worst").isNotNull() & (F.col("worst.kind") != F.col("best.kind")), F.greatest(F.lit(0), F.least(F.lit(step), F.col("worst.budget") - floor))).otherwise(0)
    new = F.col("budget") + F.when(F.col("kind") == F.col("best.kind"), moved).otherwise(0) - F.when(F.col("kind") == F.col("worst.kind"), moved).otherwise(0)
    return y.select("kind", F.col("budget").alias("old_budget"), F.coalesce(new, F.col("budget")).alias("budget"))


def reality_tagged(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """Facts tagged by what a probe (p_subject, p_predicate, p_value) found: verified, mismatch, or unverifiable where it found nothing.

    Of probes that ask the same, the one with the greatest value counts.
    """
    probes = probes.groupBy("p_subject", "p_predicate").agg(F.max("p_value").alias("p_value"))
    x = facts.join(probes, (F.col("subject") == F.col("p_subject")) & (F.col("predicate") == F.col("p_predicate")), "left")
    tag = F.when(F.col("p_subject").isNull(), F.col("reality_check")).when(F.col("p_value").isNull(), "unverifiable").when(F.col("p_value") == F.col("object"), "verified").otherwise("mismatch")
    return x.withColumn("reality_check", tag).drop("p_subject", "p_predicate", "p_value")


def predicate_renamed(facts: DataFrame, old: str, new: str, as_of: Column) -> DataFrame:
    """Rename a predicate; where a subject already has a live fact of the new name, its old one is closed first."""
    have = facts.filter((F.col("predicate") == new) & live()).select("project_id", "subject")
    x = flagged(facts, have, "project_id", "subject")
    x = closed(x, (F.col("predicate") == old) & F.col("hit") & live(), as_of, "superseded").drop("hit")
    return x.withColumn("predicate", F.when(F.col("predicate") == old, new).otherwise(F.col("predicate")))


def predicates_normalised(facts: DataFrame, names: dict[str, str]) -> DataFrame:
    """Predicates by the canonical names of a small map."""
    m = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    return facts.withColumn("predicate", F.coalesce(F.try_element_at(m, F.col("predicate")), F.col("predicate")))


def promotable(facts: DataFrame, least: float = 9.0) -> DataFrame:
    """Live facts of high confidence that were reinforced more than a day after they were made."""
    return facts.filter(live() & (F.col("confidence") >= least) & ((micros_of(F.col("last_reinforced")) - micros_of(F.col("created_at"))) / 1e6 > DAY_S))


def audit_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, operation, before and after (JSON of the columns) of every row that was updated, deleted or inserted."""
    o = old.select(F.col(key).alias("k"), F.to_json(F.struct(*columns)).alias("before"))
    n = new.select(F.col(key).alias("k2"), F.to_json(F.struct(*columns)).alias("after"))
    x = o.join(n, F.col("k") == F.col("k2"), "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    what = F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE")
    return x.select(F.coalesce("k", "k2").alias(key), what.alias("operation"), "before", "after")


def carryover(threads: DataFrame, deltas: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(threads after, report): deltas (kind resolved, added or updated; key; text) meet live threads by key.

    A key that matches no live thread is reported as zero_match, one that matches several as ambiguous, and neither changes anything.
    """
    open_ = threads.filter(live()).groupBy(F.col("key").alias("t_key")).agg(F.count("*").alias("n_live"))
    d = deltas.join(open_, F.col("key") == F.col("t_key"), "left").drop("t_key")
    state = F.when(F.col("kind") == "added", "applied").when(F.col("n_live").isNull(), "zero_match").when(F.col("n_live") > 1, "ambiguous").otherwise("applied")
    d = d.withColumn("state", state).drop("n_live")
    gone = d.filter("state = 'applied' and kind != 'added'").select(F.col("key").alias("g_key"), F.col("kind").alias("g_kind")).dropDuplicates(["g_key"])
    x = threads.join(gone, F.col("key") == F.col("g_key"), "left")
    hit = F.col("g_key").isNotNull() & live()
    x = x.withColumn("carryover_status", F.when(hit & (F.col("g_kind") == "resolved"), "resolved").otherwise(F.col("carryover_status")))
    return closed(x, hit, as_of, "superseded").drop("g_key", "g_kind"), d


def edited(old: DataFrame, new: DataFrame, key: list[str], text: str, vector: str = "embedding") -> DataFrame:
    """old with new texts by key; a text that changes without a vector of its own loses the old one."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    on = F.lit(True)
    for c in key:
        on = on & (F.col(c) == F.col(f"n_{c}"))
    x = old.join(n, on, "left")
    changed = F.col(f"n_{text}").isNotNull() & ~F.col(f"n_{text}").eqNullSafe(F.col(text))
    own = F.col(f"n_{vector}") if vector in new.columns else F.lit(None)
    v = F.when(changed, own).otherwise(F.coalesce(own, F.col(vector)) if vector in new.columns else F.col(vector))
    return x.select(*[(v if c == vector else F.coalesce(f"n_{c}", c) if c == text else F.col(c)).alias(c) for c in old.columns])


def revived(entities: DataFrame, names: DataFrame) -> DataFrame:
    """entities after names (project_id, name, entity_type) are created: a suppressed entity of the name comes back, new names are added,
    with ``outcome``: revived, created, or NULL for those untouched."""
    key = ["project_id", "name"]
    x = flagged(entities, names, *key)
    back = F.col("hit") & F.col("suppressed")
    old = x.withColumn("outcome", F.when(back, "revived")).withColumn("suppressed", F.col("suppressed") & ~F.col("hit")).drop("hit")
    fresh = flagged(names, entities, *key).filter("not hit").drop("hit")
    missing = [F.lit(None).cast(t).alias(c) for c, t in entities.dtypes if c not in names.columns and c != "suppressed"]
    fresh = fresh.select(*names.columns, *missing, F.lit(False).alias("suppressed"), F.lit("created").alias("outcome"))
    return old.unionByName(fresh.dropDuplicates(key))


def replaced_exactly_one(facts: DataFrame, orders: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(facts after, report): orders (order_id, project_id, subject, predicate) close their live fact if there is exactly one; others change nothing."""
    k = ["project_id", "subject", "predicate"]
    n = facts.filter(live()).groupBy(*[F.col(c).alias(f"l_{c}") for c in k]).agg(F.count("*").alias("n_live"))
    on = F.lit(True)
    for c in k:
        on = on & (F.col(c) == F.col(f"l_{c}"))
    report = orders.join(n, on, "left").select(*orders.columns, F.coalesce("n_live", F.lit(0)).alias("n_live")).withColumn("state", F.when(F.col("n_live") == 1, "applied").when(F.col("n_live") == 0, "not_found").otherwise("ambiguous"))
    x = flagged(facts, report.filter("state = 'applied'"), *k)
    return closed(x, F.col("hit") & live(), as_of, "superseded").drop("hit"), report


def contract_versions(history: DataFrame, changes: DataFrame) -> DataFrame:
    """history (name, version, body) and a next version of every change (name, body) that differs from the newest one."""
    top = history.groupBy(F.col("name").alias("t_name")).agg(F.max(F.struct("version", "body")).alias("t"))
    x = changes.join(top, F.col("name") == F.col("t_name"), "left").filter(~F.col("body").eqNullSafe(F.col("t.body")))
    return history.unionByName(x.select("name", (F.coalesce("t.version", F.lit(0)) + 1).cast("int").alias("version"), "body"))


def rolled_back(history: DataFrame, orders: DataFrame) -> DataFrame:
    """history and, for every order (name, to_version), a copy of that version as the newest one."""
    old = history.select(F.col("name").alias("o_name"), F.col("version").alias("o_version"), F.col("body").alias("o_body"))
    x = orders.join(old, (F.col("name") == F.col("o_name")) & (F.col("to_version") == F.col("o_version"))).select("name", F.col("o_body").alias("body"))
    top = history.groupBy(F.col("name").alias("t_name")).agg(F.max("version").alias("top"))
    return history.unionByName(x.join(top, F.col("name") == F.col("t_name")).select("name", (F.col("top") + 1).cast("int").alias("version"), "body"))
