"""What the engine's queries must not leave out."""

import base64
import hashlib
import re
from collections import defaultdict
from urllib.parse import quote, unquote

from lorekeep.operators import graph, text
from lorekeep.plans import registry
from lorekeep.sources.domain import edges, entities
from lorekeep.sources.tables import table

registry.load()
SF = "/root/testdata/sf0.001"


def brute_communities(rows, names, rounds):
    """(name -> label, was a fixed point reached) by the rule of communities()."""
    links = defaultdict(lambda: defaultdict(float))
    for a, b, w in rows:
        if a != b and a in names and b in names:
            links[a][b] += w or 1.0
            links[b][a] += w or 1.0
    for u in links:
        links[u][u] = max(links[u].values())
    label = {n: n for n in names}
    for _ in range(rounds):
        new = {}
        for n in names:
            votes = defaultdict(float)
            for v, w in links[n].items():
                votes[label[v]] += w
            new[n] = min(votes, key=lambda c: (-round(votes[c], 9), c)) if votes else label[n]
        if new == label:
            return label, True
        label = new
    return label, False


def test_communities_of_all_entities(spark):
    """Customers and their hubs are in the graph."""
    names = {r["name"] for r in entities(spark, SF).collect()}
    rows = [(r["from_entity"], r["to_entity"], r["weight"]) for r in edges(spark, SF).collect()]
    want, settled = brute_communities(rows, names, 10)
    got = registry.QUERIES["graph_communities"](spark, SF).collect()
    assert {r["name"]: r["community"] for r in got} == want and len(got) == len(names)
    assert any(n.startswith("Customer") for n in names) and {r["settled"] for r in got} == {settled}


def test_communities_say_whether_they_settled(spark):
    """A path of falling weights takes several rounds: fewer leave it unsettled, and it says so."""
    rows = [(f"n{i}", f"n{i + 1}", 20.0 - i) for i in range(9)]
    names = {f"n{i}" for i in range(10)}
    e = spark.createDataFrame(rows, "from_entity string, to_entity string, weight double")
    n = spark.createDataFrame([(x,) for x in sorted(names)], "name string")
    flags = []
    for rounds in (1, 2, 30):
        want, settled = brute_communities(rows, names, rounds)
        got = graph.communities(e, n, rounds).collect()
        assert {r["name"]: r["community"] for r in got} == want and {r["settled"] for r in got} == {settled}
        flags.append(settled)
    assert flags == [False, False, True]


def brute_secrets(t):
    """Kinds in a text, percent-decoded (as a whole, or not at all) and in its base64 runs."""
    t = t or ""
    parts = [t]
    if not re.search(r"%(?![0-9A-Fa-f]{2})", t):
        try:
            parts.append(unquote(t.replace("+", " "), errors="strict"))
        except UnicodeDecodeError:
            pass
    for run in re.findall(r"\b[A-Za-z0-9+/]{24,}={0,2}", t, re.A):
        try:
            parts.append(base64.b64decode(run, validate=True).decode())
        except ValueError:
            pass
    return [k for k, p in sorted(text.SECRETS.items()) if any(re.search(p, x, re.A) for x in parts)]


def test_secrets_of_all_kinds_and_documents(spark, tmp_path):
    """Every document has a row, and each kind is found as it is, percent-decoded and in base64."""
    said = {"connection": "postgres://me:pass@db", "email": "ann@example.org", "home_path": "/home/ann", "token": "sk-abcdefghijklmnop1234", "uuid": "123e4567-e89b-12d3-a456-426614174000"}
    texts = [None, "", "nothing here"]
    for kind, secret in said.items():
        coded = base64.b64encode(f"padding {secret} and more padding".encode()).decode()
        texts += [f"see {secret} x", "see " + quote(secret, safe="").replace("-", "%2D").replace(".", "%2E") + " x", f"see {coded} x"]
        assert all(kind in brute_secrets(t) for t in texts[-3:])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kinds"] for r in registry.QUERIES["secret_kinds_of_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(brute_secrets(t)) for i, t in enumerate(texts)}


def test_secrets_of_the_tables(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = sorted((r["doc_id"], r["kinds"]) for r in registry.QUERIES["secret_kinds_of_documents"](spark, SF).collect())
    assert got == sorted((r["doc_id"], ",".join(brute_secrets(r["text"]))) for r in docs)


def test_every_text_is_compared_for_reingest(spark):
    """Altered and missing texts of the whole table come back, in all residues of doc_id, and no other."""
    ids = [r["doc_id"] for r in table(spark, SF, "documents").select("doc_id").collect()]
    got = sorted(r["doc_id"] for r in registry.QUERIES["documents_to_reingest"](spark, SF).collect())
    assert got == sorted(i for i in ids if i % 5 == 2 or i % 7 == 3) and {i % 3 for i in got} == {0, 1, 2}


def test_every_line_and_key_takes_part(spark):
    """As many rows as the tables have, and every outcome of a delta occurs."""
    sf = "/root/testdata/sf0.01"
    suppliers = table(spark, sf, "supplier").count()
    report = registry.QUERIES["all_carryover_report"](spark, sf).collect()
    assert len(report) == suppliers and {r["state"] for r in report} == {"applied", "zero_match", "ambiguous"}
    assert registry.QUERIES["all_carryover_threads"](spark, sf).count() == suppliers
    assert registry.QUERIES["lines_filled_from_parent"](spark, sf).count() == table(spark, sf, "lineitem").count()


def brute_keys(t):
    """(intent key, comparison key, subject) of a text."""
    one = re.sub(r"\s+", " ", t or "", flags=re.A).strip(" ")
    at = one.find(":") + 1
    if 1 < at <= 60 and one[at : at + 1] == " ":
        key = one[: at - 1].strip(" ")
    elif len(one.encode()) <= 1000:
        key = one
    else:
        cut = one.encode()[:987].decode(errors="ignore")
        cut = (cut[: cut.rindex(" ")] if " " in cut else cut).rstrip(" ")
        key = f"{cut} …#{hashlib.sha256(one.encode()).hexdigest()[:8]}"
    return key, re.sub(r"[.!?;]+$", "", one.lower()), None if t is None else one.lower()


def test_keys_of_whole_texts(spark, tmp_path):
    """Long texts, colons near and far, and white space, none left out."""
    texts = ["KEY: rest", "  The  plan :  to go", ": none", "a:b", "w" * 70 + ": far", "word " * 300, "w" * 1500, "é" * 700, "é ü " * 400 + "end!?", "Short one.;", "", None, "KEY: " + "long " * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["key"], r["cmp"], r["subject"]) for r in registry.QUERIES["whole_text_keys"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_keys(t) for i, t in enumerate(texts)}


def test_keys_of_the_tables(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["key"], r["cmp"], r["subject"]) for r in registry.QUERIES["whole_text_keys"](spark, SF).collect()}
    assert len(docs) == len(got) and got == {r["doc_id"]: brute_keys(r["text"]) for r in docs}
    assert any("…#" in k for k, *_ in got.values())


def test_sections_of_whole_texts(spark):
    rows = registry.QUERIES["whole_document_sections"](spark, SF).filter("ord = 1").collect()
    assert max(len(r["content"]) for r in rows) > 20


def test_threads_in_a_circle(spark):
    """Replies in a circle, and what hangs below them, have no root; other threads keep theirs."""
    from lorekeep.operators import graph

    rows = [(1, 2), (2, 3), (3, 1), (4, 1), (5, None), (6, 5), (7, 6), (8, 99), (9, 10), (10, 9), (11, 11), (12, 11)]
    got = {r["id"]: (r["root"], r["depth"]) for r in graph.thread_roots(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    none = (None, None)
    assert got == {1: none, 2: none, 3: none, 4: none, 5: (5, 0), 6: (5, 1), 7: (5, 2), 8: (99, 1), 9: none, 10: none, 11: (11, 0), 12: (11, 1)}


def test_walks_stay_in_a_project(spark):
    from lorekeep.operators import graph

    rows = [("p", "a", "x", "b", 1.0), ("q", "b", "x", "c", 1.0), ("p", "b", "x", "d", 1.0), ("q", "a", "x", "e", 1.0)]
    e = spark.createDataFrame(rows, "project_id string, from_entity string, edge_type string, to_entity string, weight double")
    names = lambda p: {r["entity_name"] for r in graph.traverse(e, ["a"], 3, project=p).collect()}
    assert names("p") == {"b", "d"} and names("q") == {"e"} and names(None) == {"b", "c", "d", "e"}


def test_repeated_lookups_multiply_no_rows(spark):
    from lorekeep.operators import movement, state

    df = spark.createDataFrame([(1, None, "k"), (2, "t", "k"), (3, None, "m")], "id int, tenant string, key string")
    lookup = spark.createDataFrame([("k", "b"), ("k", "a"), (None, "z")], "l string, v string")
    assert sorted(movement.filled(df, "tenant", lookup, "l", "v", "key", "none").select("id", "tenant").collect()) == [(1, "a"), (2, "t"), (3, "none")]
    facts = spark.createDataFrame([("s", "p", "o", None)], "subject string, predicate string, object string, reality_check string")
    probes = spark.createDataFrame([("s", "p", "o"), ("s", "p", "a"), ("s", "p", None)], "p_subject string, p_predicate string, p_value string")
    assert [r["reality_check"] for r in state.reality_tagged(facts, probes).collect()] == ["verified"]


def test_windows_beyond_the_broadcast(spark, monkeypatch):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from lorekeep.operators import joins

    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, t0 + timedelta(hours=7 * i)) for i in range(300)], "id int, at timestamp_ntz")
    windows = spark.createDataFrame([(t0 + timedelta(hours=50 * i), t0 + timedelta(hours=50 * i + 11) if i % 5 else None) for i in range(1, 40, 3)], "enabled_at timestamp_ntz, disabled_at timestamp_ntz")
    now = F.lit(t0 + timedelta(hours=100)).cast("timestamp_ntz")
    few = sorted(r["id"] for r in joins.written_in_window(rows, windows, "at", now).collect())
    monkeypatch.setattr(joins, "FEW_WINDOWS", 2)
    assert few and few == sorted(r["id"] for r in joins.written_in_window(rows, windows, "at", now).collect())


def test_quantiles_of_skewed_groups(spark):
    import numpy as np

    from lorekeep.operators import aggregates

    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(0, 1e6, 999)] + [("b", 5.0)] * 700 + [("b", -1e300), ("c", None), (None, 1.5), (None, 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in aggregates.quantiles(df, "v", [0.0, 0.25, 0.5, 0.95], "g").collect()}
    for g in ("a", "b", None):
        vs = [v for k, v in rows if k == g and v is not None]
        want = np.quantile(vs, [0.0, 0.25, 0.5, 0.95])
        assert np.allclose([got[g][c] for c in ("p0", "p25", "p50", "p95")], want) and got[g]["n"] == len(vs)
    assert got["c"]["p50"] is None and got["c"]["n"] == 0
    assert aggregates.quantiles(df, "v", [0.5]).collect()[0]["n"] == len(rows) - 1
