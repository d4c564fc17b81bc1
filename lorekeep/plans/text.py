"""Queries over texts: chunks, sections, links, secrets, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.expr import compare_key, intent_key, row_hash, subject_key, token_estimate
from lorekeep.operators import handoff, text
from lorekeep.plans.registry import query
from lorekeep.sources.domain import exchange, with_tables
from lorekeep.sources.tables import table


@query()
def document_chunks(spark, sf_dir):
    """Chunks of all documents (a small Python rule per text: tested against the rule's cases and a lossless join)."""
    return text.chunked(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN {text.FUNCTION_WORDS})) / len(w) ELSE 0 END, 6) AS ratio
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda x: x <> '') AS w FROM documents)""")
def function_word_ratios(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"), F.round(text.function_word_ratio(F.col("text")), 6).alias("ratio"))


@query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))""")
def page_links(spark, sf_dir):
    """Every link of every page, in order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "href"))


@query("""SELECT item_id, key, title FROM (SELECT item_id, 'Item-' || item_id AS key, 'T' || (item_id * 7) AS title FROM benchmark)""")
def wiki_titles(spark, sf_dir):
    """Front matter read back from texts that were written with it."""
    b = table(spark, sf_dir, "benchmark")
    doc = F.concat(F.lit("---\nname: Item-"), F.col("item_id"), F.lit("\ntitle: "), F.lit("T"), F.col("item_id") * 7, F.lit("\n---\n"), "text")
    return b.select("item_id", text.front_matter(doc, "name").alias("key"), text.front_matter(doc, "title").alias("title"))


@query("""SELECT item_id, 'page ' || (item_id % 7) AS target, CASE WHEN item_id % 2 = 0 THEN 'part' END AS anchor, CASE WHEN item_id % 3 = 0 THEN 'see' END AS alias FROM benchmark""")
def wiki_links(spark, sf_dir):
    """Links outside code, with their anchors and aliases."""
    k = F.col("item_id")
    doc = F.concat(F.lit("text [[page "), F.pmod(k, F.lit(7)), F.when(F.pmod(k, F.lit(2)) == 0, "#part").otherwise(""), F.when(F.pmod(k, F.lit(3)) == 0, "|see").otherwise(""), F.lit("]] and `[[code]]` and\n```\n[[fenced]]\n```\n"))
    return text.wiki_links(table(spark, sf_dir, "benchmark").select(k, doc.alias("text")), "item_id")


@query("""SELECT item_id, ord, level, number, title, content FROM (SELECT item_id, 0 AS ord, 0 AS level, '0' AS number, '(preamble)' AS title, 'lead ' || item_id AS content FROM benchmark UNION ALL SELECT item_id, 1, 1, '1.2', '1.2 First', regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM benchmark
  UNION ALL SELECT item_id, 2, 3, '', 'Last ' || item_id, 'end' FROM benchmark)""")
def document_sections(spark, sf_dir):
    """Sections at headings outside fences."""
    k = F.col("item_id")
    doc = F.concat(F.lit("lead "), k, F.lit("\n# 1.2 First\n"), "text", F.lit("\n```\n# not a heading\n```\n### Last "), k, F.lit("\nend\n"))
    return text.sections(table(spark, sf_dir, "benchmark").select(k, doc.alias("text")), "item_id")


@query("""SELECT item_id, ord, level, number, title, content FROM (SELECT item_id, 0 AS ord, 0 AS level, '0' AS number, '(preamble)' AS title, 'lead ' || item_id AS content FROM benchmark UNION ALL SELECT item_id, 1, 1, '1.2', '1.2 First', regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM benchmark
  UNION ALL SELECT item_id, 2, 3, '', 'Last ' || item_id, 'end' FROM benchmark)""")
def whole_document_sections(spark, sf_dir):
    """Sections at headings outside fences, of whole texts."""
    k = F.col("item_id")
    doc = F.concat(F.lit("lead "), k, F.lit("\n# 1.2 First\n"), "text", F.lit("\n```\n# not a heading\n```\n### Last "), k, F.lit("\nend\n"))
    return text.sections(table(spark, sf_dir, "benchmark").select(k, doc.alias("text")), "item_id")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\\b(?:postgres(?:ql)?|mysql|mongodb|redis)://[^\\s:@/]+:[^\\s@/]+@') THEN 'connection' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}') THEN 'email' END,
  CASE WHEN regexp_matches(text, '(?:/home/|/Users/|C:\\\\Users\\\\)[A-Za-z0-9._-]+') THEN 'home_path' END, CASE WHEN regexp_matches(text, '\\b(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}') THEN 'token' END,
  CASE WHEN regexp_matches(text, '(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b') THEN 'uuid' END) AS kinds FROM documents""")
def secrets_in_documents(spark, sf_dir):
    """All kinds of secrets in every text as it is, percent-decoded or in base64 (the SQL has the raw form; these texts hold no other)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.secret_kinds(F.col("text")), ",").alias("kinds"))


@query()
def secret_kinds_of_documents(spark, sf_dir):
    """All kinds of secrets in every text as it is, percent-decoded or in base64 (no SQL form of the decoding: tested by brute force)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.secret_kinds(F.col("text")), ",").alias("kinds"))


@query(with_tables("exchange", """SELECT id, CASE WHEN length(t) = 0 THEN 'unknown' WHEN shut AND NOT op THEN 'closed' WHEN op AND NOT shut THEN 'open' ELSE 'unknown' END AS status FROM (SELECT id, t, regexp_matches(t, '(?i)\\b(done|closed|resolved|fixed|shipped|merged)\\b') AS shut, regexp_matches(t, '(?i)\\b(open|todo|pending|blocked|in progress|wip)\\b') AS op
  FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'Done in ' || id WHEN 1 THEN 'still OPEN' WHEN 2 THEN 'fixed, but pending' WHEN 3 THEN '' ELSE 'abandoned' END AS t FROM exchange))"""))
def status_cells(spark, sf_dir):
    k = F.col("id")
    m = lambda v: F.pmod(k, F.lit(5)) == v
    t = F.when(m(0), F.concat(F.lit("Done in "), k)).when(m(1), "still OPEN").when(m(2), "fixed, but pending").when(m(3), "").otherwise("abandoned")
    return exchange(spark, sf_dir).select("id", text.status_of(t).alias("status"))


@query("""SELECT item_id, CASE WHEN colon > 1 AND colon <= 60 AND substring(t, colon + 1, 1) = ' ' THEN trim(left(t, colon - 1)) WHEN strlen(t) <= 1000 THEN t
  ELSE rtrim(CASE WHEN strpos(cut, ' ') > 0 THEN regexp_replace(cut, ' [^ ]*$', '') ELSE cut END) || ' …#' || left(sha256(t), 8) END AS key,
  regexp_replace(lower(nfc_normalize(body)), '[.!?;]+$', '') AS cmp, lower(body) AS subject
FROM (SELECT *, strpos(t, ':') AS colon, CASE WHEN strlen(t) > 1000 THEN left(t, list_max(list_filter(range(0, 988), lambda n: strlen(left(t, n)) <= 987))) END AS cut
  FROM (SELECT item_id, body, CASE WHEN item_id % 2 = 0 THEN trim('TASK ' || item_id || ': ' || body) WHEN item_id % 3 = 0 THEN trim(body || ' ' || body || ' ' || body || ' ' || body || ' ' || body || ' ' || body || ' ' || body || ' ' || body) ELSE body END AS t
    FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM benchmark)))""")
def text_keys(spark, sf_dir):
    """Intent keys, comparison keys and canonical subjects of whole texts: with a key and a colon, as they are, and eight times over, beyond the byte limit."""
    t, k = F.col("text"), F.col("item_id")
    said = F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit("  TASK "), k, F.lit(": "), t)).when(F.pmod(k, F.lit(3)) == 0, F.array_join(F.array_repeat(t, 8), " \n ")).otherwise(t)
    return table(spark, sf_dir, "benchmark").select(k, intent_key(said).alias("key"), compare_key(t).alias("cmp"), subject_key(t).alias("subject"))


@query()
def whole_text_keys(spark, sf_dir):
    """Intent keys, comparison keys and canonical subjects of whole texts of any length, with colons or not (tested by brute force)."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", intent_key(t).alias("key"), compare_key(t).alias("cmp"), subject_key(t).alias("subject"))


@query("""WITH old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 1 THEN text || '.' ELSE text END) AS sha FROM documents WHERE doc_id % 9 <> 4)
SELECT doc_id, sha256(text) AS sha FROM documents d WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.doc_id = d.doc_id AND old.sha = sha256(d.text))""")
def changed_for_reingest(spark, sf_dir):
    """Texts whose digest differs from that of the last run, in which some texts had another end and some were missing: only these are read in again."""
    d = table(spark, sf_dir, "documents")
    was = F.when(F.pmod("doc_id", F.lit(4)) == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    old = d.filter(F.pmod("doc_id", F.lit(9)) != 4).select(F.col("doc_id").alias("o_id"), F.sha2(was, 256).alias("o_sha"))
    new = d.select("doc_id", F.sha2("text", 256).alias("sha"))
    return new.join(old, (F.col("doc_id") == F.col("o_id")) & (F.col("sha") == F.col("o_sha")), "left_anti")


@query("""WITH old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 2 THEN replace(text, 'e', 'E') || '.' ELSE text END) AS sha FROM documents WHERE doc_id % 7 <> 3)
SELECT doc_id, sha256(text) AS sha FROM documents d WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.doc_id = d.doc_id AND old.sha = sha256(d.text))""")
def documents_to_reingest(spark, sf_dir):
    """All texts against the last run, in which some were different and some missing: only those are read in again."""
    d = table(spark, sf_dir, "documents")
    was = F.when(F.pmod("doc_id", F.lit(5)) == 2, F.concat(F.replace("text", F.lit("e"), F.lit("E")), F.lit("."))).otherwise(F.col("text"))
    old = d.filter(F.pmod("doc_id", F.lit(7)) != 3).select(F.col("doc_id").alias("o_id"), F.sha2(was, 256).alias("o_sha"))
    new = d.select("doc_id", F.sha2("text", 256).alias("sha"))
    return new.join(old, (F.col("doc_id") == F.col("o_id")) & (F.col("sha") == F.col("o_sha")), "left_anti")


@query("""SELECT count(*) AS n, count(DISTINCT text || '|' || coalesce(lang, 'NULL') || '|' || coalesce(source, 'NULL')) AS n_distinct FROM documents""")
def distinct_rows(spark, sf_dir):
    """Rows and distinct row hashes."""
    return table(spark, sf_dir, "documents").select(row_hash("text", "lang", "source").alias("h")).agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_distinct"))


CLEAN = r"[`~#|<>!\[\]()*+-]"


def _handoff_file(k, t):
    """A hand-off file around a document's text: a session with open carry-overs, a fence with what is no heading, items for the next session, references."""
    said = F.regexp_replace(F.coalesce(t, F.lit("")), CLEAN, " ")
    return F.concat(
        F.lit("# Log\n## Session 2026-01-02 (x) - Title "), k, F.lit("\n"), F.regexp_replace(said, r"[\s\x{FEFF}]+", " "),
        F.lit("\n```\n## Session 1 - a - not a heading\n```\n### Open carry-overs (3)\n| Item | Status | Notes |\n|---|:--|---|\n| fix "), k, F.lit(" | DONE | a\\|b |\n| ship "), k,
        F.lit(" | still open | |\n| uneven |\n\n| orphan | open | x |\n## Next session\n- first "), k, F.lit("\n  and more\n- [ ] see [page](p"), k, F.lit(".md)\n## Quick references\n\nkeep "), k, F.lit("\n"),
    )


@query("""WITH d AS (SELECT doc_id AS k, regexp_replace(regexp_replace(coalesce(text, ''), '[`~#|<>!\\[\\]()*+-]', ' ', 'g'), '[\\s\\x{FEFF}]+', ' ', 'g') AS body FROM documents)
SELECT k AS doc_id, unnest(['section', 'section', 'fact', 'thread', 'thread', 'flag', 'flag', 'section', 'thread', 'thread', 'reference', 'section', 'fact']) AS kind,
  unnest(CAST([1, 2, 2, 10, 11, 12, 14, 15, 16, 18, 18, 19, 19] AS BIGINT[])) AS line,
  unnest(['title', 'session', 'session_tldr', 'carry_over', 'carry_over', 'uneven-row', 'orphan-row', 'next_session', 'next', 'next', 'page', 'quick_reference', 'quick_reference']) AS name,
  unnest(['Log', 'Title ' || k, body || chr(10) || '```' || chr(10) || '## Session 1 - a - not a heading' || chr(10) || '```', 'fix ' || k, 'ship ' || k, '| uneven |', '| orphan | open | x |', 'Next session', 'first ' || k || ' and more', 'see [page](p' || k || '.md)', 'p' || k || '.md', 'Quick references', 'keep ' || k]) AS value,
  unnest([NULL, NULL, NULL, 'closed', 'open', NULL, NULL, NULL, 'open', 'open', NULL, NULL, NULL]) AS state FROM (SELECT k, rtrim(body, ' ') AS body FROM d)""")
def handoff_rows(spark, sf_dir):
    """Sections, threads, facts, references and flags of a hand-off file around every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", _handoff_file(F.col("doc_id").cast("string"), F.col("text")).alias("text"))
    rows = handoff.parsed(d, "doc_id")
    state = F.when(F.col("kind") == "thread", F.when(F.col("name") == "next", "open").otherwise(handoff.status_class(F.col("status"))))
    return rows.select("doc_id", "kind", "line", "name", "value", state.alias("state"))


def _tokens_sql(t):
    """The distinct tokens of each family, of a text t; where a family's token must not follow a word, what goes before it is matched too."""
    one = {
        "(?i)\\b[0-9a-f]{7,40}\\b": 0, "\\b[\\w.-]+\\.[A-Za-z0-9]+:[0-9]+\\b": 0, "(?:[A-Za-z]:[\\\\/])?(?:[\\w.-]+[\\\\/])+[\\w.-]+\\.[A-Za-z0-9]+(?::[0-9]+)?": 0, "(?i)\\bPR\\s*#[0-9]+\\b": 0,
        "(?:^|[^\\w])(#[0-9]+)\\b": 1, "\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b": 0, "\\bhttps?://[^\\s)\"''`]+": 0, "\"[^\"\\n]{2,}\"|''[^''\\n]{2,}''|`[^`\\n]{2,}`": 0, "\\b[0-9]+(?:\\.[0-9]+)*\\b": 0, "(?i)\\b(?:not|no|never)\\b|n''t\\b": 0,
    }
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all({t}, '{p}', {g})" for p, g in one.items()) + "]))"


@query(f"""SELECT doc_id, len(w) AS n, md5(array_to_string(list_sort(w), chr(10))) AS digest FROM (SELECT doc_id, {_tokens_sql("coalesce(text, '')")} AS w FROM documents)""")
def load_bearing_tokens(spark, sf_dir):
    """How many distinct tokens of the ten families every document has, and a digest of them."""
    w = F.array_sort(text.load_bearing(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, "\n").cast("binary")).alias("digest"))
