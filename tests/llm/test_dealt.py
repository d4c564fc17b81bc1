"""Each dealt operator against SQL, the library it must agree with, or brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import _spark, audio_features, chat_windows, exact_dedup, mixing, ngram_join, piece_bpe, pii, queries, warc_fixity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def same_as_sql(df, duck, sql, cols=None):
    want = duck.sql(sql).df()
    cols = sorted(cols or want.columns)
    got = df.select(cols).toPandas()
    key = lambda x: sorted(map(repr, x[cols].astype(object).itertuples(index=False, name=None)))
    assert key(got) == key(want)


# ---- 1


def water(sizes, weights):
    """Targets by repeated resharing."""
    target, left, open_ = {}, sum(sizes.values()), dict(weights)
    while open_:
        total = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / total >= 3 * sizes[s]]
        if not full:
            return target | {s: left * w / total for s, w in open_.items()}
        for s in full:
            target[s] = 3.0 * sizes[s]
            del open_[s]
        left = sum(sizes.values()) - sum(target.values())
    return target


def check_mix(docs, got):
    size = Counter()
    for r in docs:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = water(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len(WORD.findall(r["text"] or ""))) for r in docs)
    by = defaultdict(lambda: [0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source_size"], round(r["target"], 6)][0] += r["taken"]
    totals = Counter()
    for s in order:
        totals[size[s], round(want[s], 6)] += int(want[s] + 0.5)
    assert {k: v[0] for k, v in by.items()} == dict(totals)


def test_mix_sources(spark, sf):
    docs = rows_of(docs_of(spark, sf))
    got = rows_of(queries.op1_mix_sources(spark, sf))
    check_mix(docs, got)
    assert sorted(map(repr, got)) == sorted(map(repr, rows_of(queries.op1_mix_sources(spark, sf))))


def test_mix_levels(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "FAN_BITS", 2)
    check_mix(rows_of(docs_of(spark, sf)), rows_of(queries.op1_mix_sources(spark, sf)))


def test_mix_odd(spark, odd):
    check_mix(rows_of(odd), rows_of(mixing.mix_sources(odd)))
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    taken = sum(-(-r["taken"] // r["size"]) for r in rows_of(mixing.mix_sources(odd)) if r["size"])
    assert mixing.mixed(odd).count() == taken


# ---- 2


def test_sentencepiece(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    got = {r["doc_id"]: r for r in rows_of(queries.op2_sentencepiece(spark, sf))}
    docs = rows_of(docs_of(spark, sf))
    assert len(got) == len(docs)
    for r in docs:
        ids = sp.encode(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_sentencepiece_strings(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    c = piece_bpe.codec(piece_bpe.default_model())
    rng = np.random.default_rng(1)
    letters = list("abetionsh  \n\t▁éß你\U0001f600<>/s.0123,'")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + ["", " ", "▁", "a" * 3000, " " * 500, "the" * 700, "<0x41>", "<s>", "\x00a"]
    for t in texts:
        ids = sp.encode(t)
        assert c.encode(t) == ids, repr(t)
        assert c.decode(ids) == sp.decode(ids), repr(t)
    out = piece_bpe.decode(piece_bpe.encode(odd))
    assert out.columns == [*odd.columns, "ids", "decoded"]
    for r in rows_of(out):
        assert r["ids"] == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(r["ids"])
    assert piece_bpe.encode(odd.limit(0)).count() == 0


# ---- 3


def brute_components(docs, n=4, percent=85):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    sets = []
    for r in docs:
        w = WORD.findall(lower(r["text"] or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(docs)), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            if sets[i]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(docs):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, len(sets[i]), repr(least.get(find(i)) if sets[i] else r["doc_id"])) for i, r in enumerate(docs))


def check_join(df):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], repr(r["component_id"])) for r in rows_of(ngram_join.near_duplicates(df)))
    assert got == brute_components(rows_of(df))


def test_ngram_join(spark, sf):
    check_join(docs_of(spark, sf))


def test_ngram_join_sql(spark, sf, duck):
    same_as_sql(queries.op3_ngram_join(spark, sf), duck, ngram_join.ORACLE_SQL)


def test_ngram_join_odd(spark, odd):
    check_join(odd)
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0
    kept = ngram_join.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    decided = {(r["component_id"]) for r in rows_of(ngram_join.near_duplicates(odd)) if r["n_shingles"] and r["component_id"] is not None}
    assert decided <= {r["doc_id"] for r in rows_of(kept)}


def test_ngram_join_edits(spark):
    """Chains and clusters of edits at and around the threshold, of many sizes; pivots don't link them all."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (4, 5, 8, 12, 20, 33, 60, 120, 250):
        for _ in range(4):
            t = list(rng.choice(words, size))
            for _ in range(12):
                texts.append(" ".join(t))
                t = list(t) if rng.random() < 0.5 else list(texts[rng.integers(len(texts))].split())
                for _ in range(rng.integers(0, 1 + max(1, size // 40))):
                    at = rng.integers(len(t))
                    if rng.random() < 0.5:
                        t[at] = str(rng.choice(words))
                    elif rng.random() < 0.5:
                        t.insert(at, str(rng.choice(words)))
                    elif len(t) > 1:
                        del t[at]
    ids = rng.permutation(len(texts)).tolist()
    check_join(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))


# ---- 4


def test_warc(spark, sf, duck):
    same_as_sql(queries.op4_warc_fixity(spark, sf), duck, warc_fixity.ORACLE_SQL)


def test_warc_odd(spark):
    kind = "page_id long, url string, html string, hash string"
    one = spark.createDataFrame([(i, f"u{i}", "x" * i, "h") for i in range(600)] + [(None, None, None, None), (5, None, "dup", None), (5, None, "dup", None)], kind)
    same = rows_of(warc_fixity.fixity_report(one, one))
    assert len(same) == 603 and all(r["intact"] for r in same)
    two = one.filter("page_id is null or page_id != 599").unionByName(spark.createDataFrame([(10**6, "new", "new", None)], kind))
    got = rows_of(warc_fixity.fixity_report(one, two))
    assert sorted((r["page_id"] or -1) for r in got if not r["intact"]) == [599, 10**6]
    assert warc_fixity.fixity_report(one.limit(0), one.limit(0)).count() == 0


# ---- 6


def test_chat(spark, sf, duck):
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    same_as_sql(queries.op6_chat_windows(spark, sf), duck, chat_windows.ORACLE_SQL, cols)


def test_chat_windows_small(spark):
    said = ["</s>[INST] a \\ <|end|>\n", "x <| y |> \\\\", "", None, "<<SYS>> tail <", "last |"]
    rows = [(1, 0, "system", "be brief", 0)] + [(1, i + 1, "user" if i % 2 == 0 else "assistant", said[i % 6], 0) for i in range(40)]
    rows += [(None, 1, None, "hm", 1), (None, None, "assistant", "first", 1), (2, 0, "assis|>tant", "z" * 5000, 0), (2, 0, "assistant", "tie", 0), (2, 0, "assistant", "tie", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    w = chat_windows.format_windows(df, budget=80, history=20)
    per = defaultdict(list)
    for r in rows_of(w):
        per[r["conv_id"]].append(r)
    for conv, ws in per.items():
        mine = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        seen, targets = [], []
        for r in sorted(ws, key=lambda r: r["window"]):
            turns = chat_windows.parse(r["text"])
            for raw in ("</s>", "[INST]", "<<SYS"):
                assert raw not in r["text"]
            assert turns[0][1] == "system" or conv != 1
            seen += [(role, t) for k, role, t, _ in turns if k >= r["first_new"]]
            targets += [chat_windows.unescape(r["text"][m["start"] : m["end"]]) for m in r["mask"]]
            assert r["tokens"] <= 80 or sum(k >= r["first_new"] for k, *_ in turns) == 1
        assert seen == [(t[2] or "", t[3] or "") for t in mine]
        assert targets == [t[3] or "" for t in mine if t[2] == "assistant"]
    assert len(per[1]) > 3
    back = {r["conv_id"]: (r["n_turns"], r["formatted_chars"]) for r in rows_of(chat_windows.read_back(w))}
    assert back == {conv: (sum(t[0] == conv for t in rows), sum(len(r["text"]) for r in ws)) for conv, ws in per.items()}
    assert chat_windows.read_back(chat_windows.format_windows(df.limit(0))).count() == 0


# ---- 7


def test_exact_dedup(spark, sf, duck):
    same_as_sql(queries.op7_exact_dedup(spark, sf), duck, exact_dedup.ORACLE_SQL)


def test_exact_dedup_odd(spark, odd):
    got = rows_of(exact_dedup.dedup_decisions(odd))
    groups = defaultdict(list)
    for r in rows_of(odd):
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()].append(r)
    assert len(got) == sum(map(len, groups.values()))
    for key, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        mine = [r for r in got if r["text_sha256"] == key]
        assert {r["keep_id"] for r in mine} == {best["doc_id"]} and {r["group_size"] for r in mine} == {len(rows)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [best["doc_id"]]
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.dedup_decisions(odd.limit(0)).count() == 0


@pytest.mark.parametrize("splits", [3, 40, 300])
@pytest.mark.parametrize("parts", [8, 51])
def test_exact_dedup_splits(spark, splits, parts):
    """Runs of any number of partitions, in which copies lie everywhere."""
    rng = np.random.default_rng(7)
    rows = [(int(i), "copy " * 3 if rng.random() < 0.3 else f"text{' ' * int(rng.integers(1, 3))}{int(rng.integers(0, 1500))}") for i in rng.permutation(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(splits).checkpoint()
    assert docs.rdd.getNumPartitions() == splits
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.replace(" ", "")].append((-len(t), i))
    want = sorted((i, min(g)[1], len(g), (m, i) == min(g)) for g in groups.values() for m, i in g)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows_of(exact_dedup.dedup_decisions(docs)))
        assert got == want
        assert sorted(r["doc_id"] for r in rows_of(exact_dedup.deduplicated(docs))) == sorted(min(g)[1] for g in groups.values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_dedup_rounds(spark, monkeypatch):
    """Many rounds: runs merged two at a time."""
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    rows = [(i, f"t {i % 37}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(70).checkpoint()
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows_of(exact_dedup.dedup_decisions(docs)))
    assert got == [(i, i % 37, len(range(i % 37, 1500, 37))) for i in range(1500)]


def test_without_rows_shuffles_what_is_named(spark):
    """Rows that the decisions don't name pass without a shuffle; of rows that repeat, one stays."""
    docs = spark.range(0, 3000, 1, 6).selectExpr("id as doc_id", "concat('text ', id) as text", "id as map_bits").union(spark.createDataFrame([(5, "text 5", 5)] * 40, "doc_id long, text string, map_bits long"))
    named = docs.filter("doc_id < 100").select("doc_id", F.xxhash64("text").alias("row_hash"), (F.col("doc_id") == 5).alias("stays")).distinct()
    left = _spark.without_rows(docs, _spark.checkpoint(named))
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows_of(left)) == [5, *range(100, 3000)]
    assert left.toPandas().shape == (2901, 3)
    plan = left._jdf.queryExecution().executedPlan().toString()
    first = plan.split("SortMergeJoin")[0]
    assert "Exchange hashpartitioning" not in first.split("BroadcastExchange")[0] and "BroadcastHashJoin" in first


def test_exact_dedup_many_rows(spark):
    """Runs of several Arrow batches, and 60000 repeats of one row."""
    many = spark.range(60_000).selectExpr("id % 25000 + 1 as doc_id", "concat('t ', id % 25000) as text")
    same = spark.range(60_000).selectExpr("cast(0 as bigint) as doc_id", "'one and the same' as text")
    docs = many.union(same).coalesce(2)
    got = exact_dedup.dedup_decisions(docs).groupBy("doc_id", "keep_id", "group_size").agg({"kept": "count", "*": "count"}).count()
    assert got == 25_001
    assert exact_dedup.dedup_decisions(docs).filter("kept").count() == 25_001
    assert exact_dedup.deduplicated(docs).count() == 25_001


# ---- 8


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    """Every kept span: (start, order, end, kind, score)."""
    digits = lambda m: re.sub("[^0-9]", "", m)

    def account(m):
        m = m.replace(" ", "")
        return 15 <= len(m) <= 34 and int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
        "iban": (pii.KINDS["iban"][0], account),
        "ssn": (pii.KINDS["ssn"][0], lambda m: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000"),
        "secret": (r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{24,128}={0,2}(?![A-Za-z0-9_+/=-])", lambda m: len(digits(m)) > 2 and len(re.sub("[^A-Za-z]", "", m)) > 2),
    }
    assert list(kinds) == list(pii.KINDS)
    out = []
    for k, (kind, (p, ok)) in enumerate(kinds.items()):
        _, _, better, worse, base = pii.KINDS[kind]
        for m in re.finditer(p, t, re.A):
            if ok(m[0]):
                near = t[max(0, m.start() - 40) : m.start()] + "\n" + t[m.end() : m.end() + 40]
                score = round(base + 0.2 * bool(re.search(better, near, re.I | re.A)) - 0.3 * bool(re.search(worse, near, re.I | re.A)), 2)
                if kind in pii.BASE_KINDS or score >= 0.7:
                    out.append((m.start(), k, m.end(), kind, score))
    return sorted(out)


def check_pii(docs, got):
    assert len(docs) == len(got)
    cols = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "n_other")
    want, found = [], Counter()
    for r in docs:
        spans = brute_pii(r["text"] or "")
        n = Counter(s[3] for s in spans)
        found += n
        said = [f"{k}:{a}:{b}" for a, _, b, k, _ in spans]
        base = hashlib.sha256(",".join(x for x, s in zip(said, spans) if s[3] in pii.BASE_KINDS).encode()).hexdigest()
        want.append((r["doc_id"], n["email"], n["ip"], n["card"], n["phone"], base, ",".join(said), ",".join(str(s[4]) for s in spans), n["iban"] + n["ssn"] + n["secret"]))
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(want)
    return found


def test_pii(spark, sf):
    found = check_pii(rows_of(docs_of(spark, sf)), rows_of(queries.op8_pii(spark, sf)))
    assert min(found[k] for k in pii.BASE_KINDS) > 5 and found["secret"] > 5


ODD_PII = ["a@b.cx+y@d.ee a@b.c@d.e.f .@-.- %@x", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 001.002.003.004 0300.1.1.1", "é4111-1111 1111-1111 4111111111111112 4111 1111  1111", "\U0001f600 +1 (415) 555-0123) +12 +1((((((( +1.2.3.4.5.6.7.8.9.0", "GB82 WEST 1234 5698 7654 32 bank DE89370400440532013000 DE89370400440532013001", "1" * 30000, "a" * 30000 + "@", "x@y" + ".z" * 20000, "+1" + "(" * 20000, "9 " * 15000]


def test_pii_odd(spark, odd):
    check_pii(rows_of(odd), rows_of(pii.pii_report(odd)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_PII)], "doc_id long, text string")
    got = rows_of(pii.pii_report(df))
    check_pii(rows_of(df), got)
    assert next(r["spans"] for r in got if r["doc_id"] == 4).count("iban") == 2
    assert pii.pii_report(odd.limit(0)).count() == 0


def test_pii_context_decides(spark):
    """The same span is kept or not by the words before and after it, and no further than NEARBY from it."""
    key, number, iban = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "123-45-6789", "GB82 WEST 1234 5698 7654 32"
    texts = {
        f'token = "{key}"': 1, f"see {key} there": 0, f"commit {key} by token": 0, f'"{key}" is the api key': 1, f"token {'x ' * 20}{key}": 0,
        f"my social security number {number}": 1, f"part {number}": 0, f"{number} (SSN)": 1, "ssn 000-45-6789": 0, "ssn 123-00-6789": 0,
        f"pay {iban} now": 1, f"example {iban}": 0, f"sample bank account {iban}": 0, f"{iban}, {iban}": 2, "GB83 WEST 1234 5698 7654 32 bank": 0,
        f"\U0001f600\U0001f600 {iban} \U0001f600 specimen": 0,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(pii.pii_report(df))
    check_pii(rows_of(df), got)
    assert {t: next(r["n_other"] for r in got if r["doc_id"] == i) for i, t in enumerate(texts)} == texts


def test_pii_many_matches(spark):
    """Texts of very many matches, and of megabytes, are placed in about linear time."""
    mixed = "call +1 415 555 0123 or a@b.de, 10.0.0.1 and 4111-1111 1111-1111; \U0001f600 12 34 "
    texts = [mixed * k for k in (1, 7, 64, 65, 300)] + ["a@b.de " * 32000, "12  " * 32000, "4111111111111111  " * 8000, mixed * (5_000_000 // len(mixed))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pii(rows_of(df), rows_of(pii.pii_report(df)))
    long = spark.createDataFrame([(1, "x" * 5_000_000), (2, "1" * 5_000_000)], "doc_id long, text string")
    assert [r["spans"] for r in rows_of(pii.pii_report(long))] == ["", ""]


# ---- 9


def test_audio(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(docs_of(spark, sf))}
    got = rows_of(queries.op9_audio_features(spark, sf))
    assert len(got) == len(docs)
    features = {}
    for r in got:
        raw = docs[r["doc_id"]]
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(payload) + 44
        assert features.setdefault(raw, r["feature"]) == r["feature"]
        times = [tuple(map(int, x.split("-"))) for x in r["spans"].split(",") if x]
        assert audio_features.read_tensor(r["tensor"]).shape == (len(times), audio_features.POOLED, audio_features.MELS)
        assert all(a < b for a, b in times) and times == sorted(times)
    assert len(set(features.values())) > 0.9 * len(features)


def test_audio_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    raw = audio_features.payload_of(rng.integers(0, 256, 200_001, dtype=np.uint8).tobytes())
    whole = np.concatenate(list(audio_features.log_mels(raw)))
    monkeypatch.setattr(audio_features, "BLOCK", 37)
    parts = np.concatenate(list(audio_features.log_mels(raw)))
    assert whole.shape == parts.shape and np.allclose(whole, parts, atol=1e-3)
    x = rng.random((5, audio_features.POOLED, audio_features.MELS)).astype(np.float32)
    assert np.array_equal(audio_features.read_tensor(audio_features.tensor_ipc(x)), x)
    tone = (128 + 100 * np.sin(np.arange(64000) * 2 * np.pi * 440 / 8000) * (np.arange(64000) // 16000 % 2)).astype(np.uint8).tobytes()
    n, spans, _, _ = audio_features.features(tone)
    assert [round(s["start_ms"] / 1000) for s in spans] == [2, 6]


def test_audio_by_definition():
    """Resampling as zero-stuffing, filtering and decimation, mel energies by a direct Fourier sum, hysteresis frame by frame."""
    a = audio_features
    rng = np.random.default_rng(9)
    raw = a.payload_of(rng.integers(0, 256, 6000, dtype=np.uint8).tobytes())
    x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    n, rate = a.TAPS * a.UP, a.RATE * a.UP / a.DOWN
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(a.UP, a.DOWN)) * np.hamming(n)
    stuffed = np.zeros(len(x) * a.UP)
    stuffed[:: a.UP] = x
    want = np.convolve(stuffed, h / h.sum() * a.UP)[: len(stuffed) : a.DOWN]
    got = a.resample(x.astype(np.float32))
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-5)
    mels = np.concatenate(list(a.log_mels(raw)))
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 50 / 700), 2595 * np.log10(1 + rate / 2 / 700), a.MELS + 2) / 2595) - 1)
    k, i = np.arange(a.FRAME // 2 + 1), np.arange(a.FRAME)
    dft = np.exp(-2j * np.pi * np.outer(k, i) / a.FRAME)
    for f in range(0, len(mels) - 1, 3):
        power = abs(dft @ (want[f * a.HOP : f * a.HOP + a.FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * i / (a.FRAME - 1))))) ** 2
        for m in range(a.MELS):
            tri = np.interp(k * rate / a.FRAME, edges[m : m + 3], [0, 1, 0], 0, 0)
            assert mels[f, m] == pytest.approx(np.log(max(power @ tri, 1e-6)), abs=2e-3)
    e = rng.normal(size=400)
    on, spans = False, []
    for f, z in enumerate([*(e - e.mean()) / e.std(), -9.0]):
        now = True if z >= a.HIGH else False if z < a.LOW else on
        if now != on:
            spans.append(f)
        on = now
    assert a.segments(e) == list(zip(spans[::2], spans[1::2]))


def test_audio_odd(spark, odd):
    got = rows_of(audio_features.audio_columns(odd))
    assert len(got) == odd.count() and {r["payload_bytes"] for r in got if not r["n_bytes"]} == {64}
    assert audio_features.audio_columns(odd.limit(0)).count() == 0


# ---- 5


def test_lm(spark, sf):
    from lorekeep.llm import maxent_lm

    docs = rows_of(docs_of(spark, sf))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r["doc_id"]: WORD.findall((r["text"] or "").translate(low)) + ["\n"] for r in docs}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in words}
    c = Counter(w for d, ws in words.items() if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for top in (maxent_lm.TOP, 3000):  # with and without tokens that are joined
        maxent_lm.TOP, kept = top, maxent_lm.TOP
        got = rows_of(queries.op5_maxent_lm(spark, sf))
        maxent_lm.TOP = kept
        assert len(got) == len(docs)
        for r in got:
            ws = words[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(ws), sum(w in c for w in ws), n)
            assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        held = [r for r in got if r["held_out"]]
        gain = (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / sum(r["n_tokens"] for r in held)
        assert gain > 0.25, gain


def test_lm_is_a_distribution():
    from lorekeep.llm import maxent_lm as lm

    rng = np.random.default_rng(3)
    w = rng.normal(size=(lm.FEATURES, lm.CLASSES)).astype(np.float32)
    inner = rng.normal(size=(lm.INNER * lm.SUFFIXES, lm.SLOTS)).astype(np.float32)
    p = np.exp(lm.class_logits(w, rng.integers(0, lm.CONTEXTS**2, 50)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    # all tokens of a vocabulary, by definition: class, slot, and share of the last slot
    h = np.unique(rng.integers(-(2**62), 2**62, 9000))
    n, sfx = rng.integers(1, 500, len(h)), rng.integers(0, lm.SUFFIXES, len(h))
    h[0], sfx[0], n[0] = lm.END, 0, 4000
    class_n, class_v = np.bincount(sfx, weights=n, minlength=lm.SUFFIXES).astype(np.int64), np.bincount(sfx, minlength=lm.SUFFIXES)
    in_table = rng.random(len(h)) < 0.9
    in_table[0] = True
    in_table |= n >= np.sort(n)[-5000]
    t = lm.Tables(h[in_table], n[in_table], sfx[in_table], class_n, class_v, int(n.sum()), len(h))
    at, found = t.find(h)
    own = np.where(found, t.own[at], -1)
    out = np.where(own >= 0, own, lm.OWN + sfx * lm.SLOTS + np.where(found, t.slot[at], lm.SLOTS - 1))
    hist = 77 * lm.CONTEXTS + 12
    log_p = np.zeros((lm.CONTEXTS**2, lm.CLASSES), np.float32)
    log_p[hist] = lm.class_logits(w, np.array([hist]))[0] / np.log(10)
    got = lm.token_scores(t, log_p, inner, out, np.full(len(h), hist), at, found) + np.where(found, 0, np.log10(n + lm.ADD))
    rest = Counter()
    for k in range(len(h)):
        if out[k] >= lm.OWN and (out[k] - lm.OWN) % lm.SLOTS == lm.SLOTS - 1:
            rest[sfx[k]] += n[k] + lm.ADD
    for k in range(0, len(h), 7):
        c = int(lm.class_of(out[k : k + 1])[0])
        f = lm.feature_rows(np.array([hist]))[0]
        z = [sum(float(w[i, j]) for i in f) for j in range(lm.CLASSES)]
        want = z[c] - np.log(sum(np.exp(z)))
        if c >= lm.OWN:
            s = (out[k] - lm.OWN) % lm.SLOTS
            z = [sum(float(inner[i * lm.SUFFIXES + c - lm.OWN, j]) for i in (0, 1 + 12, 1 + lm.CONTEXTS + 77)) for j in range(lm.SLOTS)]
            want += z[s] - np.log(sum(np.exp(z)))
            if s == lm.SLOTS - 1:
                want += np.log((n[k] + lm.ADD) / (rest[sfx[k]] + lm.ADD))
        assert got[k] == pytest.approx(want / np.log(10), abs=1e-4)
    assert 0.98 < (10**got).sum() <= 1.0001  # what is missing is for unknown words


def test_lm_gradient():
    """Seen less expected counts are the derivatives of the log-likelihood, for weights of both factors."""
    from lorekeep.llm import maxent_lm as lm

    rng = np.random.default_rng(8)
    key = np.unique(rng.integers(0, 40, 400) * 997 * lm.OUTCOMES + rng.integers(0, lm.OUTCOMES, 400))
    hist, out = np.divmod(key, lm.OUTCOMES)
    n = rng.integers(1, 9, len(key))
    weights = (rng.normal(size=(lm.FEATURES, lm.CLASSES)), rng.normal(size=(lm.INNER * lm.SUFFIXES, lm.SLOTS)))

    def fit():
        ll = (n * lm.class_logits(weights[0], hist)[np.arange(len(n)), lm.class_of(out)]).sum()
        k = out >= lm.OWN
        sfx, slot = np.divmod(out[k] - lm.OWN, lm.SLOTS)
        return ll + (n[k] * lm.slot_logits(weights[1], hist[k], sfx)[np.arange(k.sum()), slot]).sum()

    def counts(w):
        a, b = np.zeros(weights[0].shape, np.float32), np.zeros(weights[1].shape, np.float32)
        for part in np.array_split(np.arange(len(n)), 3):
            lm.count_events(hist[part], out[part], n[part], w, a, b)
        return a, b

    seen, want = counts(None), counts(weights)
    rows = [lm.feature_rows(hist[:1])[0].tolist(), lm.inner_rows(hist[-1:], (out[-1:] - lm.OWN) // lm.SLOTS)[0].tolist()]
    for k in range(2):
        for i in rows[k]:
            for j in (0, 5, weights[k].shape[1] - 1):
                old = weights[k][i, j]
                weights[k][i, j] = old + 1e-4
                up = fit()
                weights[k][i, j] = old - 1e-4
                down = fit()
                weights[k][i, j] = old
                assert (up - down) / 2e-4 == pytest.approx(seen[k][i, j] - want[k][i, j], abs=0.02)


def test_lm_rest_by_context(spark):
    """Tokens of a class's last slot are told apart by the context before them, whether their counts and weights are in the tasks' tables or joined."""
    from lorekeep.llm import maxent_lm as lm

    held = [d for d in range(9000) if zlib.crc32(str(d).encode()) % 10 == 0]
    train = [d for d in range(9000) if zlib.crc32(str(d).encode()) % 10]
    times = [6] * 250 + [2] * 150  # more words of one ending than contexts, own classes and slots can hold
    colour = lambda i, k: "red" if (i + k // 2) % 2 else "blue"
    texts = [f"{colour(i, k)} w{i}zz" for i, n in enumerate(times) for k in range(n)]
    c = Counter(texts)
    assert c["red w301zz"] == 2 and not c["red w300zz"]
    asked = [f"red w{i}zz" for i in range(250, 400)] + ["red w9999zz"]
    docs = spark.createDataFrame(list(zip(train, texts)) + list(zip(held, asked)), "doc_id long, text string")
    mass = (250 - (lm.OWN - 3) - (lm.SLOTS - 1)) * (6 + lm.ADD) + 150 * (2 + lm.ADD) + lm.ADD
    kept = lm.TOP, lm.PAIRS
    for lm.TOP, lm.PAIRS in (kept, (300, 0)):
        got = {r["doc_id"]: r["score"] for r in rows_of(lm.lm_scores(docs, rounds=2)) if r["held_out"]}
        score = {t: got[d] for d, t in zip(held, asked)}
        for t in asked[:-1]:
            want = np.log10((c[t] + lm.PRIOR * (2 + lm.ADD) / mass) / (lm.PRIOR * lm.ADD / mass))
            assert score[t] - score[asked[-1]] == pytest.approx(want, abs=1e-5), t
    lm.TOP, lm.PAIRS = kept


def test_lm_rest_is_a_distribution():
    from lorekeep.llm import maxent_lm as lm

    rng = np.random.default_rng(5)
    h, sfx, hist = rng.integers(-(2**62), 2**62, 500), np.full(500, 3), np.full(500, 9 * lm.CONTEXTS + 4)
    met, n = rng.integers(0, 40, 500) * (rng.random(500) < 0.5), rng.integers(40, 90, 500)
    mass = (n + lm.ADD).sum() + lm.ADD
    p = (n + lm.ADD) / mass
    seen = np.zeros((lm.CONTEXTS, lm.SUFFIXES))
    seen[4, 3] = met.sum()
    gain = np.log10(1 + met / (lm.PRIOR * p))
    key = lm.pair_keys(h, hist)
    assert (key != lm.pair_keys(h, hist + 1)).all()
    in_table = (met > 0) & (rng.random(500) < 0.7)
    third = lm.Rest(key[in_table], gain[in_table], seen)
    got, asked, have = third.parts(h, sfx, hist)
    assert (asked == key).all() and (have == in_table).all()
    unknown = lm.ADD / mass * 10 ** third.parts(np.array([7]), sfx[:1], hist[:1])[0][0]
    assert (p * 10 ** (got + np.where(have, 0, gain))).sum() + unknown == pytest.approx(1, abs=1e-6)
    none = lm.Rest(key[:0], gain[:0], np.zeros((lm.CONTEXTS, lm.SUFFIXES))).parts(h, sfx, hist)
    assert not none[0].any() and not none[2].any()


def test_lm_odd(spark, odd):
    from lorekeep.llm import maxent_lm

    got = rows_of(maxent_lm.lm_scores(odd, rounds=2))
    assert len(got) == odd.count() and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert maxent_lm.lm_scores(odd.limit(0), rounds=1).count() == 0


# ---- 10


def test_language(spark, sf):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in rows_of(docs_of(spark, sf))}
    got = rows_of(queries.op10_language_crf(spark, sf))
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]][0]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    right = [r for r in held if r["lang_pred"] == lang[r["doc_id"]][0]]
    assert len(right) >= 0.97 * len(held), len(right) / len(held)


def test_forward_backward():
    from itertools import product

    from lorekeep.llm import lang_crf

    rng = np.random.default_rng(4)
    z, t = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 4, 4, 5, 9])
    p, pairs = lang_crf.forward_backward(z, first, t, pairs=True)
    want, want_pairs = np.zeros_like(z), np.zeros((3, 3))
    for a, b in zip(first[:-1], first[1:]):
        paths = list(product(range(3), repeat=b - a))
        w = np.array([np.exp(sum(z[a + i, y] for i, y in enumerate(ys)) + sum(t[u, v] for u, v in zip(ys, ys[1:]))) for ys in paths])
        for ys, q in zip(paths, w / w.sum()):
            for i, y in enumerate(ys):
                want[a + i, y] += q
            for u, v in zip(ys, ys[1:]):
                want_pairs[u, v] += q
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_language_odd(spark, odd):
    from lorekeep.llm import lang_crf

    got = rows_of(lang_crf.identify(odd))
    assert len(got) == odd.count()
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (0, 1, 2, 12))
    assert lang_crf.accepted(odd).columns == odd.columns
    assert lang_crf.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in rows_of(lang_crf.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).filter("doc_id > 5").drop("lang").selectExpr("*", "cast(null as string) lang")))} == {"und"}


# ---- pipeline


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = docs_of(spark, sf)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, rows_of(docs))
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["language_id"]
    assert len(after) > 0.95 * len(before)
    before, after = seen["exact_dedup"]
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"])
    assert Counter(map(norm, after)) == Counter(set(map(norm, before)))
    before, after = seen["near_dedup"]
    want = {eval(c) for *_, c in brute_components(before, 5, 80)}
    assert {r["doc_id"] for r in after} == want | {r["doc_id"] for r in before if not WORD.search(r["text"])}
    before, after = seen["mix_sources"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["sentencepiece"]
    assert len(before) == len(after)
