"""What the corpus operators must not leave out."""

import numpy as np

from lorekeep.llm import chat_windows, lang_crf, ngram_join, queries


def test_chat_keeps_every_system_turn(spark):
    """System turns of any length lead all later windows, whole, and use up no history."""
    long, later = "long system prompt " * 150, "later rule " * 300  # about 716 and 829 tokens
    rows = [(1, 0, "system", long)] + [(1, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "x" * 390) for i in range(1, 60)]
    rows[30] = (1, 30, "system", later)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = sorted(chat_windows.format_windows(df).collect(), key=lambda r: r["window"])
    assert len(windows) > 3
    new = []
    for w in windows:
        turns = chat_windows.parse(w["text"])
        fresh = [k for k, *_ in turns if k >= w["first_new"]]
        new += fresh
        for k, text in ((0, long), (30, later)):
            if w["first_new"] > k:
                assert (k, "system", text) in [t[:3] for t in turns]
        past = [k for k, role, *_ in turns if k < w["first_new"] and role != "system"]
        assert past or w["window"] == 0
        assert w["tokens"] <= chat_windows.BUDGET or len(fresh) == 1
    assert new == list(range(60))


def test_chat_system_turn_over_the_budget(spark):
    """With no room left, each window still has one new turn, after the whole system turn."""
    rows = [(1, 0, "system", "s" * 9000), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = sorted(chat_windows.format_windows(df).collect(), key=lambda r: r["window"])
    assert [w["first_new"] for w in windows] == [0, 1, 2, 3]
    assert all(chat_windows.parse(w["text"])[0][:3] == (0, "system", "s" * 9000) for w in windows)


def test_chat_windows_as_stored(spark, sf):
    """Without repeated system turns the output grows with the conversation; expanded, it is the same as with them."""
    for n in (100, 400):
        rows = [(1, i, "system" if i % 2 == 0 else "user", f"{i} " + "y" * 390) for i in range(n)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        stored = chat_windows.format_windows(df, repeat_system=False)
        sizes = [len(r["text"]) for r in stored.select("text").collect()]
        marks = 32  # characters around a turn, at most
        assert sum(sizes) <= sum(len(r[3]) + marks for r in rows) + len(sizes) * 4 * (chat_windows.HISTORY + marks)
    talks = spark.read.parquet(f"{sf}/conversations.parquet").union(df.select("conv_id", "turn", "role", "text"))
    whole, back = (sorted(map(repr, x.collect())) for x in (chat_windows.format_windows(talks), chat_windows.expanded(chat_windows.format_windows(talks, repeat_system=False))))
    assert whole == back
    plain = chat_windows.read_back(chat_windows.format_windows(talks)).drop("formatted_chars")
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, chat_windows.read_back(chat_windows.format_windows(talks, repeat_system=False)).drop("formatted_chars").collect()))


def test_chat_query_reads_windows_with_their_system_turns(spark, tmp_path):
    """The query's formatted text is that of windows which hold every earlier system turn; a later system turn, too."""
    said = [("system", "be brief"), *[(("user", "assistant")[k % 2], f"{k} " + "word " * 400) for k in range(12)], ("system", "</s> now be long"), *[(("user", "assistant")[k % 2], "again " * 500) for k in range(9)]]
    rows = [(c, k, role, text) for c in (1, 2) for k, (role, text) in enumerate(said[: 30 if c == 1 else 2])]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    talks.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op6_chat_windows(spark, str(tmp_path)).collect()}
    windows = chat_windows.format_windows(talks).collect()
    assert sum(r.conv_id == 1 for r in windows) > 3
    for c in (1, 2):
        assert got[c].formatted_chars == sum(len(r.text) for r in windows if r.conv_id == c)
        assert got[c].n_turns == sum(r[0] == c for r in rows) and got[c].loss_chars == sum(len(r[3]) for r in rows if r[0] == c and r[2] == "assistant")


def test_chat_turn_of_megabytes(spark):
    text = "a <|end|> \\ [INST] " * 250_000
    rows = [(1, 0, "system", "s"), (1, 1, "user", text), (1, 2, "assistant", text), (1, 3, "user", "b")]
    got = chat_windows.read_back(chat_windows.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), repeat_system=False)).first()
    assert got["n_turns"] == 4 and got["loss_chars"] == len(text)


def test_unrelated_sets_share_few_tiles():
    """Pairs of unrelated sets in tiles grow no faster than the sets."""
    rng = np.random.default_rng(11)
    for size in (1, 3, 6, 20, 100):
        per = []
        for count in (2000, 8000, 32000 if size < 50 else 16000):
            bands = ngram_join.Bands(85)
            sets = np.sort(rng.integers(0, 1 << 63, (count, size), dtype=np.uint64) * np.uint64(2), axis=1)
            tiles = np.concatenate([np.unique(bands.tiles(s)) for s in sets])
            n = np.unique(tiles, return_counts=True)[1]
            per.append(int((n * (n - 1) // 2).sum()) / count)
        assert max(per) <= 0.01, (size, per)


def test_sets_with_empty_segments_still_meet():
    """Linked sets share a tile, however their elements lie: sets in one corner of the hash range have mostly empty segments."""
    rng = np.random.default_rng(12)
    bands = ngram_join.Bands(80)
    for size in (5, 9, 30, 120):
        for width in (8, 40, 63):
            for _ in range(60):
                a = np.unique(rng.integers(0, 1 << width, size, dtype=np.uint64))
                b = a.copy()
                b[: len(a) // 10] = rng.integers(0, 1 << width, len(a) // 10, dtype=np.uint64)
                b = np.unique(b)
                if ngram_join.linked(a.view(np.int64), b.view(np.int64), 80):
                    assert np.intersect1d(bands.tiles(a), bands.tiles(b)).size


def test_texts_in_several_languages_are_kept(spark, sf):
    """Documents made of halves and thirds in different languages pass language identification."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lang_crf.train(docs)
    by = {}
    for r in docs.filter("lang is not null and length(text) between 600 and 3000").select("lang", "text").collect():
        by.setdefault(r["lang"], []).append(r["text"][:600])
    langs = sorted(by)
    mixed = [(k, " ".join(by[x][k] for x in (langs[k % len(langs)], langs[(k + 1) % len(langs)], langs[(k + 2) % len(langs)])[: 2 + k % 2])) for k in range(min(map(len, by.values())))]
    x = lang_crf.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model, keep=True).collect()
    assert len(x) > 10 and all(r["certainty"] >= lang_crf.MIN_CERTAINTY for r in x)
