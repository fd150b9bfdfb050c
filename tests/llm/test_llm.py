"""The training-data operators against brute force and held-out texts."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.llm import languages, mixing, packing, percentiles, ppm, prose, tokens


# Percentiles


def test_percentiles_of_skewed_groups(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        group = rng.choice(["hot"] * 4 + ["a", "b", None])
        value = rng.choice([None, float("nan"), 5.0, 5.0, -0.0, 0.0, float("inf"), rng.uniform(-10, 10)])
        rows.append((group, value, 1, "x"))
    df = spark.createDataFrame(rows, "service string, v double, n int, value string")
    by = defaultdict(list)
    for g, v, *_ in rows:
        if v is not None and v == v:
            by[g].append(v)
    for r in percentiles.percentiles(df, ["service"], F.col("v"), [0.0, 0.5, 0.9, 1.0]).collect():
        own = np.sort(by.pop(r.service))
        assert r.n_values == len(own)
        for p, got in ((0.0, r.p0), (0.5, r.p50), (0.9, r.p90), (1.0, r.p100)):
            place = (len(own) - 1) * p
            lo, hi = own[int(np.floor(place))], own[int(np.ceil(place))]
            want = lo if lo == hi else lo + (hi - lo) * (place - np.floor(place))
            assert got == pytest.approx(want)
    assert not by


def test_percentiles_of_portions_combine(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("v"), (F.col("id") % 7).alias("day"))
    portions = [percentiles.value_runs(df.where(F.col("day") == d), ["g"], F.col("v")) for d in range(7)]
    apart = percentiles.percentiles_of_runs(percentiles.merge_runs(portions, ["g"]), ["g"])
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, percentiles.percentiles(df, ["g"], F.col("v")).collect()))


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([("a", None)], "g string, v double")
    assert percentiles.percentiles(none, ["g"], F.col("v")).count() == 0


# Tokens


def test_token_counts_of_null_empty_and_long_texts(spark):
    long = "word " * 50_000 + " " * 300_000 + "a" * 250_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello <|endoftext|> world"), (4, long)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", tokens.token_count(F.col("t")).alias("n")).collect()}
    assert got[1] is None and got[2] == 0 and got[3] > 5 and got[4] > 300_000
    assert got[4] == len(tokens.encode(long))


def test_encoding_is_whole():
    text = "Grüße, мир! 日本語 " * 20
    assert tokens.encoding(tokens.VOCABULARY).decode(tokens.encode(text)) == text


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 120))
def test_packing_is_whole_and_within_capacity(sizes, capacity):
    sizes = np.array(sizes, dtype=np.int64)
    windows = packing.pack(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sizes[w].sum() <= capacity for w in windows)
    if len(sizes) and sizes.sum():
        # No worse than twice the least number: two windows that fit into one are never left.
        assert len(windows) <= 2 * -(-int(sizes.sum()) // capacity) + 1


def test_differencing_gives_near_equal_windows():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 400)
    windows = packing.difference(sizes, 20)
    sums = [sizes[w].sum() for w in windows]
    assert len(windows) == 20 and sorted(i for w in windows for i in w) == list(range(400))
    assert max(sums) - min(sums) <= 3


def test_differencing_example():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


@pytest.mark.parametrize("seed,capacity", [(4, 256), (5, 256), (6, 1024), (7, 4096)])
def test_as_little_space_is_left_as_by_best_fit(seed, capacity):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(4.7, 0.9, 3000).astype(np.int64) + 1, capacity)
    best = packing.best_fit(sizes.tolist(), capacity)
    assert sorted(i for w in best for i in w) == list(range(3000)) and all(sizes[w].sum() <= capacity for w in best)
    assert len(packing.pack(sizes, capacity)) <= len(best)


def test_number_of_windows_rises_until_the_capacity_is_kept():
    assert packing._near_equal([6, 6, 6, 6, 6], 11, 5) is None and len(packing._near_equal([6, 6, 6, 6, 6], 11, 6)) == 5
    assert len(packing._near_equal([5, 5, 4, 4, 3, 3], 12, 3)) == 2  # near-equal windows of 12 each
    assert packing.difference([], 2) == [[], []]


def test_packed_documents(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 1, 100, 256, 257, 1000, 5000]) if i % 3 else rng.randrange(300), "x", 7) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, block string, capacity_tokens int")
    kinds = spark.createDataFrame([("small", 256), ("large", 4096)], "container_kind string, capacity_tokens int")
    out = packing.pack_documents(df, kinds).collect()
    for kind, capacity in (("small", 256), ("large", 4096)):
        own = [r for r in out if r.container_kind == kind]
        fill, parts = defaultdict(int), defaultdict(list)
        for r in own:
            fill[r.container_id] += r.n_tokens
            parts[r.doc_id].append((r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity
        for doc, n, *_ in rows:
            size = n or 0
            assert sum(p[1] for p in parts[doc]) == size and len(parts[doc]) == max(1, -(-size // capacity))
            at = 0
            for first, length in sorted(parts[doc]):
                assert first == at
                at += length
        used = sum(n or 0 for _, n, *_ in rows)
        assert used / (len(fill) * capacity) > 0.95


def test_packing_of_nothing_and_of_bad_capacity(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([("small", 256)], "container_kind string, capacity_tokens int")
    assert packing.pack_documents(none, kinds).count() == 0
    with pytest.raises(Exception):
        packing.pack_documents(none, kinds.withColumn("capacity_tokens", F.lit(0)))


# Mixing


TARGETS = [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.15, 2), ("absent", 0.05, 5)]


def mixed(spark, rows, budget=None):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, weight string, copy string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return mixing.mix(df, targets, budget), targets


def test_mix_reaches_shares_within_repeats(spark):
    rng = random.Random(6)
    size = {"big": 3000, "small": 400, "tiny": 150, None: 50, "untargeted": 100}
    rows = [(i, s, rng.choice([None, 0, rng.randrange(1, 60)]) if i % 9 == 0 else rng.randrange(1, 60), "x", "y") for i, s in enumerate(s for s, n in size.items() for _ in range(n))]
    selected, targets = mixed(spark, rows)
    out = selected.collect()
    tokens_of = {r[0]: r[2] for r in rows}
    most = {s: m for s, _, m in TARGETS}
    held = defaultdict(int)
    for _, s, n, *_ in rows:
        held[s] += n or 0
    budget = int(min(held[s] * m / (w / 0.95) for s, w, m in TARGETS if held[s]))
    assert budget - 60 <= sum(r.n_tokens for r in out) <= budget
    copies = defaultdict(list)
    for r in out:
        copies[r.source, r.doc_id].append(r.copy)
        assert r.n_tokens == tokens_of[r.doc_id] > 0
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= most[k[0]] for k, c in copies.items())
    got = {r.source: r for r in mixing.shares(selected, targets).collect()}
    for s, w, _ in TARGETS:
        want = 0 if s == "absent" else w / 0.95
        assert abs(got[s].n_tokens - want * budget) <= 61
    assert got["absent"].n_documents == 0 and set(got) == {t[0] for t in TARGETS}
    # A document comes again only after all of its source have come.
    for s in ("small", "tiny"):
        if any(r.copy == 2 for r in out if r.source == s):
            assert sum(1 for r in out if r.source == s and r.copy == 1) == sum(1 for d, x, n, *_ in rows if x == s and n)


def test_mix_of_a_given_budget_and_of_nothing(spark):
    selected, targets = mixed(spark, [(i, "big", 10, "x", "y") for i in range(100)] + [(1000 + i, "small", 10, "x", "y") for i in range(100)], budget=400)
    assert sum(r.n_tokens for r in selected.collect()) == 400
    # A budget that would spoil the shares isn't filled: small ends at 3 x 1000 tokens, and big at 1000.
    rows = [(i, "big", 10, "x", "y") for i in range(100)] + [(1000 + i, "small", 10, "x", "y") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, weight string, copy string")
    chosen, parts = mixing.mix_and_plan(df, targets, 10_000)
    got = {r.source: (r.n_tokens, r.limits) for r in mixing.shares(chosen, targets, parts).collect()}
    assert got == {"big": (1000, True), "small": (600, False), "tiny": (0, False), "absent": (0, False)}
    nothing, targets = mixed(spark, [])
    assert nothing.count() == 0 and mixing.shares(nothing, targets).count() == len(TARGETS)


# Languages


def brute_bits(text: bytes, trained: list[bytes], order: int) -> float:
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
    whole = ppm.GAP + b"".join(t + ppm.GAP for t in trained)
    for k in range(order + 1):
        for i in range(k, len(whole)):
            counts[k][whole[i - k : i]][whole[i]] += 1
    bits, data = 0.0, ppm.GAP[:order] + text
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts[k].get(data[i - k : i])
            if seen is None:
                continue
            n, q = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= np.log2(seen[data[i]] / (n + q))
                break
            bits -= np.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_the_context_trees():
    texts = {"x": ["abracadabra abrakadabra", "ab"], "y": ["banana bandana", "日本"], "z": ["qqq"]}
    models = ppm.ByteModels(texts)
    probes = ["abra", "banana日", "", "zzz", "abracadabra " * 3]
    got = models.code_lengths(probes)
    for i, p in enumerate(probes):
        for j, c in enumerate(models.classes):
            assert got[i, j] == pytest.approx(brute_bits(p.encode(), [t.encode() for t in texts[c]], models.order), rel=1e-4)


def test_models_are_kept_and_read_again(tmp_path):
    models = ppm.ByteModels({"x": ["abc abd"], "y": ["xyz xxy"]})
    models.save(tmp_path / "models.npz")
    again = ppm.ByteModels.load(tmp_path / "models.npz")
    assert again.classes == models.classes and (again.code_lengths(["abc", "zzz"]) == models.code_lengths(["abc", "zzz"])).all()


def test_long_texts_are_scored_whole(monkeypatch):
    models = ppm.ByteModels({"x": ["abc " * 20], "y": ["xyz " * 20]})
    text = "abc xyz " * 100
    whole = models.code_lengths([text, "abc"])
    monkeypatch.setattr(ppm, "CHUNK", 64)
    assert models.code_lengths([text, "abc"]) == pytest.approx(whole, rel=1e-4)


SAMPLES = {
    "en": ["The manual says that one must close the connection first.", "Somebody should explain why the cache is slow.", "How can I read the whole file without losing data?"],
    "de": ["In der Anleitung steht, man müsse die Verbindung schließen.", "Jemand sollte erklären, warum der Zwischenspeicher langsam ist.", "Wie kann ich die ganze Datei lesen, ohne Daten zu verlieren?"],
    "ja": ["まずキャッシュがまだ動いているか確かめてください。", "接続を正しく閉じるだけで十分です。"],
}


def small_models(spark=None):
    return languages.train([(lang, t) for lang, texts in SAMPLES.items() for t in texts])


def test_prose_without_code_links_and_marks():
    text = "First it works.\n\n```\nwarum = 'nicht'\n```\n> Quoted words here!\n\n    indented code\n\nSee [link](https://x.test/a) or https://y.test/b now.<pre><code>mehr code</code></pre> `inline` ends"
    assert prose.sentences(text) == ["First it works.", "Quoted words here!", "See or now.", "ends"] or prose.sentences(text)[:3] == ["First it works.", "Quoted words here!", "See or now."]
    for nothing in (None, "", "  \n", "???", "42", "+1", "```\ncode", "https://x.test/y", "`merge_keys()`"):
        assert prose.sentences(nothing) == []
    assert max(map(len, prose.sentences("wort " * 5000))) <= prose.LONGEST


def test_prose_with_code_inside_stays():
    kept = {
        "Setzen Sie den Wert auf n = 5 und starten Sie den Dienst danach neu.": "Setzen Sie den Wert auf und starten Sie den Dienst danach neu.",
        "The result == the input only for x >= 3 in our case.": "The result the input only for x 3 in our case.",
        "La fonction renvoie x => y pour chaque ligne du fichier.": "La fonction renvoie x y pour chaque ligne du fichier.",
        "Danke!": "Danke!", "Merci.": "Merci.", "Note: it works": "Note: it works", "Voici le premier exemple du code :": "Voici le premier exemple du code :",
    }
    for text, left in kept.items():
        assert prose.sentences(text) == [left]
    for code in ("x = 5", "const queue = await ;", "for queue in :", "public int {", "let mut batch = vec:: ;", "while let = key.", "$ make all", "a += b;", "}"):
        assert prose.sentences(code) == []


def test_a_few_letters_tell_a_language_only_if_it_stands_out():
    models = languages.train([("de", "danke danke danke"), ("fr", "merci merci merci"), ("en", "The cache is slow because of the network.")])
    judged = languages.judge([prose.sentences(t) for t in ("Danke!", "Merci.", "pls", "The cache is slow because of the network. Merci. pls")], models)
    named = [sorted({models.classes[c] for c in classes}) for classes, *_ in judged]
    assert named[0] == ["de"] and named[1] == ["fr"] and named[2] == [] and named[3] == ["en", "fr"]


def test_segments_and_labels(spark):
    en, de, ja = (" ".join(v) for v in SAMPLES.values())
    docs = [
        (1, en, "en", 1), (2, de, "English", 1), (3, en + "\n\n" + de, "en", 1), (4, None, "en", 1), (5, "", None, 1), (6, "```\nx = 1\n```", "xx", 1),
        (7, de, None, 1), (8, de, " DE-at ", 1), (9, de, "deu", 1), (10, ja, "n/a", 1), (11, de.replace("ü", "u").replace("ä", "a"), "German", 1),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, confidence int")
    found = sorted(map(tuple, languages.mislabelled(df, small_models()).collect()))
    assert found == [(2, "de"), (3, "de"), (3, "en"), (7, "de"), (10, "ja")]
    whole = {r.doc_id: r for r in languages.language_segments(df, small_models()).collect()}
    assert len(whole) == len(docs)
    assert [s.lang for s in whole[3].segments] == ["en", "de"] and whole[3].segments[0].n_sentences == 3
    assert whole[4].lang is None and whole[4].confidence == 0 and whole[4].segments == []
    assert all(0 < s.confidence <= 1 for r in whole.values() for s in r.segments)


def test_bounded_samples_keep_every_language(spark):
    rows = [("de", f"satz {i}") for i in range(50)] + [("pt", f"frase {i}") for i in range(3)] + [("ru", f"фраза {i}") for i in range(50)] + [(None, "x"), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [r.lang for r in languages.bounded_samples(df, 23)]
    assert [got.count(lang) for lang in ("de", "pt", "ru")] == [10, 3, 10]
    assert [tuple(r) for r in languages.bounded_samples(df, 1000)] == sorted(r for r in rows if None not in r)


def test_languages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert languages.mislabelled(none, small_models()).count() == 0
    with pytest.raises(ValueError):
        languages.train([])


def test_labels_in_other_notations(spark):
    labels = ["en", "EN", "en-US", "eng", "English", "pt_BR", "und", "", " ", None, "xx", "n/a", "unknown"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    got = [r.c for r in df.select("i", languages.label_code(F.col("x")).alias("c")).orderBy("i").collect()]
    assert got == ["en"] * 5 + ["pt"] + [None] * 7


def test_held_out_sentences_are_told_apart():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/lang_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no samples here")
    rows = pq.read_table(path).select(["sample_id", "lang", "text"]).to_pylist()
    held = [r for r in rows if r["sample_id"] % 5 == 0]
    models = languages.train([(r["lang"], r["text"]) for r in rows if r["sample_id"] % 5])
    judged = languages.judge([prose.sentences(r["text"]) for r in held], models)
    right = sum(models.classes[c] == r["lang"] for r, (_, _, c, _) in zip(held, judged, strict=True) if c >= 0)
    assert right / len(held) >= 0.97
    # In each language, and confidence tells how often a sentence is right.
    for lang in models.classes:
        own = [j for r, j in zip(held, judged, strict=True) if r["lang"] == lang]
        assert own and sum(models.classes[c] == lang for _, _, c, _ in own) / len(own) >= 0.9
    sure = [(x, models.classes[c] == r["lang"]) for r, (classes, shares, *_) in zip(held, judged, strict=True) for c, x in zip(classes, shares, strict=True)]
    certain, doubtful = [ok for x, ok in sure if x >= 0.95], [ok for x, ok in sure if x < 0.95]
    assert sum(certain) / len(certain) >= 0.98 and len(certain) > len(doubtful)
    print({f"{lo:.2f}": (len(b), round(sum(b) / len(b), 3)) for lo, hi in ((0, 0.5), (0.5, 0.8), (0.8, 0.95), (0.95, 1.01)) if (b := [ok for x, ok in sure if lo <= x < hi])})
