"""Filters, scans, mixing, scoring and packing against brute force and exact round trips."""

import math
import random
import re
import weakref
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import xxhash
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import common, license_scan, lm_score, mixing, packing, quality, url_filter
from quillgraph.llm.url_filter import Rule


def slow_url(url, rules=url_filter.RULES):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "allow"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://A.example.COM/en/x?y", "https://www.example.com/en/", "http://example.com/en", "http://x.example.com/de/1#f", "http://e.net/fr/a",
        "http://e.net/frx", "http://net/es/", "http://notexample.com/en/", "http://ÄB.com/é", "http://a.com?x=/en/", "ftp://u:p@a.net:80/es/://b", "x" * 50_000, "http://a..com//"]


def test_url_filter_by_trie_and_by_join(spark, monkeypatch):
    rules = [*url_filter.RULES, Rule("block", "com", "/fo"), Rule("allow", "com", "/foo/bar"), Rule("block", "b.com", "/"), Rule("allow", "b.com", "/")]
    urls = URLS + ["http://q.com/foo/ba", "http://q.com/foo/barn", "http://q.com/f", "http://b.com/fo"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host int")
    for chosen in (url_filter.RULES, rules):
        want = [(i, *slow_url(u, chosen)) for i, u in enumerate(urls + urls[:3])]
        assert sorted(map(tuple, url_filter.url_filter(df, rules=chosen).collect())) == want
        with monkeypatch.context() as m:
            m.setattr(url_filter, "MAX_BROADCAST_RULES", 0)
            assert sorted(map(tuple, url_filter.url_filter(df, rules=chosen).collect())) == want
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_license_scan(spark):
    grant = "You may copy, change\nand share this work, provided that\ncopyright notices stay."
    known = [*license_scan.KNOWN, ("Own-1.0", grant)]
    texts = [None, "", "x\nRELEASED under the MIT Licence!\ny", "Copyright (c) 2020 A Person\n\n" + grant.upper().replace(",", " ,"), "Released under the MIT Licence, mostly.", "All rights reserved.\nall RIGHTS reserved\n© 2011 me",
             "Provided that\ncopyright notices stay", "Licensed under the Apache Licence, Version 2.0\n" + "long " * 50_000, grant.replace("\n", " ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "", "x")], "doc_id long, text string, lines string")
    got = sorted(map(tuple, license_scan.license_scan(df, known=known).collect()), key=lambda x: x[0])
    assert got == [(0, None, 0, ""), (1, None, 0, ""), (1, None, 0, ""), (2, None, 1, "MIT"), (3, "Own-1.0", 0, "Own-1.0"), (4, None, 0, ""), (5, None, 2, "Proprietary"), (6, None, 0, ""), (7, None, 1, "Apache-2.0"), (8, "Own-1.0", 1, "Own-1.0")]
    assert license_scan.license_scan(df.limit(0)).count() == 0
    # whole licences are known by digest alone
    first = spark.createDataFrame([("all rights reserved",)], "w string").selectExpr("sha2(w, 256)", "length(w)").first()
    only = license_scan.license_scan(df, known=[], digests=[("P", first[0], first[1])])
    assert only.where("licenses = 'P'").count() == 1


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, None: 0.2, "gone": 0.0}])
def test_mixing_keeps_to_the_weights(spark, weights):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None, "t") for i in range(900)] + [(5, "c", "t"), (5, "c", "t"), (None, "a", "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = mixing.schedule(df, weights, block=4, period=64).collect()
    assert sorted(map(str, (x["row"] for x in got))) == sorted(map(str, df.collect()))
    placed = [x for x in got if x["slot"] is not None]
    assert len({x["position"] for x in placed}) == len(placed)
    assert {x["source"] for x in placed} == ({"a", "b", "c", None} if weights is None else {"a", "b", None})
    assert all(x["release"] <= x["slot"] < x["deadline"] for x in placed)
    blocks = sorted({(x["slot"], x["source"]) for x in placed if x["in_mix"]}, key=lambda x: x[0])
    assert [s for s, _ in blocks] == list(range(len(blocks)))
    shares = Counter(x["source"] for x in {(x["source"], x["block"]): x for x in placed}.values() if x["slot"] < 64)
    done = Counter()
    for t, (_, s) in enumerate(blocks, 1):
        done[s] += 1
        for src, share in shares.items():
            assert abs(done[src] - t * share / 64) < 1
    mixed = mixing.mix(df, weights, block=4, period=64)
    assert mixed.columns == df.columns and mixed.count() == sum(x["in_mix"] for x in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_one_source_mixes_to_all_of_it(spark):
    df = spark.createDataFrame([(i, "only") for i in range(50)], "doc_id long, source string")
    assert mixing.mix(df).count() == 50


def test_mixing_targets_are_not_rounded_to_a_fixed_period(spark):
    df = spark.range(60_000).selectExpr("id AS doc_id", "concat('s', floor(log2(id % 65535 + 1))) AS source")
    weights = {f"s{k}": 2.0**k for k in range(16)}
    got = mixing.schedule(df, weights, block=4).groupBy("source", "block").agg({"slot": "min", "release": "max", "deadline": "min"}).collect()
    assert all(x["max(release)"] <= x["min(slot)"] < x["min(deadline)"] for x in got)
    slots = [(x["min(slot)"], x["source"]) for x in got]
    for end in (1024, 8192, 15_000):
        done = Counter(s for t, s in slots if t < end)
        left = {s for s, n in Counter(s for _, s in slots).items() if n > done[s]}  # of these none has run out
        assert left and all(abs(done[s] - end * weights[s] / 65535) < 2 for s in left)


def slow_schedule(weights, slots):
    """Earliest deadline first by exact fractions: the source of each slot, ties to the first by name."""
    w = {s: Fraction(x) / sum(map(Fraction, weights.values())) for s, x in sorted(weights.items())}
    done, out = dict.fromkeys(w, 0), []
    for t in range(slots):
        ready = [(math.ceil((done[s] + 1) / x), s) for s, x in w.items() if done[s] / x < t + 1 and math.floor(done[s] / x) <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


def test_mixing_is_the_schedule_by_exact_fractions(spark):
    weights = {"a": 0.3337, "b": 0.6663, "c": 0.25, "d": 1.0}
    df = spark.range(12_000).selectExpr("id AS doc_id", "element_at(array('a', 'b', 'c', 'd'), cast(id % 4 + 1 AS int)) AS source")
    got = mixing.schedule(df, weights, block=2).select("slot", "source", "in_mix").distinct().collect()
    order = [x["source"] for x in sorted(got, key=lambda x: x["slot"]) if x["in_mix"]]
    ticks = {s: round(w / sum(weights.values()) * mixing.TICKS) for s, w in weights.items()}
    assert len(order) > 3000 and order == slow_schedule(ticks, len(order))


def test_mixing_keeps_within_a_block_of_the_true_weights(spark):
    weights = {"a": 0.3337, "b": 0.6663}
    df = spark.range(160_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source")
    got = mixing.schedule(df, weights, block=1).select("slot", "source", "in_mix").collect()
    done = 0
    order = [x["source"] for x in sorted(got, key=lambda x: x["slot"]) if x["in_mix"]]
    assert len(order) > 100_000
    for t, s in enumerate(order, 1):
        done += s == "a"
        assert abs(done - t * 0.3337) < 1 + 1e-6


def test_mixing_goes_on_when_weights_are_far_from_the_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 100)
    df = spark.range(1000).selectExpr("id AS doc_id", "if(id < 900, 'many', 'few') AS source")
    got = mixing.schedule(df, {"many": 0.001, "few": 0.999}, block=2).collect()
    assert len({x["position"] for x in got}) == 1000 and len({x["slot"] for x in got}) == 500
    assert mixing.schedule(df, {"few": 1.0}).where("slot IS NOT NULL").count() == 100


def test_mixing_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 50)
    df = spark.range(10_000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source")
    got = mixing.schedule(df).select("source", "block").distinct()
    assert 50 <= got.count() <= 53


def test_mixing_takes_any_number_of_sources(spark):
    df = spark.range(1200).selectExpr("id AS doc_id", "concat('s', id % 400) AS source")
    got = mixing.schedule(df).collect()
    assert len(got) == 1200 and len({x["position"] for x in got}) == 1200 and all(x["release"] <= x["slot"] < x["deadline"] for x in got)


def slow_kneser_ney(texts, order, alphabet):
    """Textbook probabilities as a function of (context, symbol)."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = ["^"] * (order - 1) + list(t) + ["$"]
        for i in range(order - 1, len(s)):
            grams[order][tuple(s[i - order + 1 : i + 1])] += 1
    for o in range(order - 1, 0, -1):
        for g in grams[o + 1]:
            grams[o][g[1:]] += 1

    def discounts(o):
        n = [0] + [sum(c == k for c in grams[o].values()) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        out = []
        for k in (1, 2, 3):
            d = 0.5 if y is None or not n[k] else k - (k + 1) * y * n[k + 1] / n[k]
            out.append(min(max(d, 0.05), k))
        return out

    ds = [None] + [discounts(o) for o in range(1, order + 1)]

    def p(context, x, o):
        if o == 0:
            return 1 / (alphabet + 3)
        context = context[len(context) - (o - 1) :]
        inside = {g: c for g, c in grams[o].items() if g[:-1] == context}
        total = sum(inside.values())
        if not total:
            return p(context[1:], x, o - 1)
        cut = lambda c: min(ds[o][min(c, 3) - 1], c)
        c = inside.get((*context, x), 0)
        own = (c - cut(c)) / total if c else 0
        return own + sum(map(cut, inside.values())) / total * p(context[1:], x, o - 1)

    return lambda t: sum(math.log10(p(tuple((["^"] * (order - 1) + list(t))[i : i + order - 1]), x, order)) for i, x in enumerate([*t, "$"]))


def test_kneser_ney_matches_the_textbook(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abcde ") for _ in range(r.randint(5, 40))) for _ in range(25)]
    models, lut = quality.train(spark.createDataFrame([("x", t) for t in texts], "lang string, text string"), order=3)
    slow = slow_kneser_ney(texts, 3, quality.ALPHABET)
    for t in texts[:5] + ["", "zzz", "abcabc e"]:
        if "z" not in t:
            assert abs(models["x"].score(quality.coded(t, lut, 3)).sum() - slow(t)) < 1e-3
    fresh = "ab"  # probabilities of all that can follow add up to one
    codes = quality.coded(fresh, lut, 3)[-1]
    every = (codes & ~np.uint64(255)) | np.arange(1, 256, dtype=np.uint64)  # 0 is no symbol
    assert abs((10 ** models["x"].score(every)).sum() - 1) < 0.02


def test_quality_classifier(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "mats", "and", "dogs", "run"]) for _ in range(60))
    junk = lambda: "".join(r.choice("#$%&*xqzj0198{}") for _ in range(300))
    rows = [(i, good() if i % 4 else junk(), "en", "x") for i in range(400)] + [(500, None, "en", "x"), (501, "", "en", "x"), (502, "hei", None, "x"), (503, junk() * 3000, "en", "x"), (None, good(), "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    held = range(200, 400)
    assert all(got[i]["kept"] for i in (500, 501, 502, None)) and not got[503]["kept"] and got[502]["threshold"] is None
    assert sum(got[i]["kept"] == bool(i % 4) for i in held) >= 190
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x["kept"] for x in got.values())
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert all(x["kept"] for x in quality.classify(docs, labels.limit(0)).collect())


def test_keep_good_leaves_rows_in_their_partitions(spark):
    r = random.Random(3)
    text = lambda i: " ".join(r.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(40)) if i % 5 else "#$%&*xqzj{}" * 30
    docs = spark.createDataFrame([(i, text(i), "en") for i in range(200)], "doc_id long, text string, lang string").repartition(3, "doc_id")
    docs = common.materialise(docs.withColumn("part", F.spark_partition_id()))
    docs = docs.withColumn("part", F.spark_partition_id())
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables as large as they may get
    try:
        kept = quality.keep_good(docs, labels).withColumn("now", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {x["doc_id"] for x in kept} == {x["doc_id"] for x in quality.classify(docs, labels).collect() if x["kept"]}
    assert 100 < len(kept) < 200 and len({x["part"] for x in kept}) > 1 and all(x["part"] == x["now"] for x in kept)


def test_without_drops_just_the_rows_of_its_numbers(spark):
    rows = common.numbered(spark.range(0, 100_000, 1, 2)).withColumn("id", F.col("row.id"))
    for gone in ("id % 7 = 3", "id IN (0, 1, 7, 8, 32767, 32768, 49999, 50000, 99999)", "id < 0", "id >= 0"):
        left = common.without(rows, rows.where(gone).select("uid"))
        assert left.columns == rows.columns
        assert [x["id"] for x in left.orderBy("id").collect()] == [x["id"] for x in rows.where(f"NOT ({gone})").orderBy("id").collect()]


def test_a_worker_forgets_the_encoder_of_an_earlier_query():
    enc = packing.encoder(packing.tokenizer_path())
    assert packing.encoder(packing.tokenizer_path()) is enc
    gone = weakref.ref(enc)
    del enc
    common.forget()
    assert gone() is None


def test_quality_models_and_thresholds_come_from_all_trusted_texts(spark):
    r = random.Random(5)
    words = {"en": ["the", "cat", "sat", "on", "mats"], "fr": ["le", "chat", "est", "assis", "ici"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 30))), lang) for i, lang in enumerate(["en", "en", "fr"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), 0) for i in range(110)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(110) if i % 3 != 1}
    fold = {x["doc_id"]: x["f"] for x in docs.selectExpr("doc_id", "pmod(xxhash64(text), 2) AS f").collect()}
    plain = {}
    for lang in words:
        own = [(i, t) for i, t, x in rows if x == lang and i in trusted]
        for part in (None, 0, 1):
            plain[lang, part] = slow_kneser_ney([t for i, t in own if part is None or fold[i] == part], 5, quality.ALPHABET)
    one = {x["doc_id"]: x for x in quality.classify(docs, labels).collect()}
    assert len(one) == len(rows)
    for i, text, lang in rows:  # each by a model of all trusted texts, or of all in the half that it is not in
        assert abs(one[i]["log10_prob"] - plain[lang, 1 - fold[i] if i in trusted else None](text)) < 2e-3
    for lang in words:
        own = sorted(one[i]["perplexity"] for i, _, x in rows if x == lang and i in trusted)
        assert one[next(i for i, _, x in rows if x == lang)]["threshold"] == own[-1]
    many = {x["doc_id"]: x for x in quality.classify(docs, labels, grams=10).collect()}  # a pass for each language
    assert many == one
    named = quality.classify(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()
    assert {x["doc_id"]: x["log10_prob"] for x in named} == {f"d{i}": x["log10_prob"] for i, x in one.items()}


TEXTS = [None, "", " ", "a", "Hello  world\n\n x", "don't I'll 123abc,\x1c\x85\xa0  é!", "<|endoftext|> ok", "x" * 5000, "日本 語 " * 50]


def test_encoder_gives_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    r = random.Random(3)
    texts = [x or "" for x in TEXTS] + ["".join(r.choice("ab'st .,\n\t\r  1é 　-_\x0b\x1f") for _ in range(60)) for _ in range(300)]
    texts += ["".join(r.choice(["<|endoftext|>", " ", "a", "\n", "<|", "endoftext", "|>", " b", "\t"]) for _ in range(12)) for _ in range(300)]
    enc = packing.Encoder(packing.tokenizer_path())
    for x in texts:
        assert np.frombuffer(enc.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing_is_gapless_and_tight(spark):
    r = random.Random(4)
    texts = TEXTS + [" ".join(r.choice(["the", "of", "zebra", "Q"]) for _ in range(r.choice([3, 40, 400, 3000]))) for _ in range(120)]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(3, "a", 9), (None, "n", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    got = packing.pack_documents(df).collect()
    enc = packing.Encoder(packing.tokenizer_path())
    ids = lambda t: np.frombuffer(enc.ids(t or "") + b"\0\0\0\0", "<u4")
    want = []
    for i, t, _ in rows:
        x = ids(t)
        want += [(str(i), k, s, n, zlib.crc32(x[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.spans(len(x), 2048))]
    assert sorted((str(x["doc_id"]), x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(want)
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.06 * sum(w[3] for w in want) / 2048 + 2
    assert packing.pack_documents(df.limit(0)).count() == 0
    whole = packing.packed_sequences(df.where("doc_id < 30"))
    assert whole.where("size(ids) > 2048").count() == 0
    assert whole.selectExpr("sum(size(ids))").first()[0] == sum(len(ids(t)) for i, t, _ in rows if i is not None and i < 30)


def test_best_two_fit_places_everything():
    r = random.Random(5)
    for _ in range(20):
        counts = Counter(r.choice([1, 2, 7, 500, 900, 1024, 1025, 2048, r.randint(1, 2048)]) for _ in range(r.randint(1, 3000)))
        plan = packing.best_two_fit(counts, 2048)
        placed = Counter()
        for pattern, times in plan:
            assert sum(n * q for n, q in pattern.items()) <= 2048 and times > 0
            for n, q in pattern.items():
                placed[n] += q * times
        assert placed == counts


def test_attention_gradients_and_windows():
    model, r = lm_score.Attention(), np.random.default_rng(0)
    keys, targets, place = lm_score.windows(r.integers(0, 1000, 41), np.array([13, 1, 27]))
    assert (targets.ravel()[place] >= 0).all() and (targets >= 0).sum() == 41  # each token is scored once
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    g = model._gradients(keys, targets)
    for name in ("e", "q", "k", "v", "x", "o", "c", "n"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for h in (1e-5, -1e-5):
            model.w[name][i] += h
            model.tables = None
            losses.append(-model.logp(keys, targets).sum() / 41)
            model.w[name][i] -= h
        model.tables = None
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][i]) < 1e-5
    # causal: what comes later changes nothing before
    tokens = r.integers(0, 1000, 40)
    other = tokens.copy()
    other[25:] = 5
    a, b = (model.logp(*lm_score.windows(t, np.array([40]))[:2]).ravel()[lm_score.windows(t, np.array([40]))[2]] for t in (tokens, other))
    assert np.allclose(a[:25], b[:25])


def test_lm_score_is_the_same_whichever_words_are_broadcast(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, " ".join("word" + str(int(r.paretovariate(0.5))) for _ in range(40))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for most in (6, 65_536):
        monkeypatch.setattr(lm_score.common_words, "__defaults__", (most,))
        scores.append({x["doc_id"]: x["score"] for x in lm_score.lm_score(docs, steps=50).collect()})
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][i] - scores[1][i]) < 1e-3 for i in scores[0])


def test_lm_slots_come_from_all_training_documents(spark, monkeypatch):
    made, fit = [], lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda *x: made.append(fit(*x)) or made[-1])
    docs = spark.createDataFrame([(i, f"{w} " * 9) for i, w in enumerate(["cat", "dog", "home", "green", "seven", "water"] * 20)], "doc_id long, text string")
    lm_score.lm_score(docs, steps=5, sample_chars=100)
    lexicon = made[0].lexicon
    assert {u for w in ("cat", "dog", "home", "green", "seven", "water") for u in lexicon.units(w)} <= lexicon.slots.keys()


def test_lm_scores_match_brute_force_counts_and_beat_them(spark, monkeypatch):
    monkeypatch.setattr(lm_score.common_words, "__defaults__", (6,))
    r = random.Random(6)
    words = ["The", "small", "cat", "dog", "ran", "home", "again", "and", "Slept"]
    rows = [(i, " ".join(r.choice(words[k % 3 * 3 : k % 3 * 3 + 3]) for k in range(r.randint(3, 60))), 0) for i in range(150)]
    rows += [(200, None, 0), (201, " \t\n", 0), (202, "unseen words only", 0), (203, "cat " * 20_000, 0), (None, "cat", 0), (7, "cat", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = lm_score.lm_score(docs, steps=150).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    bag = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    c = Counter(w for i, t, _ in rows if not held(i) for w in bag(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(bag(t)), sum(c[w] > 0 for w in bag(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in bag(t)), 3)) for i, t, _ in rows)
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 3)) for x in got) == want
    mine, base = (sum(x[k] for x in got if x["held_out"]) for k in ("score", "base_score"))
    assert mine > base and all(np.isfinite(x["score"]) for x in got)
    assert lm_score.lm_score(docs.limit(0)).count() == 0


def slow_scores(rows, scorer, path, n):
    """log10 probabilities word by word and token by token, in plain loops over the same weights and mixture."""
    w, lex = {k: v.astype(np.float64) for k, v in scorer.model.w.items()}, scorer.lexicon
    before, block, mask64 = lm_score.BEFORE, lm_score.BLOCK, (1 << 64) - 1
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    bag = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), ""]
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    counts = Counter(x for i, t in rows if not held(i) for x in bag(t))

    def spelled(words):
        units = [[lex.slots.get(u, lm_score.TAIL) for u in lex.units(x)] for x in words]
        tokens = [u for x in units for u in x]
        inputs, out = [lm_score.BOS, *tokens], []
        for at, y in enumerate(tokens):
            first = at // block * block - before
            x = [w["e"][inputs[j]] + w["p"][j - first] for j in range(max(0, first), at + 1)]
            a = softmax(np.array([x[-1] @ w["q"] @ (z @ w["k"]) / lm_score.DIM**0.5 for z in x]))
            h = np.maximum(x[-1] @ w["x"] + sum(p * (z @ w["v"]) for p, z in zip(a, x)) @ w["o"] + w["b"], 0)
            c, r = divmod(y, lm_score.MEMBERS)
            out.append(math.log(softmax(h @ w["c"] + w["cb"])[c] * softmax(h @ w["n"][c] + w["nb"][c])[r]))
        seen, total = lex.tail
        sums = []
        for x, u in zip(words, units):
            rare = sum(math.log((seen.get(z, 0) + 1) / (total + 2 * 50_257 + 1)) for z in lex.units(x) if z not in lex.slots)
            sums.append(sum(out.pop(0) for _ in u) + rare)
        return sums

    def cut(words):
        """(number of its first word, the words before, the passage)"""
        begin = []
        for i in range(6, len(words)):
            b = sum(xxhash.xxh64_intdigest(words[i - k], 42) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 7)) & mask64
            b = ((b ^ (b >> 31)) * 0xD6E8FEB86659FD93) & mask64
            if (b ^ (b >> 32)) % lm_score.ANCHOR == 0:
                begin.append(i)
        return [(a, tuple(words[a - 6 : a]), tuple(words[a:b])) for a, b in zip(begin, [*begin[1:], len(words)])]

    memory = [(held(i), cut(bag(t))) for i, t in rows]
    scores, met = [], 0
    for at, (i, t) in enumerate(rows):
        words = bag(t)
        p = [math.log(scorer.weight * counts[x] / n + (1 - scorer.weight) * math.exp(q)) for x, q in zip(words, spelled(words))]
        total = sum(p)
        for a, ahead, passage in memory[at][1]:
            others = [(x, y) for k, (h, cuts) in enumerate(memory) if k != at and not h for _, x, y in cuts if x == ahead]
            if others:
                met += 1
                by_word = sum(p[a : a + len(passage)])
                total += math.log((sum(y == passage for _, y in others) + math.exp(by_word)) / (len(others) + 1)) - by_word
        scores.append(total / math.log(10))
    return scores, met


def test_lm_scores_match_a_plain_loop(spark, monkeypatch):
    made, fit = [], lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda *x: made.append(fit(*x)) or made[-1])
    monkeypatch.setattr(lm_score.common_words, "__defaults__", (20,))
    r = random.Random(8)
    text = lambda k: " ".join("ABCDEFGH"[int(r.paretovariate(0.4)) % 8] + "word" * (int(r.paretovariate(0.7)) % 3) + str(int(r.paretovariate(0.5)) % 300) for _ in range(k))
    copied = [text(90), text(120)]
    rows = [(i, text(r.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, copied[i % 2] + (" and another end" if i % 3 == 0 else "")) for i in range(8)] + [(7, None), (None, "x\u00e9\x1c y " * 40), (300, "same " * 50), (301, "same " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_score.lm_score(docs, steps=30).collect()
    want, met = slow_scores(rows, made[0], None, got[0]["train_tokens"])
    assert met > 15
    assert np.allclose(sorted(x["score"] for x in got), sorted(want), atol=2e-3, rtol=1e-4)
    once = [x["score"] / x["n_tokens"] for x in got if x["doc_id"] is not None and x["doc_id"] < 40 and x["n_tokens"] > 20]
    assert min(x["score"] / x["n_tokens"] for x in got if x["doc_id"] and 100 <= x["doc_id"] < 108) > max(once)


def test_lm_sample_is_bounded_whatever_one_text_holds(spark):
    docs = spark.createDataFrame([(i, "word " * (2 if i % 9 else 4000)) for i in range(300)], "doc_id long, text string")
    sizes = docs.selectExpr("xxhash64(doc_id) AS h", "length(text) + 1 AS n")
    sample = lm_score.sample_texts(docs, sizes, 900)
    assert sample and sum(len(x) + 1 for x in sample) <= 900
    assert lm_score.sample_texts(docs.limit(0), sizes.limit(0), 900) == []


def test_lexicon_encodes_words_all_at_once(monkeypatch):
    import tiktoken

    calls, encode = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or encode(self, text))
    r = random.Random(3)
    parts = ["a", "b's", "'s", "'", "1", "23", "the", "-", "...", "\u00e9", "\u4e2d", "\u0301", "\u0130", "\u200b", "\ufeff", "\x00", "\U0001f600"]
    spaces = ["\u00a0", "\u3000", "\u2003", "\x85", "\x1c"]
    word = lambda of: "".join(r.choice(of) for _ in range(r.randint(1, 5)))
    plain, odd = sorted({word(parts) for _ in range(3000)}), sorted(w for w in {word(parts[:4] + spaces) for _ in range(300)} if w.split() != [w])
    words = plain + [*odd, lm_score.END]
    r.shuffle(words)
    slots = {u: u % lm_score.TAIL for u in range(2 * 50_257 + 1)}
    lex = lm_score.Lexicon(lm_score.tokenizer_path(), slots, ({}, 0), lm_score.Counts(lm_score.word_hashes(words[:5]), np.arange(1, 6)))
    at = lex.numbers(words)
    assert len(calls) <= len(odd) + 1 < len(words) // 2
    units = [lex.units(w) for w in words]
    assert lex.size[at].tolist() == [*map(len, units)] and lex.tokens(at).tolist() == [slots[u] for x in units for u in x]
    assert lex.count[at].tolist() == [1, 2, 3, 4, 5] + [-1] * (len(words) - 5)
    assert lex.numbers(words[7:3:-1]).tolist() == [7, 6, 5, 4]  # known by now


@pytest.mark.parametrize("shift", [0.0, 200.0, -200.0])
def test_log_softmax_of_any_logits(shift):
    r = np.random.default_rng(2)
    z, i = (r.standard_normal((50, lm_score.MEMBERS)) * 3 + shift).astype(np.float32), r.integers(0, lm_score.MEMBERS, 50).astype(np.uint16)
    log_softmax = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    want = [log_softmax(x)[k] for x, k in zip(z.astype(np.float64), i)]
    assert np.allclose(lm_score._pick(z, i), want, atol=1e-4)


def test_lexicon_keeps_the_common_words():
    counts = {f"w{i}": 3 * i for i in range(1500, 3000)}
    lex = lm_score.Lexicon(lm_score.tokenizer_path(), {}, ({}, 0), lm_score.Counts(lm_score.word_hashes([*counts]), np.array([*counts.values()])))
    words = [f"w{i}" for i in range(3000)]
    tokens = lex.tokens(lex.numbers(words)[1500:])
    lex.trim()
    assert len(lex) == lex.n == 1500 and (lex.tokens(lex.numbers(words[1500:])) == tokens).all()
    assert all(lex.count[lex[w]] == c for w, c in counts.items())
    assert lex.numbers(["w1", "w1500"]).tolist() == [1500, 0] and lex.count[1500] == -1
