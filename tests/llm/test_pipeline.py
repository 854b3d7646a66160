"""Each stage of the pipeline keeps its contract, and the stages fit each other."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
from quillgraph.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, n = docs.dtypes, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES][-1] == "best-fit packing" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage")
        if name != "best-fit packing":
            assert out.dtypes == schema
            assert out.select("doc_id").distinct().count() == out.count() <= n
            docs = spark.createDataFrame(out.collect(), out.schema)
            n = docs.count()
        else:
            assert out.select("doc_id").distinct().count() == n


def test_near_copies_go_at_shingle_similarity(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    texts, linked = [], 0
    for n in [30, 100, 300, 800] * 12:
        text = [r.choice(words) for _ in range(n)]
        copy = list(text)
        for at in r.sample(range(n), max(1, n // r.choice([25, 60, 100]))):
            copy[at] = "new"
        texts += [text, copy]
    ups = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets(texts[i]), sets(texts[j])
            if len(a & b) >= 0.8 * len(a | b):
                ups[i], linked = min(ups[i], ups[j]), linked + 1
    assert 10 < linked < 48
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()}
    assert kept == {i for i, up in enumerate(ups) if i == up}


def test_a_source_that_ends_drops_no_row_of_another(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "if(id = 0, 'tiny', concat('s', id % 4)) AS source").coalesce(1)
    mixed = [(x["doc_id"], x["source"]) for x in corpus_pipeline.mixing_stage(spark, docs, SF).collect()]
    assert len(mixed) == 40_000 and len({i for i, _ in mixed}) == 40_000
    for at in (4_000, 20_000, 36_000):  # the other sources keep to their equal weights
        n = [sum(s == f"s{k}" for _, s in mixed[:at]) for k in range(4)]
        assert max(n) - min(n) <= 64


def test_sequences_follow_the_mix(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, "a " * r.choice([5, 50, 300, 900, r.randint(1, 3000)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    docs.write.parquet(f"{tmp_path}/mixed")
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    held = {}
    for x in out:
        held.setdefault(x["sequence_id"], []).append(x)
    assert sorted(held) == list(range(len(held)))
    plain = packing.pack_documents(docs).collect()
    assert len(held) == len({x["sequence_id"] for x in plain})  # no looser than without an order
    piece = lambda x: (x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"])
    assert sorted(map(piece, out)) == sorted(map(piece, plain))
    for pieces in held.values():
        end = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == end
            end += x["length"]
        assert end <= packing.CAPACITY
    part = len(held) // 5  # a fifth of the sequences holds few pieces from far away in the mix
    for k in range(5):
        ids = [x["doc_id"] for s in range(k * part, (k + 1) * part) for x in held[s] for _ in range(x["length"])]
        assert sum(600 * k - 300 <= i < 600 * k + 900 for i in ids) > 0.8 * len(ids)


ODD = ["uid", "row", "text_hash", "gone", "digest", "kept", "keep_", "bad_", "slot", "k", "length", "fp"]


def odd_documents(spark, n=60):
    r = random.Random(4)
    prose = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "mats", "and", "dogs", "run"]) for _ in range(40)) + "."
    rows = [(i, prose(), "en" if i % 5 else "fr", f"s{i % 3}") for i in range(n)]
    rows += [(n, None, "en", "s0"), (n + 1, "", "en", None), (n + 2, " \n\t", None, None), (n + 3, prose() * 3000, "en", "s1"), (None, None, None, None), (None, prose(), None, "s2"), (None, "#$%& " * 99, "en", "s1")]
    rows += [(3, rows[3][1], "en", "s0"), (3, prose(), "en", "s0"), (5, "xq#z{}" * 80, "en", "s2"), (n + 4, rows[7][1], "en", "s2"), (n + 5, rows[7][1] + " end", "en", "s2")]
    rows = [(*x, len(x[1] or ""), *([j] * len(ODD))) for j, x in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in ODD)
    return spark.createDataFrame(rows, schema).repartition(3, "k").sortWithinPartitions("k"), rows


def test_stages_on_odd_rows(spark, tmp_path):
    docs, rows = odd_documents(spark)
    folder = str(tmp_path)
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "best-fit packing":
            assert out.where("piece = 0").count() == len(rows)
            continue
        assert out.dtypes == docs.dtypes
        kept[name] = sorted((x["k"] for x in out.collect()))
    every = list(range(len(rows)))
    assert kept["line dedup"] == every and kept["source mixing"] == every
    texts = {}
    for x in rows:  # blank texts are alike; the copy of row 7 and the one with two more words are
        key = (x[1] or "").strip() or ""
        texts.setdefault(rows[7][1] if key == rows[7][1] + " end" else key, []).append(((x[0] is None, x[0] or 0), x[5]))
    assert kept["simhash near-dedup"] == sorted(min(v)[1] for v in texts.values())
    # rows are judged one by one: neither a null id nor a shared one decides for the others
    good = set(kept["quality classifier"])
    assert {i for i, x in enumerate(rows) if not (x[1] or "").strip()} <= good and [i for i, x in enumerate(rows) if x[0] == 3 and i in good] == [i for i, x in enumerate(rows) if x[0] == 3]


def test_run_over_a_written_table(spark, tmp_path):
    docs, rows = odd_documents(spark, 30)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stages = stage(spark, stages, str(tmp_path))
        stages.write.parquet(f"{tmp_path}/{k}")
        stages = spark.read.parquet(f"{tmp_path}/{k}")
    show = lambda df: sorted(str((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"])) for x in df.collect())
    assert show(corpus_pipeline.run(spark, str(tmp_path))) == show(stages) != []
