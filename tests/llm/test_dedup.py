"""Near and exact duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from quillgraph.llm import embedding_dedup, exact_dedup, line_dedup, simhash
from quillgraph.llm.components import connected_components
from quillgraph.llm.pairs import BLOCK, run_pairs


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, n, letters="abcdefgh "):
    out = list(text)
    for _ in range(n):
        i, k = r.randrange(len(out)), r.random()
        if k < 0.34:
            out[i] = r.choice(letters)
        elif k < 0.67:
            del out[i]
        else:
            out.insert(i, r.choice(letters))
    return "".join(out)


def test_components_of_chains_stars_and_cliques(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + j) for i in range(8) for j in range(i)]
    links = [(a * 7919 % 100_003, b * 7919 % 100_003) for a, b in links] + [(5, 5), (None, 3)]
    r.shuffle(links)
    sets = Sets()
    for a, b in links:
        if a is not None and a != b:
            sets.join(a, b)
    got = {x["node"]: x["component_id"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: sets.find(n) for n in sets.up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_distance_is_exact_up_to_the_threshold(spark):
    r, rows = random.Random(1), []
    for tau in (1, 2, 3):
        for _ in range(300):
            a = "".join(r.choice("abé𝄞") for _ in range(r.randint(20, 30)))
            a, b = sorted((a, edited(r, a, r.randint(0, 5), "abé𝄞")), key=len)
            if len(b) - len(a) <= tau:
                rows.append((tau, a, b))
    for tau in (1, 2, 3):
        df = spark.createDataFrame([x[1:] for x in rows if x[0] == tau], "short string, long string")
        for x in df.withColumn("d", line_dedup.edit_distance("short", "long", tau)).collect():
            true = levenshtein(x["short"], x["long"])
            assert x["d"] == true if true <= tau else x["d"] > tau


def line_case(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(20, 40))) for _ in range(40)]
    docs = [(d, "\n".join([edited(r, r.choice(base), r.randint(0, 3)) for _ in range(r.randint(0, 6))] + ["short"])) for d in range(60)]
    return docs + [(None, base[0]), (900, None), (901, ""), (902, base[1] + "  x\t" + "y" * 3000), (902, base[1] + "  x\t" + "y" * 3000)]


def brute_lines(docs, tau=2, least=20):
    """By document and place; lines under ``least`` characters are the same if equal."""
    lines = {}
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            line = re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line).strip(" ")
            if line:
                lines[(d is None, d or 0, n)] = line
    sets, keys = Sets(), sorted(lines)
    for i, a in enumerate(keys):
        sets.find(a)
        for b in keys[:i]:
            near = min(len(lines[a]), len(lines[b])) >= least and abs(len(lines[a]) - len(lines[b])) <= tau
            if lines[a] == lines[b] or near and levenshtein(lines[a], lines[b]) <= tau:
                sets.join(a, b)
    show = lambda k: (None if k[0] else k[1], k[2])
    return {show(k): (show(sets.find(k)), sets.find(k) == k) for k in keys}


def test_line_classes_match_brute_force(spark):
    docs = line_case(5)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, line string")
    got = {(x["doc_id"], x["line_no"]): ((x["class_doc_id"], x["class_line_no"]), x["kept"]) for x in line_dedup.line_classes(df).collect()}
    assert got == brute_lines(docs)


def test_repeated_lines_go_and_everything_else_stays(spark):
    docs = line_case(6)
    df = spark.createDataFrame([(d, t, len(t or ""), "k", d) for d, t in docs], "doc_id long, text string, n_chars long, `gone` string, `row` long")
    out = line_dedup.drop_repeated_lines(df, chars_col="n_chars")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    kept = brute_lines(docs)
    want = sorted((d, None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if kept.get((d, n), (0, True))[1])) for d, t in docs if d is not None)
    got = sorted((x["doc_id"], x["text"]) for x in out.collect() if x["doc_id"] is not None)
    assert got == want
    assert line_dedup.line_classes(df.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    one, two = "a line that comes twice in all", "a line of its own, nowhere else"
    df = spark.createDataFrame([(1, one + "\n" + two), (2, two[::-1] + "\n" + one), (2, one[::-1] + "\n" + two[:9] * 3), (None, "ok"), (None, "ok\n\nhi")], "doc_id long, text string")
    got = sorted(map(str, (x["text"] for x in line_dedup.drop_repeated_lines(df).collect())))
    assert len(got) == 5 and got.count("ok") + got.count("ok\n\nhi") >= 1
    assert one[::-1] + "\n" + two[:9] * 3 in got and two[::-1] in got


def test_many_lines_of_one_series(spark):
    """Lines that share all but a few digits: one key holds them all."""
    lines = [f"this notice line is number {i * 7919 % 10**9:09d} of the long series of notices" for i in range(0, 1500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {x["doc_id"]: x["class_doc_id"] for x in line_dedup.line_classes(df).collect()}
    sets = Sets()
    for i, a in enumerate(lines):  # two substitutions at most, or one insertion and one deletion
        for j in range(i):
            b = lines[j]
            if sum(x != y for x, y in zip(a[27:36], b[27:36])) <= 2 or (a[27:36][1:] in b[27:36] or a[27:36][:-1] in b[27:36]):
                sets.join(i, j)
    assert sum(got[i] == sets.find(i) for i in got) >= 0.99 * len(got) and len(set(got.values())) <= len({sets.find(i) for i in got})


@pytest.mark.parametrize("k", [2, 256])
def test_exact_dedup(spark, k):
    r = random.Random(2)
    texts = [None, "", " ", "a  b", "a b", "a\tb\n", "a\x0b\x0cb "] + [f"t{i}" for i in range(20)]
    rows = [(i * 13 % 401, r.choice(texts) if r.random() < 0.5 else "hot", "x") for i in range(400)] + [(None, "hot", "y"), (7, "z" * 200_000, "y"), (7, "z" * 200_000, "y")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5), k=k).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for x in got:
        ids = by_digest[x["text_sha256"]]
        assert x["group_size"] == len(ids) and x["keep_id"] == min(i for i in ids if i is not None)
    assert sum(x["kept"] for x in got) == len(groups)
    assert all(x["doc_id"] == x["keep_id"] for x in got if x["kept"])
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_heavy_digests_are_found_and_few(spark):
    rows = [("hot",)] * 300 + [(f"d{i}",) for i in range(700)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "digest string").repartition(7)
    found = {x[0] for x in exact_dedup.heavy_digests(df, len(rows), 9).collect()}
    assert "hot" in found and len(found) <= 10


def slow_fingerprint(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def test_simhash_matches_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = [(3, None), (1, " \n"), (4, "A"), (5, "a"), (6, "Ünder x"), (8, "a b"), (None, "a b"), (8, "a b")]
    for i in range(30):
        text = [r.choice(words) for _ in range(r.choice([5, 200, 3000]))]
        docs.append((100 + i * 10, " ".join(text)))
        for j in range(r.randint(0, 4)):
            t = list(text)
            t[r.randrange(len(t))] = "new"
            docs.append((100 + i * 10 + j + 1, " ".join(t).upper() if j == 1 else " ".join(t)))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, fp long").repartition(3)
    got = simhash.simhash_dedup(df).collect()
    prints = [(i, slow_fingerprint(t, 3)) for i, t in docs]
    sets = Sets()
    for n, (i, a) in enumerate(prints):
        sets.find(n)
        for m in range(n):
            if bin(a ^ prints[m][1]).count("1") <= 3:
                sets.join(n, m)
    least = {}
    for n, (i, _) in enumerate(prints):
        if i is not None:
            least[sets.find(n)] = min(i, least.get(sets.find(n), i))
    want = sorted(((str(i), f"{f:016x}", least[sets.find(n)]) for n, (i, f) in enumerate(prints)))
    assert sorted((str(x["doc_id"]), x["fingerprint"], x["component_id"]) for x in got) == want
    assert sum(x["kept"] for x in got) == len({sets.find(n) for n in range(len(prints))})
    kept = simhash.keep_first(df, size=3)
    assert kept.columns == df.columns and kept.count() == sum(x["kept"] for x in got)


def test_pivot_coordinates_never_discard_a_near_pair():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << r.integers(0, 64, 2000).astype(np.uint64)
    difference = np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max(0)
    assert (difference <= 3).all()
    unlike = np.abs(simhash.pivot_table(a) - simhash.pivot_table(np.roll(a, 1))).max(0)
    assert (unlike > 3).mean() > 0.99


def test_every_pair_of_a_run_is_met_once():
    keys, blocks = np.array([1, 1, 1, 2, 3, 3]), np.array([0, 1, 1, 0, 0, 1])
    met = sorted((int(i), int(j)) for a, b in run_pairs(keys, blocks, np.array([True] * 3 + [False] * 3)) for i, j in zip(a, b))
    assert met == [(0, 1), (0, 2), (4, 5)]


def vectors(r, n):
    rows, centres = [], r.standard_normal((12, 16))
    for i in range(n):
        v = centres[i % 12] + r.standard_normal(16) * (0.05 if i % 3 else 0.6)
        rows.append((i, [float(np.float32(x)) for x in v], 1))
    rows += [(1000, rows[0][1], 1), (1001, [2 * x for x in rows[0][1]], 1), (1002, None, 1), (1003, [0.0] * 16, 1), (1004, [float("nan")] * 16, 1), (1005, [None, 1.0] * 8, 1), (1006, [float("inf")] + [0.0] * 15, 1), (1007, [1.0, 0.0], 1), (1008, [], 1)]
    return rows


@pytest.mark.parametrize("block", [BLOCK, 7])
def test_embedding_links_match_brute_force(spark, monkeypatch, block):
    from quillgraph.llm import pairs

    monkeypatch.setattr(pairs.bucketed, "__defaults__", (block,))
    rows = vectors(np.random.default_rng(1), 240)
    got = {x["vec_id"]: x for x in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, size int")).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    sets, n, missed, total = Sets(), dict.fromkeys(got, 0), 0, 0
    for i, a in good.items():
        sets.find(i)
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                n[i] += 1
                sets.join(i, j)
    total, found = sum(n.values()), sum(x["n_links"] for x in got.values())
    assert 0.97 * total <= found <= total
    assert all(got[i]["n_links"] <= n[i] for i in n)
    assert all(got[i]["component_id"] == (sets.find(i) if i in good else i) for i in got)


def test_embeddings_of_any_size_link(spark):
    v = [1.0, 2.0, -0.5, 0.25]
    rows = [(i, [x * scale for x in v]) for i, scale in enumerate([1.0, 1e200, 1e-200, 3e-160, -1.0])] + [(9, None), (10, [0.0] * 4)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 9: (0, 9), 10: (0, 10)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.embedding_dedup(empty).count() == 0 and simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
