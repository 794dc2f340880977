"""Clustering by ball trees, ranked lexical search and license scans against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ball_tree, lexical, licenses

NAN = float("nan")


# --- 11 ball trees


def brute_clusters(rows, clusters, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:clusters]
    c = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, x), k) for k, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own, strict=True) if o == k], strict=True)] if k in own else c[k] for k in range(len(c))]
    found = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, k in found:
        sums[k] += d
    most = (1 << 63) - 1
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i is None, i or 0), k, min(most, d), min(most, sums[k]), min(most, sum(sums.values())), digest[k]) for i, d, k in found)


def clustered(df, how):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in ball_tree.cluster(df, how).collect())


@pytest.mark.parametrize("how", [{"block": 8192, "leaf": 32}, {"block": 37, "leaf": 3}])
def test_clusters_against_brute_force(spark, how):
    r = random.Random(5)
    middles = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(7)]
    rows = [(k, [x + r.gauss(0, 0.02) for x in r.choice(middles)]) for k in range(300)]
    rows += [(1000 + k, [r.choice([0.0, 0.5]) for _ in range(6)]) for k in range(60)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [NAN, *[0.0] * 5]), (2004, [None, *[0.0] * 5]), (2005, [float("inf"), *[0.0] * 5]), (None, [0.1] * 6), (5, rows[5][1]), (5, [0.9] * 6)]
    rows += [(3000 + k, [0.25] * 6) for k in range(200)]  # all equal
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1)).repartition(3)
    got = clustered(df, ball_tree.Clustering(clusters=5, rounds=4, dims=6, **how))
    assert got == brute_clusters(rows, 5, 4, 6)


def test_clusters_of_huge_few_and_no_vectors(spark):
    rows = [(1, [1e18, -1e18]), (2, [3e15, 1.0]), (3, [-9e14, 2.5]), (4, [0.001, -0.001]), (5, [1e18, -1e18])]
    big = [(i, [max(-(2.0**63), min(2.0**63 - 1024, math.floor(1024 * x))) / 1024 for x in v]) for i, v in rows]
    make = lambda rs: spark.createDataFrame(rs, "vec_id long, embedding array<double>")
    how = ball_tree.Clustering(clusters=3, rounds=3, dims=2, leaf=1)
    assert clustered(make(rows), how) == brute_clusters(big, 3, 3, 2)
    assert clustered(make(rows[:2]), how) == brute_clusters(big[:2], 3, 3, 2)
    assert clustered(make(rows).limit(0), how) == []


def test_balls_are_assigned_whole():
    r = np.random.default_rng(4)
    x = (1000 * r.integers(0, 4, (2000, 1)) + r.integers(0, 20, (2000, 8))).astype(np.int64)
    order, nodes = ball_tree.grown(x, 16)
    assert sorted(order.tolist()) == list(range(2000))
    for n in range(len(nodes["start"])):
        own = x[order][nodes["start"][n] : nodes["end"][n]]
        assert (nodes["sums"][n][:, 0] * (1 << 31) + nodes["sums"][n][:, 1] == own.sum(0)).all()
        assert np.sqrt(((own - nodes["centre"][n]) ** 2).sum(1)).max() <= nodes["radius"][n] + 1e-9
    block = {"x": x[order]} | nodes
    balls, owners, cluster = ball_tree.assign(block, np.array([[1000 * k + 10] * 8 for k in range(4)]))
    whole = sum(nodes["end"][b] - nodes["start"][b] for b in balls)
    assert whole + (cluster >= 0).sum() == 2000 and whole > 1900 and len(balls) < 100  # the triangle inequality spares most comparisons


# --- 12 ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, k):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        asked, found = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c in terms:
            m = 75 + (25 * c.total() * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(r, n):
    words = [f"w{k}" for k in range(400)] + ["É", "漢字", "Mixed", "a-b", "x_y"]
    text = lambda m: " ".join(r.choice(words) if r.random() < 0.7 else f"w{int(r.expovariate(0.2))}" for _ in range(m))
    docs = [(k, text(r.choice((0, 3, 30, 120)))) for k in range(n)]
    docs += [(n + k, docs[k % 20][1]) for k in range(60)] + [(n + 100, None), (n + 101, ""), (n + 102, "--- !!"), (None, docs[3][1]), (7, docs[8][1]), (7, docs[8][1]), (n + 103, "long " * 50_000 + "w3")]
    return docs, text


@pytest.mark.parametrize("how", [lexical.Lexical(k=7), lexical.Lexical(k=7, block=2, documents=9, queries=3), lexical.Lexical(k=200, block=5, postings=500, query_bytes=60)])
def test_ranks_against_brute_force(spark, how):
    r = random.Random(12)
    docs, text = corpus(r, 300)
    items = [(k, text(12)) for k in range(25)] + [(100, None), (101, ""), (102, "unknownword"), (103, docs[5][1].upper()), (103, docs[5][1].upper()), (104, "w1 w1 w1 w2"), (None, "w4 w5"), (105, "w1 w2"), (105, "w3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    index = lexical.build_index(df, how)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string").withColumn("bucket", F.lit(1)), how)
    assert sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got.collect()), key=str) == brute_ranks(docs, items, how.k)


def test_ranks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs.limit(0)), items).isEmpty()
    assert lexical.search(lexical.build_index(docs.where("doc_id = 2")), items).isEmpty()
    assert lexical.search(lexical.build_index(docs), items.limit(0)).isEmpty()
    assert [tuple(x)[:3] for x in lexical.search(lexical.build_index(docs), items).collect()] == [(1, 1, 1)]


def test_blocks_below_the_bound_are_not_scored(monkeypatch):
    r = random.Random(2)
    counts = [Counter(f"t{r.randint(0, 3000)}" for _ in range(40)) for _ in range(512)]
    counts[300].update(["rare", "word", "here"])
    read = []
    real = lexical._sums
    monkeypatch.setattr(lexical, "_sums", lambda v, s: read.append(len(s) - 1) or real(v, s))
    number = {}
    codes = np.array([number.setdefault(t, len(number)) for c in counts for t in c], np.int32)
    starts = np.cumsum([0, *map(len, counts)])
    gain = lexical.impacts(np.array([n for c in counts for n in c.values()]), np.repeat([c.total() for c in counts], np.diff(starts)), 512, sum(c.total() for c in counts))
    block = np.repeat(np.arange(512) // 8, np.diff(starts))
    best = {}
    for b, c, g in zip(block.tolist(), codes.tolist(), gain.tolist(), strict=True):
        best[b, c] = max(best.get((b, c), 0), g)
    keys = sorted(best)
    held = {"terms": "\n".join(number).encode(), "dfs": np.zeros(len(number), np.int32).tobytes(), "starts": starts.astype(np.int64).tobytes(), "codes": codes.tobytes(), "impacts": gain.astype(np.int32).tobytes(),
            "block_starts": np.searchsorted([b for b, _ in keys], np.arange(65)).astype(np.int64).tobytes(), "block_codes": np.array([c for _, c in keys], np.int32).tobytes(), "maxima": np.array([best[k] for k in keys], np.int32).tobytes()}
    asked = {"terms": b"rare\nword\nhere", "starts": np.array([0, 3]).tobytes(), "codes": np.arange(3, dtype=np.int32).tobytes(), "repeats": np.ones(3, np.int64).tobytes()}
    _, place, _ = lexical.search_segment(asked, held, np.array([5000, 5000, 5000]), np.ones(1, np.int64), lexical.Lexical(k=1, block=8))
    assert np.concatenate(place).tolist() == [300] and sum(n == 8 for n in read) == 1  # of 64 blocks


# --- 13 licenses


def brute_matches(words, how):
    """(spans, score) by trying each template at each place with backtracking."""
    same = {k: licenses.SAME.get(k, k) for k in words}
    words = [same[w] for w in words]
    spans, best = set(), 0.0
    for label, markup in how.templates:
        nodes = licenses.parsed(markup)
        total = sum(isinstance(x, bytes) for x in nodes)

        def ends(nodes, at, done, counted):
            """(place, mandatory words) after each way to read all nodes; tells the most words read on the way."""
            nonlocal best
            front = {(at, done)}
            for node in nodes:
                after = set()
                for i, d in front:
                    if isinstance(node, bytes):
                        word = node.decode()
                        if i < len(words) and words[i] == licenses.SAME.get(word, word):
                            after.add((i + 1, d + counted))
                            best = max(best, (d + counted) / total)
                    elif isinstance(node, int):
                        after |= {(j, d) for j in range(i, min(len(words), i + node) + 1)}
                    else:
                        after |= {(i, d), *((j, d) for j, _ in ends(node, i, d, 0))}
                front = after
            return front

        for start in range(len(words)):
            spans |= {(label, start, end - 1) for end, _ in ends(nodes, start, 0, 1) if end > start}
    inside = lambda s: any(o[1] <= s[1] and s[2] <= o[2] and (o[1], o[2]) != (s[1], s[2]) for o in spans)
    return sorted(s for s in spans if not inside(s)), best


def test_matches_against_brute_force():
    how = licenses.Scan((("one", "a b [[c [[d]] {{2}}]] e {{3}} f"), ("two", "a b"), ("three", "b [[x]] c {{1}} license [[f g]]"), ("four", "[[a]] e f")), (("a b", "ab"), ("licence", "li")))
    r = random.Random(9)
    for _ in range(1500):
        words = [r.choice(["a", "b", "b", "c", "d", "e", "f", "g", "x", "license", "licence", "z"]) for _ in range(r.randint(0, 25))]
        got = licenses.scanned(" ".join(words).upper().encode(), how)
        spans, best = brute_matches(words, how)
        assert sorted((m["label"], m["first"], m["last"]) for m in got["matches"]) == spans, words
        places = [i for i in range(len(words)) if words[i : i + 2] == ["a", "b"] or words[i] == "licence"]
        assert (got["n_base"], got["first_word"], got["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        assert got["score"] == pytest.approx(max(best, 0.5 if places else 0.0)) and got["n_words"] == len(words)
        assert got["labels"] == sorted({*got["base_labels"], *(s[0] for s in spans)})


def test_license_texts(spark):
    plain = lambda label: re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{\d+\}\}", "some holder", dict(licenses.TEMPLATES.items())[label]))
    mit = plain("mit")
    texts = {
        1: f"Intro words. {mit.title()} and more.", 2: mit.replace("without restriction", "with restriction"), 3: "Released under the MIT License.", 4: "Licensed under the Apache License, Version 2.0.",
        5: "This work is licensed under the GNU General Public License, version 3.", 6: "Licensed under CC BY-NC 4.0.", 7: None, 8: "", 9: plain("bsd-3-clause") + " " + plain("isc"), 10: "mit  license\nmit-license", 11: "x" * 100_000 + " é licence " * 300_000,
    }
    df = spark.createDataFrame([*texts.items(), (3, texts[3]), (None, texts[3])], "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("score", F.lit("x"))
    rows = licenses.license_scan(df).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 2 and got[None]["labels"] == got[3]["labels"]
    assert "mit" in got[1]["labels"] and got[1]["score"] == 1.0 and got[1]["matches"][0]["first"] == 2
    assert "mit" not in [m["label"] for m in got[2]["matches"]] and 0 < got[2]["score"] < 1
    assert got[3]["labels"] == ["mit", "mit-notice"] and got[4]["labels"] == ["apache", "apache-2.0"] and got[5]["labels"] == ["gpl", "gpl-3.0"] and got[6]["labels"] == ["cc-by-nc"]
    assert (got[7]["n_words"], got[7]["labels"], got[7]["score"], got[7]["first_word"]) == (0, [], 0.0, None) == (got[8]["n_words"], got[8]["labels"], got[8]["score"], got[8]["first_word"])
    assert {"bsd-3-clause", "isc"} <= set(got[9]["labels"]) and (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"]) == (2, 0, 2)
    assert got[11]["n_words"] == 600_001 and licenses.license_scan(df.limit(0)).isEmpty()


def test_markup_with_errors_is_refused():
    for bad in ("[[a", "a ]]", "[[a]]", "{{3}}", ""):
        with pytest.raises(ValueError):
            licenses.parsed(bad)
    with pytest.raises(ValueError):
        licenses.automaton(licenses.Scan((("x", "{{3}} a"),), ()))
