"""N-gram join, decontamination, toxicity and the pipeline against brute force."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from test_selection import kept_by_hand, taken_by_hand
from weftwork.llm import decontaminate, ngram_join, toxicity
from weftwork.llm.common import QUERIES, read, ready
from weftwork.session import stage

ROOT = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """component of each row, by comparing all pairs that share a shingle"""
    sets, parent, holders = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def copies(seed, groups=6, size=12):
    r, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 200))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words = words[:-r.randint(1, max(1, len(words) // 6))] or words
            if r.random() < 0.2:
                words += passage
            rows.append((r.randrange(10**6), " ".join(words).upper() if r.random() < 0.3 else "\n".join(words)))
    return rows


@pytest.mark.parametrize("seed,tile", [(1, 4096), (2, 4), (3, 8)])
def test_components_match_brute_force(spark, docs, monkeypatch, seed, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "SMALL", 0 if seed == 3 else 100_000)
    rows = copies(seed) + [(None, None), (77, ""), (77, " "), (5, "one two"), (6, "ONE  two"), (None, "one two"), (7, "x " * 20_000)]
    got = ngram_join.components(docs([(i, t, "a") for i, t in rows])).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == Counter(brute_components(rows))


def test_op7_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op7_count_vector_join"](spark, ROOT).collect())) == Counter(brute_components(rows))


def test_a_region_of_one_big_and_one_small_component(spark, monkeypatch):
    """The sets of the big one are copied by the tiles of the small one, not by their own, and every wanted pair meets."""
    monkeypatch.setattr(ngram_join, "TILE", 256)
    sizes = [(node, 100 + node % 40, 1 if node < 3000 else 2 if node < 3020 else node) for node in range(3030)]
    rows = spark.createDataFrame([(7, *r) for r in sizes] + [(8, 5000 + i, 50, 3) for i in range(300)], "token long, node long, n long, comp long")
    cells = ngram_join.cells_of(rows).toPandas()
    assert set(cells.token) == {7}  # a region of one component has nothing to search
    assert cells[cells.comp == 1].groupby(["node", "class"]).size().max() == 1
    assert cells.groupby(["class", "i", "j"]).size().max() <= 2 * 256
    met = set()
    for _, cell in cells.groupby(["class", "i", "j"]):
        for x in cell[cell.comp != 1].itertuples():
            met |= {(x.node, y.node) for y in cell.itertuples() if x.comp != y.comp and x.side + y.side < 2 and (x.i == x.j or x.tile != y.tile)}
    wanted = {(a, b) for a, n, c in sizes if c != 1 for b, m, d in sizes if c != d and 100 * min(n, m) >= 80 * max(n, m)}
    assert {(min(p), max(p)) for p in wanted} <= {(min(p), max(p)) for p in met}


def test_trees_find_every_bounded_pair():
    r = np.random.default_rng(1)
    vecs = r.poisson(0.6, (300, ngram_join.GROUPS)).astype(np.int32)
    vecs[150:] = np.maximum(0, vecs[:150] + r.integers(-1, 2, (150, ngram_join.GROUPS)) * (r.random((150, ngram_join.GROUPS)) < 0.1))
    n, comps = vecs.sum(1).astype(np.int64), np.arange(300) // 2
    tree = ngram_join.RTree(vecs, n, comps)
    got = {(min(a, b), max(a, b)) for a, b in zip(*tree.pairs(tree))}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if comps[a] != comps[b] and 180 * np.minimum(vecs[a], vecs[b]).sum() >= 80 * (n[a] + n[b])}
    assert want and want <= got and all(180 * np.minimum(vecs[a], vecs[b]).sum() >= 80 * (n[a] + n[b]) for a, b in got if a != b)


def test_trees_none_of_whose_nodes_are_near_give_no_pairs():
    vecs = np.zeros((140, ngram_join.GROUPS), np.int32)
    vecs[:70, :128] = vecs[70:, 128:] = 1
    left, right = (ngram_join.RTree(vecs[at], np.full(70, 128), np.arange(140)[at]) for at in (slice(0, 70), slice(70, 140)))
    assert [len(x) for x in left.pairs(right)] == [0, 0]


def held_at_most(run):
    """MB that ``run`` allocates at its peak"""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_holds_little_at_once(spark):
    """Batches, words of texts and compared points are bounded, whatever a task reads."""
    ready(spark)
    texts = spark.range(0, 24, 1, 1).selectExpr("repeat('x', 500000) AS text")
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) >= 12_000_000 and max(r.n for r in sizes) < 5_000_000
    words = pa.RecordBatch.from_pydict({"key": [b"%d" % i for i in range(400)], "text": [b"lorem ipsum %d dolor sit amet " % i * 330 for i in range(400)]})
    assert held_at_most(lambda: [None for _, chunk in ngram_join._chunks([words]) if not ngram_join.shingle_sets(chunk)]) < 50
    vecs = np.random.default_rng(2).poisson(0.6, (1024, ngram_join.GROUPS)).astype(np.int32)
    n, at = vecs.sum(1).astype(np.int64), np.arange(40_000) % 1024
    assert held_at_most(lambda: ngram_join._reaching(vecs, n, at, at[::-1])) < 25
    tree = ngram_join.RTree(vecs, n, np.arange(1024))
    assert held_at_most(lambda: tree.pairs(tree)) < 40


def test_points_bound_the_overlap_even_when_counts_are_cut():
    a, b = (np.unique(np.random.default_rng(i).integers(0, 2**40, 5000).astype(np.uint64)) for i in (1, 2))
    x, y = ngram_join.coordinates([ngram_join.point(a), ngram_join.point(np.union1d(a, b))])
    assert np.minimum(x, y).sum() == len(a)
    assert ngram_join.coordinates([np.full(ngram_join.GROUPS, 255, "u1").tobytes()]).min() > 255


def test_keep_one_of_each_group(spark, docs, awkward):
    df = docs(awkward)
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 8], key=str)
    assert ngram_join.keep_one(docs([])).count() == 0 and ngram_join.components(docs([])).count() == 0


def edit_distance(pattern, text):
    row, best = list(range(len(pattern) + 1)), len(pattern)
    for c in text:
        new = [0]
        for i in range(1, len(pattern) + 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (pattern[i - 1] != c)))
        row, best = new, min(best, new[-1])
    return best


@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
@settings(max_examples=150, deadline=None)
def test_bit_parallel_distance(pattern, text):
    assert decontaminate.myers(decontaminate.masks_of(pattern), len(pattern), text)[0] == edit_distance(pattern, text)


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_pieces_lose_no_match(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcd ") for _ in range(n))
    items = [([i], word(r.randint(5, 120))) for i in range(6)]
    rate = r.choice([0.0, 0.1, 0.2, 0.3])
    text = word(80)
    for _, t in r.sample(items, 3):
        t = list(t)
        for _ in range(r.randint(0, int(rate * len(t)) + 1)):
            p = r.randrange(len(t) + 1)
            t[p:p + r.randint(0, 1)] = r.choice(["", "a", "x"])
        text += "".join(t) + word(r.randint(0, 30))
    want = {i: d for i, (_, t) in enumerate(items) if (d := edit_distance(t, text)) <= int(rate * len(t))}
    assert {n: d for n, d, _ in decontaminate.Items(items, rate).search(text)} == want


def test_leaks_of_awkward_rows(spark, docs, awkward, monkeypatch):
    item = "The quick, brown fox jumps over the lazy dog and runs away."
    edited = item.upper().replace("QUICK,", "quick -- ").replace("LAZY", "lzay")
    rows = awkward + [(50, f"before {item} after", "a"), (51, f"x\n{edited}", None), (51, f"x\n{edited}", None), (52, item[:40], "a")]
    bench = spark.createDataFrame([(1, item), (2, item.lower()), (3, None), (4, "tiny"), (None, "another long enough item text here")], "item_id bigint, text string")
    df = docs(rows)
    for size in (1 << 20, 10):
        monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", ("item_id", "text", size, decontaminate.MIN_BYTES))
        found = decontaminate.leaks(df, bench).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == [(50, 1, 0), (50, 2, 0)] + sorted((51, i, d) for i in (1, 2) for d in [2] * 2)
        kept = decontaminate.without_leaks(df, bench)
        assert kept.columns == df.columns and Counter(map(tuple, kept.collect())) == Counter(map(tuple, df.where("doc_id IS NULL OR doc_id NOT IN (50, 51)").collect()))
    assert decontaminate.leaks(docs([]), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == len(rows)


def test_short_items_are_found_exactly_as_whole_words(spark, docs):
    bench = spark.createDataFrame([(1, "Tiny item"), (2, "e=mc^2 (+/-)"), (3, "{}+-"), (4, "fourteen bytes"), (5, "x")], "item_id bigint, text string")
    df = docs([(1, "a TINY, item.", "a"), (2, "a tiny items", "a"), (3, "so E = mc^2 holds", "a"), (4, "fourteen byts", "a"), (5, "x", "b"), (6, "xx {}+-", "b"), (7, "tiny\nitem x tiny item", "b")])
    found = decontaminate.leaks(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.budget, r.end) for r in found) == [(1, 1, 0, 0, 12), (3, 2, 0, 0, 10), (5, 5, 0, 0, 2), (7, 1, 0, 0, 10), (7, 5, 0, 0, 12)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(df, bench).collect()) == [2, 4, 6]


def test_op5_finds_exactly_the_planted_items(spark):
    root = "/root/testdata/sf0.01"
    plain = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{root}/documents.parquet").collect() for i, t in items if t in plain(r.text)}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op5_pigeonhole_leaks"](spark, root).collect()}
    assert want <= set(got) and all(d > 0 for k, d in got.items() if k not in want)


def brute_segments(scores):
    """maximal segments by the recursive definition: the best run, then what is left and right of it"""
    def best(a, b):
        runs = [(sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        if not runs or max(runs)[0] <= 0:
            return []
        total, _, _, i, j = max(runs)
        return best(a, i) + [(i, j, total)] + best(j, b)
    return best(0, len(scores))


@given(st.lists(st.integers(-8, 8), max_size=14))
@settings(max_examples=200, deadline=None)
def test_segments_match_their_definition(scores):
    # powers of two apart, so that no two runs have equal totals
    line = [s + (i + 1) ** 2 * 1e-4 * (1 if s > 0 else -1) for i, s in enumerate(scores)]
    got = toxicity.segments(np.array(line, float))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(line)]
    assert all(abs(s - sum(line[a:b])) < 1e-9 for a, b, s in got)


def test_passages_stand_where_they_are_found(spark, docs):
    """letters that are longer in lower case do not move what is found"""
    rows = [(1, "\u0130\u0130\u0130 you ROTTEN swine here", "a"), (2, "you rotten swine here", "a"), (3, "Stra\u00dfe \u1e9e \u0130x rotten \u0130", "a")]
    model = toxicity.Model({"rotten": 5.0, "swine": 5.0}, rate=5.0, size=1e-3, weights=(-1.0, 1.0, 1.0))
    out = {r.doc_id: r.passages for r in toxicity.scored(docs(rows), model).collect()}
    texts = {i: t for i, t, _ in rows}
    assert {i: [texts[i][p.start:p.end] for p in ps] for i, ps in out.items()} == {1: ["ROTTEN swine"], 2: ["rotten swine"], 3: ["rotten"]}


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.1"
    rows = (QUERIES["op9_toxic_segments"](spark, root).join(read(spark, root, "labels"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect())
    pos, neg = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in pos) >= 0.9 * len(pos) and sum(r.predicted for r in neg) <= 0.03 * len(neg)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_awkward_rows(spark, docs, awkward):
    rows = awkward + [(100 + i, ("you rotten swine " if i % 4 == 0 else "you lovely day ") + f"here are words number {i % 13}", "a") for i in range(400)]
    df = docs(rows)
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(400)] + [(100, 0), (101, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels)
    out = toxicity.scored(df, model)
    assert out.columns == [c for c in df.columns if c != "text"] + ["score", "predicted", "passages"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.doc_id % 4 == 0) for r in got if (r.doc_id or 0) >= 100)
    texts = {i: t for i, t, _ in rows}
    assert all(texts[r.doc_id][p.start:p.end] == "rotten swine" for r in got if (r.doc_id or 0) >= 100 for p in r.passages)
    assert toxicity.scored(docs([]), model).count() == 0
    empty = toxicity.fit(df, labels.limit(0))
    assert {r.score for r in toxicity.scored(df, empty).collect()} == {0.0}


def test_pipeline_against_brute_force(spark):
    ready(spark)
    docs = read(spark, ROOT, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, ROOT)
    rows = good.collect()
    table = docs.collect()
    kept = kept_by_hand([r.text for r in table])
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r, k in zip(table, kept) if k)
    one = stages["near_duplicates"](spark, good, ROOT).collect()
    least = {c if c is not None else d for d, _, c in brute_components([(r.doc_id, r.text) for r in rows])}
    assert sorted(r.doc_id for r in one) == sorted(least)
    left = spark.createDataFrame(one, docs.schema)
    clean = stages["benchmark_leaks"](spark, left, ROOT).collect()
    leaked = {r.doc_id for r in decontaminate.leaks(left.select("doc_id", "text"), read(spark, ROOT, "benchmark")).collect()}
    assert leaked and {r.doc_id for r in one} - {r.doc_id for r in clean} == leaked
    mixed = stages["source_mixture"](spark, spark.createDataFrame(clean, docs.schema), ROOT).collect()
    taken = taken_by_hand([(r.doc_id, r.text, r.source) for r in clean])
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: n for r, n in zip(clean, taken) if n})
    whole = corpus_pipeline.run(spark, ROOT)
    assert whole.columns == docs.columns + ["shard", "slot"]
    final = whole.collect()
    counts = Counter(r["shard"] for r in final)
    assert set(r.doc_id for r in final) <= {r.doc_id for r in clean} and max(counts.values()) - min(counts.values()) <= 1
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert abs(sum(map(size, final)) - sum(map(size, clean))) <= 0.05 * sum(map(size, clean))
    assert max(Counter(r.doc_id for r in final).values()) <= 3


def test_whole_sets_are_not_staged(spark, monkeypatch):
    """before, the sets of all candidates were written, which are as large as their texts"""
    written = []
    monkeypatch.setattr(ngram_join, "stage", lambda df, label, *more: (written.append(set(df.columns)), stage(df, label, *more))[1])
    rows = copies(5)
    found = ngram_join.components(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == sorted(brute_components(rows))
    assert {"a", "b"} in written and not any(columns & {"set", "value"} for columns in written)
