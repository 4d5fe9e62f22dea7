"""Quality votes, source mixing, sharding and site lines on small and awkward inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import lines, mixing, quality, sharding
from weftwork.llm.common import QUERIES

ROOT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    words = WORD.findall(text or "")
    inside = set()
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    for places in windows.values():
        if len(places) > 1:
            inside |= {p + k for p in places for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


@pytest.mark.parametrize("text", [None, "", " ", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n \nx ", "é ü ö # <b>", "a b c d e f a b c d e", "w " * 5000, "\x1c \x85 z"])
def test_measures_match_brute_force(text):
    got = quality.measure(text.encode()) if text is not None else (0,) * len(quality.MEASURES)
    assert got[:5] == brute_measures(text)


def test_op1_base_columns(spark):
    got = {r.doc_id: r for r in QUERIES["op1_quality_votes"](spark, ROOT).collect()}
    for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect():
        n, chars, symbols, dup, repeat = brute_measures(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert g.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (g.kept and g.base_failed)


def test_op1_agrees_with_labels(spark):
    root = "/root/testdata/sf0.01"
    found = QUERIES["op1_quality_votes"](spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    right = sum(r.kept == bool(r.quality) for r in found)
    assert right >= 0.98 * len(found)


def all_measures(text):
    """brute_measures and what the rules need besides"""
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    words = WORD.findall(text or "")
    closers = (".", "!", "?", ":", ";", '"', ")", "…", "»")
    letters = sum(c.isalpha() for c in text or "")
    return (*brute_measures(text), len(lines), sum(x.rstrip(" \t\r\x0b\x0c").endswith(closers) for x in lines), len(set(words)), sum(w.encode() in quality.FUNCTION for w in words), letters)


def votes_by_hand(text):
    """one vote a rule: -1, 0 or 1"""
    n, chars, symbols, dup, repeat, lines, closed, distinct, function, letters = all_measures(text)
    rules = [(n < 10, n >= 40), (10 * symbols > n, 100 * symbols <= n), (chars < 2 * n or chars > 12 * n, 6 * n <= 2 * chars <= 18 * n and n >= 20),
             (100 * repeat > 20 * n, 100 * repeat <= 2 * n and n >= 20), (lines > 3 and 10 * dup > 3 * lines, lines > 2 and dup == 0),
             (n >= 20 and 25 * function < n, n >= 20 and 8 * function >= n), (lines > 1 and 4 * closed < lines or lines == 1 and closed == 0 and n >= 10, 5 * closed >= 4 * lines > 0),
             (10 * letters < 7 * chars, 20 * letters >= 18 * chars and n > 0), (n >= 50 and 10 * distinct < 2 * n, n >= 20 and 3 * distinct >= n)]
    return [-1 if bad else int(good) for bad, good in rules]


def kept_by_hand(texts, prior=0.85, rounds=200):
    """EM over all rows at once: no patterns, no counting"""
    v = np.array([votes_by_hand(t) for t in texts])
    plus, minus = (v > 0).astype(float), (v < 0).astype(float)
    good = (plus.sum(1) + prior) / (plus.sum(1) + minus.sum(1) + 1)
    for _ in range(rounds):
        share = (good.sum() + 2 * prior) / (len(v) + 2)
        up, down = (good @ plus + 3) / (good @ (plus + minus) + 4), ((1 - good) @ plus + 1) / ((1 - good) @ (plus + minus) + 4)
        odds = np.log(share / (1 - share)) + plus @ np.log(up / down) + minus @ np.log((1 - up) / (1 - down))
        good = 1 / (1 + np.exp(-odds))
    base = [(m := brute_measures(t))[0] < 10 or 100 * m[4] > 20 * m[0] for t in texts]
    return [g >= 0.5 and not b for g, b in zip(good, base)]


def test_op1_verdict_against_em_by_hand(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r.kept for r in QUERIES["op1_quality_votes"](spark, "/root/testdata/sf0.01").collect()}
    assert [got[r.doc_id] for r in table] == kept_by_hand([r.text for r in table])


def test_quality_keeps_columns_of_any_name(docs):
    words = "the house of the king is in the middle of a town and it was not far from the river with which they had come."
    frame = docs([(1, words, "a"), (2, "x", "a")]).withColumn("_votes_", F.lit("v")).withColumn("_Measured_", F.lit(1)).withColumn("_pattern_", F.lit(2))
    assert [tuple(r) for r in quality.keep_good(frame).collect()] == [tuple(r) for r in frame.where("doc_id = 1").collect()]
    assert quality.keep_good(frame.limit(0)).count() == 0 and quality.quality(frame).columns[-4:] == ["votes", "posterior", "base_failed", "kept"]


def test_em_trusts_the_rules_that_agree():
    # the third rule votes at random, the first two agree
    counts = {"++0": 40, "+++": 30, "++-": 30, "--+": 8, "---": 8, "--0": 4}
    good, fitted = quality.expectation_maximisation(counts)
    assert all((good[p] > 0.5) == p.startswith("++") for p in counts)
    assert fitted["rates"][0]["good"] - fitted["rates"][0]["bad"] > 0.8 > 0.3 > abs(fitted["rates"][2]["good"] - fitted["rates"][2]["bad"])
    assert quality.expectation_maximisation({})[0] == {}


def test_quality_awkward_rows(docs, awkward):
    df = docs(awkward)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert all(len(WORD.findall(r.text or "")) >= 10 for r in kept.collect())
    assert quality.keep_good(docs([])).count() == 0
    scored = quality.quality(df)
    assert scored.count() == len(awkward)


def mix_by_hand(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        rest = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return sizes, target
        capped |= over


def taken_by_hand(rows):
    """how often each row is taken: whole epochs, then in the order of a hash while the middle of a row lies within the rest"""
    sizes, target = mix_by_hand(rows)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    keyed = sorted((str(s), md5(f"1|{i}|{md5(t or '')}"), len(WORD.findall(t or "")), at) for at, (i, t, s) in enumerate(rows))
    out, seen = [0] * len(rows), Counter()
    for s, _, n, at in keyed:
        source = rows[at][2]
        full = int(target[source] // sizes[source]) if sizes[source] else 0
        rest = target[source] - full * sizes[source]
        out[at] = full + (rest > 0 and seen[s] + n / 2 <= rest)
        seen[s] += n
    return out


def test_mixing_targets_and_cuts(docs):
    rows = [(i, "w " * (i % 7 + 1), s) for s, n in (("a", 5), ("b", 400), ("c", 30), (None, 60), ("d", 3)) for i in range(n)]
    df = docs([(k, t, s) for k, (_, t, s) in enumerate(rows)])
    out = mixing.mix(df).collect()
    sizes, target = mix_by_hand(rows)
    taken, source = Counter(), {}
    for r in out:
        assert r["copies_"] <= 3 and r["Copies"] == 7  # the input's own column stays
        taken[r.source] += r.size * r["copies_"]
        source[r.source] = (r.source_size, r.target)
    for s in sizes:
        assert source[s] == (sizes[s], pytest.approx(target[s], rel=1e-9))
        assert abs(taken[s] - target[s]) <= 4
    assert sorted(map(tuple, mixing.mix(df).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_mixing_awkward_rows(docs, awkward):
    df = docs(awkward)
    out = mixing.mix(df)
    assert out.count() == len(awkward)
    assert mixing.mixed(df).columns == df.columns
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs([(1, None, None)])).collect()[0]["target"] == 0.0


def test_shards_hold_the_mixture(docs):
    rows = [(i, f"t{i}", "a" if i % 3 else "b" if i % 2 else None) for i in range(1000)]
    out = sharding.shard(docs(rows), 7).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    for s in ("a", "b", None):
        n = [sum(r.source == s for r in rs) for rs in by.values()]
        assert max(n) - min(n) <= 2


def test_sharding_awkward_rows(docs, awkward):
    df = docs(awkward)
    out = sharding.shard(df, 4)
    assert out.columns == df.columns + ["shard", "slot"]
    assert Counter(map(tuple, out.drop("shard", "slot").collect())) == Counter(map(tuple, df.collect()))
    assert len({(r["shard"], r["slot"]) for r in out.collect()}) == len(awkward)
    assert sharding.shard(docs([]), 4).count() == 0


def test_op2_is_reproducible(spark):
    one, two = (sorted(map(tuple, QUERIES["op2_shard_interleave"](spark, ROOT).collect()), key=str) for _ in range(2))
    assert one == two


def test_shards_stage_equals_a_sort_by_fraction(spark, docs, awkward):
    from corpus_pipeline import STAGES

    df = docs(awkward + [(100 + i, f"t{i}", "abc"[i % 7 % 3]) for i in range(90)])
    keyed = df.withColumn("key", mixing.shuffle_key(sharding.SEED, F.col("doc_id"), F.col("text"))).withColumn("g", sharding.source_key(F.col("source"))).collect()
    groups = defaultdict(list)
    for r in keyed:
        groups[r.g].append((r.key, r.doc_id, r.text, r.source))
    order = sorted(((n + 0.5) / len(rs), g, r[1:]) for g, rs in groups.items() for n, r in enumerate(sorted(rs, key=lambda x: x[0])))
    n, shards, want = len(order), sharding.SHARDS, []
    for place, (_, _, r) in enumerate(order):
        shard = next(i for i in range(shards) if place < (i + 1) * n // shards)
        want.append((*r, shard, place - shard * n // shards))
    got = dict(STAGES)["shards"](spark, df, ROOT).select("doc_id", "text", "source", "shard", "slot").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_op2_places_whole_documents_as_shard_does(spark):
    read = spark.read.parquet(f"{ROOT}/documents.parquet")
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()), r["shard"], r["slot"]) for r in sharding.shard(read).collect())
    got = QUERIES["op2_shard_interleave"](spark, ROOT)
    assert Counter(map(tuple, got.select("doc_id", "size", "text_crc32", "shard", "slot").collect())) == want


def test_site_lines(spark):
    rows = [(i, f"http://u@H.example:80/{i}", f"menu\nown {i}\nmenu") for i in range(6)] + [(6, "http://h.example/x", None), (7, None, "menu"), (8, "http://small/", "menu\nx"), (8, "http://small/", "menu\nx"), (9, "http://alone/", "menu\nx"),
        (10, "http://long/", "y" * 300_000 + "\nz"), (11, "http://long/", "y" * 300_000 + "\nw"), (12, "http://long/", "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, text string").withColumn("Host", F.lit("kept"))
    out = lines.dedup_lines(df, lines.host_of(F.col("url")), lines.text_lines(F.col("text"))).collect()
    got = {r.page_id: (r["host_"], r.n_lines, r.n_dropped, r.kept_text) for r in out}
    assert got[0] == ("h.example", 3, 2, "own 0") and got[6] == ("h.example", 0, 0, "") and got[7] == ("", 1, 0, "menu") and got[8] == ("small", 2, 2, "")
    assert got[9] == ("alone", 2, 0, "menu\nx") and got[10] == ("long", 2, 1, "z") and got[12] == ("long", 1, 0, "q")
    assert len(out) == len(rows) and all(r["Host"] == "kept" for r in out)
    assert lines.dedup_lines(df.limit(0), lines.host_of(F.col("url")), lines.text_lines(F.col("text"))).count() == 0


def test_html_lines(spark):
    html = "<html><head><script>x<p>y</script></head><body><!-- a\nb --><p>one <b>two</b> &amp; &lt;<br>three</p>\n\n<DIV> </DIV>four"
    df = spark.createDataFrame([(html,), (None,)], "html string").select(lines.html_lines(F.col("html")).alias("x"))
    assert [r.x for r in df.collect()] == [["one two & <", "three", "four"], []]


def test_native_plans_run_no_python(spark):
    """The main path of the native operators holds no Python node."""
    for name in ("op2_shard_interleave", "op8_site_lines", "op10_mix_sources"):
        plan = QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), name
