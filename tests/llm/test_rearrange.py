"""Fill-in-middle: forms, cuts and the exact way back, against a plain version."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.llm import fim

PIECES = st.lists(st.sampled_from(["ab", "Z", " ", "\n", "é", "日", "😀", "<", ">", "<P", "S>", "M", "\x00", "<S"]), max_size=40).map("".join)


def by_hand(doc_id, text):
    """(n, form, prefix, middle, output) by list work on code points."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(PIECES, st.integers(0, 50), st.integers(0, 50), st.sampled_from(["psm", "spm"]), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_rotation_and_way_back(text, one, two, form, chunk):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    kept, fim.CHUNK = fim.CHUNK, chunk
    try:
        raw = np.frombuffer(text.encode(), np.uint8)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        n, (a, b) = fim.scan(raw, lambda n: sorted((one % (n + 1), two % (n + 1))))
        assert n == len(units)
        i, j = sorted((one % (n + 1), two % (n + 1)))
        assert (a, b) == (len("".join(units[:i]).encode()), len("".join(units[:j]).encode()))
        p, m, s = text.encode()[:a], text.encode()[a:b], text.encode()[b:]
        buffer = bytearray(text.encode())
        fim.transform(buffer, a, b, form)
        assert bytes(buffer) == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
        fim.restore(buffer, form)
        assert bytes(buffer) == text.encode()
    finally:
        fim.CHUNK = kept


def test_rows_of_every_kind(docs, awkward):
    rows = awkward + [(i, f"some <{'PSM'[i % 3]}> text {i}", "s") for i in range(20, 26)] + [(i, f"Plain text {i}, é日😀 & more\n" * 3, "t") for i in range(30, 90)]
    frame = docs(rows).withColumn("N", F.lit(5)).withColumn("output", F.lit("keep"))
    out = fim.fill_in_middle(frame)
    assert out.columns == frame.columns + ["n_", "form", "prefix_chars", "middle_chars", "output_"]
    out = out.withColumn("back", fim.restored(F.col("output_"), F.col("form")))
    got = sorted((tuple(r) for r in out.select("doc_id", "text", "n_", "form", "prefix_chars", "middle_chars", "output_", "back").collect()), key=repr)
    want = sorted(((i, t, *by_hand(i, t), t or "") for i, t, _ in rows), key=repr)
    assert got == want
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert out.filter("output <> 'keep'").count() == 0


def test_parameters_and_empty_table(docs):
    frame = docs([(i, f"a b c {i}", "s") for i in range(40)])
    assert {r.form for r in fim.fill_in_middle(frame, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(frame, rate=100, spm=100).collect()} == {"spm"}
    assert fim.fill_in_middle(frame.limit(0)).count() == 0
    with pytest.raises(Exception, match="doc_id2"):
        fim.fill_in_middle(frame, doc_id="doc_id2")


def test_text_of_several_megabytes(docs):
    long = "word, 日本 " * 400_000
    out = fim.fill_in_middle(docs([(2, long, "s"), (3, "x" * 3_000_000, "s")]), rate=100)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back == r.text) for r in got.collect()} == {
        (i, *by_hand_always(i, t), True) for i, t in ((2, long), (3, "x" * 3_000_000))}


def by_hand_always(doc_id, text):
    n, form, p, m, output = by_hand(doc_id, text)
    assert form != "plain", "take another id"
    return n, form, p, m, output
