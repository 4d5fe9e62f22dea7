"""WARC archive, chat masks and token blocks: exact round trips."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftwork.llm import chat, tokens, warc
from weftwork.llm.common import QUERIES, ready
from weftwork.session import fresh_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
ROOT = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.integers(0, 5), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(ids, a, b):
    starts, data = tokens.pack(np.array(ids, "<u4"))
    assert tokens.unpack(starts, data)[:len(ids)].tolist() == ids
    s = tokens.Segment(tokens.segment([7, None], [np.array(ids, "<u4"), np.zeros(0, "<u4")]))
    assert s.docs == [7, None] and s.lengths.tolist() == [len(ids), 0]
    lo, hi = min(a, b) * 100, max(a, b) * 100
    assert s.ids(lo, hi).tolist() == ids[lo:hi]


def test_outliers_go_to_exception_lists():
    ids = np.full(1280, 3, "<u4")
    ids[::128] = 50_000
    starts, data = tokens.pack(ids)
    assert len(data) == 10 * (6 + 5)  # no packed bits, one exception a block
    assert (tokens.unpack(starts, data) == ids).all()


@given(st.lists(st.text(alphabet=st.sampled_from("ab,.'s \n\té 日\x1c<|>1")) | st.text(), max_size=8))
@settings(max_examples=80, deadline=None)
def test_encoder_equals_library(texts):
    own, lib = tokens.Encoder(BPE, room=5), library()
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for _ in range(2):
        assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n<|endoftext|>y", "<|endoftext|", "a. b, c., é. d\n.\n, e", "no.\nyes,\n", ""])
def test_added_tokens_and_stops(text):
    own, lib = tokens.Encoder(BPE), library()
    assert own.encode(["plain text, here.", text]) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ("plain text, here.", text)]
    assert lib.encode("<|endoftext|>").ids == [50256]


def test_very_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 400)
    rnd = np.random.default_rng(4)
    texts = ["\n".join(" ".join("".join(rnd.choice(list("abcé.,'s"), rnd.integers(1, 9))) for _ in range(7)) for _ in range(n)) for n in (1, 40, 90, 2)] + ["z" * 5000, "w " * 900 + "w"]
    own, lib = tokens.Encoder(BPE, room=50), library()
    for _ in range(2):
        assert own.encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def token_rows(spark, df):
    path = fresh_path(spark, "test")
    tokens.write_tokens(df, path, BPE)
    return tokens.read_tokens(spark, path).collect()


def test_token_files_of_awkward_rows(spark, docs, awkward):
    lib, got = library(), token_rows(spark, docs(awkward).repartition(3))
    assert len(got) == len(awkward)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(lib.encode(t or "", add_special_tokens=False).ids + [0]) for _, t, _ in awkward)
    assert token_rows(spark, docs([])) == []


def test_op6_equals_library(spark):
    lib, at = library(), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_blocks"](spark, ROOT).collect()}
    for r in sorted(spark.read.parquet(f"{ROOT}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = lib.encode(r.text, add_special_tokens=False).ids + [0]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@given(st.text(alphabet=st.sampled_from("<>/\\[]INSTs ab")))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_masks_follow_spans():
    offsets = np.array([[0, 2], [2, 3], [3, 3], [3, 4], [3, 4], [4, 9]])
    assert chat.mask_of(offsets, [(2, 3), (4, 5)]).tolist() == [0, 1, 0, 0, 0, 1]
    assert chat.mask_of(offsets, [(3, 4), (5, 5)]).tolist() == [0, 0, 0, 1, 1, 0]
    assert chat.mask_of(np.zeros((0, 2), int), [(0, 1)]).tolist() == []


def test_chats_of_awkward_rows(spark, monkeypatch):
    ready(spark)
    rows = [(1, 0, "user", "<s>a</s> <|endoftext|>"), (1, 1, "assistant", "[INST] <"), (1, 1, "assistant", "s>é日\n"), (1, None, None, None), (2, 0, "assistant", None),
            (None, 3, "[/INST]", "x" * 50_000), (None, 4, "assistant", "y"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} ") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("x", "x").selectExpr("*", "'e' AS part", "1 AS seq")
    for size in (1 << 20, 200):
        monkeypatch.setattr(chat, "BLOCK_CHARS", size)
        path = fresh_path(spark, "test")
        chat.write_chats(df.repartition(5), path, BPE)
        got = {r.conv_id: r for r in chat.read_chats(spark, path, BPE).collect()}
        assert set(got) == {1, 2, 3, 9, None}
        for key, r in got.items():
            turns = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
            loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
            assert r.n_turns == len(turns)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert r.formatted_chars == len(chat.render([(x[2] or "", x[3] or "") for x in turns])[0])
    path = fresh_path(spark, "test")
    chat.write_chats(df.limit(0), path, BPE)
    assert chat.read_chats(spark, path, BPE).count() == 0


PAGES = [(1, "http://a/\r\nX: y", "é" * 600), (2, None, "é" * 600), (2, None, "é" * 600), (None, "u", "é" * 600), (5, "http://a/5", "short"), (6, "http://a/6", "short"), (7, "http://a/7", None)]


def archive(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' AS `row`", "1 AS `Address`")
    path = fresh_path(spark, "test")
    warc.write_archive(df, path)
    return path, warc.read_archive(spark, path).collect()


def test_archive_round_trip(spark):
    path, got = archive(spark, PAGES)
    assert len(got) == len(PAGES)
    big = [r for r in got if r.payload_bytes == 1200]
    assert sorted(r.record_type for r in big) == ["response", "revisit", "revisit", "revisit"]
    assert {r.page_id for r in big if r.record_type == "response"} == {2} and {r.refers_to for r in big if r.record_type == "revisit"} == {2}
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 1000)
    for r in got:
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        body = rest[:int(fields["Content-Length"])]
        assert rest[len(body):] == b"\r\n\r\n" and fields["WARC-Type"] == r.record_type
        if r.record_type == "response":
            assert hashlib.sha1(body.partition(b"\r\n\r\n")[2]).hexdigest() == r.payload_digest == fields["WARC-Payload-Digest"][5:]
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    assert archive(spark, [])[1] == []


def test_a_changed_payload_is_an_error(spark):
    path, _ = archive(spark, PAGES)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("address", "CAST('other' AS BINARY) AS payload")
    bad.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(PySparkException, match="payload differs"):
        warc.read_archive(spark, f"{path}-bad").collect()


def test_op3_reads_its_columns_from_rebuilt_records(spark):
    path, got = archive(spark, PAGES)
    records = warc.read_archive(spark, path)
    want = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    assert Counter(map(tuple, warc.captures(records).collect())) == want
    other = records.withColumn("record", F.encode(F.replace(F.decode("record", "utf-8"), F.lit("short"), F.lit("longer")), "utf-8"))
    assert {r.payload_digest for r in warc.captures(other).collect() if r.page_id in (5, 6)} == {hashlib.sha1(b"longer").hexdigest()}
    plan = QUERIES["op3_warc_archive"](spark, ROOT)._jdf.queryExecution().optimizedPlan().toString()
    assert "http_header" in plan  # pruned away before, when no record was rebuilt


def test_exported_files_are_warc(spark):
    path, got = archive(spark, PAGES)
    warc.export_warc(warc.read_archive(spark, path), f"{path}-warc")
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}-warc/part-*").collect())
    assert len(re.findall(rb"WARC/1\.1\r\n", raw)) == len(got)
    assert sorted(b"WARC/1.1\r\n" + x for x in raw.split(b"WARC/1.1\r\n")[1:]) == sorted(bytes(r.record) for r in got)


def test_archived_payloads_are_shuffled_once(spark):
    path, got = archive(spark, PAGES)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.read_archive(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # before, the join shuffled all payloads again; now only those that several records share
    assert len(re.findall(r"Bucketed: true", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning\(address", plan)) == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weftwork_")]
    assert {bytes(r.payload) for r in got} == {(p[2] or "").encode() for p in PAGES}


def test_equal_short_payloads_are_responses_and_stored_once(spark):
    path, got = archive(spark, [(i, f"http://x/{i}", "same") for i in range(300)] + [(i, None, None) for i in range(300, 310)])
    assert len(got) == 310 and {(r.record_type, r.refers_to) for r in got} == {("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 2
