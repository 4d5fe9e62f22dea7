"""Chat formatting with offset-aligned masks: render, encode once with offsets, intersect turn spans with token spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import col, process_cache, query, read
from weftwork.session import fresh_path

# The control strings of the template.
OPEN, CLOSE, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (OPEN, CLOSE, ROLE, TEXT)
BLOCK_CHARS = 1 << 20  # a longer conversation is rendered in several blocks, cut between turns

_MARK = re.compile(r"(</?|\[/?)(\\*)(s>|INST\])")
_MARKED = re.compile(r"(</?|\[/?)\\(\\*)(s>|INST\])")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    """Add one backslash inside whatever is a control string up to backslashes; no control string is left."""
    return _MARK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _MARKED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted text of (role, text) turns and the sorted spans (start, end, role) of the texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        front, body = f"{OPEN}{ROLE}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(front), at + len(front) + len(body), role))
        parts += [front, body, CLOSE]
        at += len(front) + len(body) + len(CLOSE)
    return "".join(parts), spans


def mask_of(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for tokens that share a character with a span; both sides are sorted, so each span is two binary searches."""
    mask = np.zeros(len(offsets), "u1")
    if len(offsets):
        spans = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
        first, last = np.searchsorted(offsets[:, 1], spans[:, 0], "right"), np.searchsorted(offsets[:, 0], spans[:, 1], "left")
        step = np.zeros(len(offsets) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, last, -1)
        mask[:] = np.cumsum(step[:-1]) > 0
    return mask


def chat_tokenizer(path: str):
    """The file's tokenizer with the control strings as tokens of their own; its special strings are ordinary text."""
    cache = process_cache()
    if ("chat", path) not in cache:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.add_tokens([AddedToken(c, special=False, normalized=False) for c in CONTROL])
        cache["chat", path] = t
    return cache["chat", path]


_BLOCKS = [("part", pa.int32()), ("seq", pa.int32()), ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("ids", pa.binary()), ("loss_mask", pa.binary())]


def write_chats(conversations: DataFrame, path: str, tokenizer: str, conv_id="conv_id", turn="turn", role="role", text="text", loss_role="assistant") -> None:
    """Format all conversations as token ids with a loss mask (one bit a token) and write them below ``path``.

    Turns are ordered by ``turn`` (NULL first), ties by role and text. NULL roles and texts are empty; rows with a NULL
    ``conv_id`` form one conversation. Rows are range-partitioned by conversation and turn, so a huge conversation spans
    tasks; a task renders runs of up to BLOCK_CHARS characters, cut between turns, where the control tokens
    keep ids independent. Repeated rows are turns of their own; an empty table gives no block.
    """
    rows = conversations.select(col(conv_id).cast("bigint").alias("conv_id"), col(turn).cast("bigint").alias("turn"),
                                F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, seq = chat_tokenizer(tokenizer), TaskContext.get().partitionId(), 0

        def block(key, turns):
            formatted, spans = render(turns)
            done = own.encode(formatted, add_special_tokens=False)
            offsets = np.array(done.offsets, np.int64).reshape(-1, 2)
            mask = mask_of(offsets, [(a, b) for a, b, r in spans if r == loss_role])
            values = [part, seq, key, len(turns), np.array(done.ids, "<u4").tobytes(), np.packbits(mask).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _BLOCKS)], names=[n for n, _ in _BLOCKS])

        key, turns, size = None, [], 0
        for batch in batches:
            for k, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if turns and (k != key or size >= BLOCK_CHARS):
                    yield block(key, turns)
                    seq, turns, size = seq + 1, [], 0
                key, size = k, size + len(r) + len(t)
                turns.append((r, t))
        if turns:
            yield block(key, turns)

    rows.mapInArrow(encode, "part int, seq int, conv_id bigint, n_turns bigint, ids binary, loss_mask binary").write.parquet(path)


def read_chats(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Decode the blocks and digest each conversation: ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    A digest of a whole conversation needs its turns in order, so its blocks stream through one task, one block in memory at a time.
    """
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, state, done = chat_tokenizer(tokenizer), None, None, []

        def result():
            n, turns, chars, loss, size = state
            return (key, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        def table():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*done), fields)], names=[n for n, _ in fields])

        for batch in batches:
            for k, raw, bits in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss_mask")):
                if state is None or k != key:
                    if state is not None:
                        done.append(result())
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw.as_py(), "<u4")
                mask = np.unpackbits(np.frombuffer(bits.as_py(), "u1"))[:len(ids)]
                formatted = own.decode(ids.tolist(), skip_special_tokens=False)
                state[4] += len(formatted)
                for role, text in _TURN.findall(formatted):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                for a, b in edges.reshape(-1, 2):
                    text = unescape(own.decode(ids[a:b].tolist(), skip_special_tokens=False))
                    state[2] += len(text)
                    state[3].update(text.encode())
            if len(done) >= 1000:
                yield table()
                done = []
        if state is not None:
            done.append(result())
            yield table()

    blocks = spark.read.parquet(path).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return blocks.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_ESCAPES = r"len(regexp_extract_all({0}, '(</?|\[/?)(\\*)(s>|INST\])'))"
_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + {_ESCAPES.format('role')} + {_ESCAPES.format('text')} + {sum(map(len, CONTROL))}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op4_chat_masks", _SQL)
def op4(spark, root):
    import public_tokenizers

    path, tokenizer = fresh_path(spark, "chats"), public_tokenizers.path("byte_bpe_50k.json")
    turns = read(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    text = CLOSE + ROLE + " ok " + TEXT
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    write_chats(turns.unionByName(own), path, tokenizer)
    return read_chats(spark, path, tokenizer)
