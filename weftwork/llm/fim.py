"""Fill-in-middle: a text is cut in three and its blocks change places inside one buffer, by rotations that are undone exactly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, query, read

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE = 90      # of 100 texts, those that are transformed
SPM = 20       # of 100 transformed texts, those with the suffix first
SEED = 1
CHUNK = 1 << 20   # bytes looked at or exchanged at once, so that a very long text needs little beyond itself

_OUT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(raw: np.ndarray, before: int | None = None) -> np.ndarray:
    """Where units start in UTF-8 bytes: a run of ASCII letters or any other code point. ``before``: the byte ahead of ``raw``."""
    letter = _LETTER[raw]
    inside = (raw & 0xC0) == 0x80
    inside[1:] |= letter[1:] & letter[:-1]
    if before is not None and len(raw):
        inside[0] |= letter[0] & _LETTER[before]
    return np.flatnonzero(~inside)


def scan(raw: np.ndarray, wanted: Callable[[int], list[int]]) -> tuple[int, list[int]]:
    """(number of units n, byte offsets of the unit numbers that ``wanted`` gives for n); unit n is the end.

    Two passes over chunks: one counts, the other finds, so nothing of the size of the text is kept.
    """
    def piece(at: int) -> np.ndarray:
        return unit_starts(raw[at:at + CHUNK], int(raw[at - 1]) if at else None)

    if len(raw) <= CHUNK:
        starts = unit_starts(raw)
        return len(starts), [int(starts[u]) if u < len(starts) else len(raw) for u in wanted(len(starts))]
    counts = [len(piece(at)) for at in range(0, len(raw), CHUNK)]
    n = sum(counts)
    units = wanted(n)
    ends = np.cumsum([0, *counts])
    found = {n: len(raw)}
    for i in {int(np.searchsorted(ends, u, "right")) - 1 for u in units if u < n}:
        starts = piece(i * CHUNK)
        found |= {u: i * CHUNK + int(starts[u - ends[i]]) for u in units if ends[i] <= u < ends[i + 1]}
    return n, [found[u] for u in units]


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverse ``view[a:b]`` where it lies; a chunk of each end at a time."""
    while b - a > 1:
        k = min(CHUNK, (b - a) // 2)
        head = view[a:a + k].copy()
        view[a:a + k] = view[b - k:b][::-1]
        view[b - k:b] = head[::-1]
        a, b = a + k, b - k


def rotate(buffer: bytearray, a: int, b: int, c: int) -> None:
    """Exchange the neighbouring segments ``a:b`` and ``b:c`` of ``buffer`` by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, a, b)
    reverse(view, b, c)
    reverse(view, a, c)


def transform(buffer: bytearray, cut1: int, cut2: int, form: str) -> None:
    """Turn prefix|middle|suffix, cut at two byte offsets, into ``form``: psm is P S M, spm is S P M, each behind its sentinel."""
    buffer[cut2:cut2] = SUFFIX
    buffer[cut1:cut1] = MIDDLE
    buffer[0:0] = PREFIX
    middle = cut1 + len(PREFIX)
    suffix = cut2 + len(PREFIX) + len(MIDDLE)
    end = len(buffer)
    rotate(buffer, middle, suffix, end)                                # P S M
    if form == "spm":
        rotate(buffer, 0, middle, middle + end - suffix)               # S P M


def restore(buffer: bytearray, form: str) -> None:
    """Undo ``transform``. The text holds no sentinel and none overlaps itself or another, so the first of each is the inserted one."""
    if form == "spm":
        rotate(buffer, 0, buffer.index(PREFIX), buffer.index(MIDDLE))
    suffix, middle = buffer.index(SUFFIX), buffer.index(MIDDLE)
    end = len(buffer)
    rotate(buffer, suffix, middle, end)                                # P M S
    second = suffix + end - middle
    del buffer[second:second + len(SUFFIX)]
    del buffer[suffix:suffix + len(MIDDLE)]
    del buffer[:len(PREFIX)]


def _texts(column: pa.Array):
    """The UTF-8 bytes of each text of an Arrow column, without a copy."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, "<i8", len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield raw[a:b]


def _chars(raw) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _rearranged(rate: int, spm: int):
    def run(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        out = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "output")}
        for raw, a, b, c, d in zip(_texts(texts), *[h.to_pylist() for h in (h1, h2, h3, h4)]):
            n, cuts = scan(raw, lambda n: sorted((a % (n + 1), b % (n + 1))))
            buffer = bytearray(raw)
            form, counts = "plain", (None, None)
            if n and c % 100 < rate and not any(s in buffer for s in (PREFIX, SUFFIX, MIDDLE)):
                form = "spm" if d % 100 < spm else "psm"
                counts = _chars(raw[:cuts[0]]), _chars(raw[cuts[0]:cuts[1]])
                transform(buffer, *cuts, form)
            for name, value in zip(out, (n, form, *counts, buffer)):
                out[name].append(value)
        arrays = [pa.array(values, pa.binary()).cast(f.type) if f.name == "output" else pa.array(values, f.type) for values, f in zip(out.values(), _OUT)]
        return pa.StructArray.from_arrays(arrays, fields=list(_OUT))
    return F.arrow_udf(run, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    out = []
    for raw, form in zip(_texts(outputs), forms.to_pylist()):
        buffer = bytearray(raw)
        if form not in (None, "plain"):
            restore(buffer, form)
        out.append(buffer)
    return pa.array(out, pa.binary()).cast(pa.string())


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws a row: the first groups of eight digits of a hash of seed and id (a NULL id: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, doc_id="doc_id", text="text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with ``n`` (units of the text), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (NULL if plain) and ``output`` added last.

    Each row is on its own: nothing is shuffled. A NULL text is empty; empty texts and those that hold a sentinel stay plain.
    Rows that share an id and a text have one output, rows with a NULL id share their draws. Very long texts are cut,
    counted and exchanged in chunks inside one buffer. A clashing column of ``docs`` keeps its name, the new one gets an underscore.
    """
    made = _rearranged(int(rate), int(spm))(F.coalesce(col(text), F.lit("")), *draws(col(doc_id), seed))
    s = free(docs, "_fim")
    return (docs.withColumn(s, made)
            .select(*[col(c) for c in docs.columns], *[F.col(s)[f.name].alias(free(docs, f.name)) for f in _OUT]))


def restored(output: Column, form: Column) -> Column:
    """The exact text that ``fill_in_middle`` turned into ``output``, from the output and its form alone; NULL counts as empty."""
    return F.arrow_udf(_restored, "string")(F.coalesce(output, F.lit("")), form)


_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f
"""


@query("op11_middle_rotation", _SQL)
def op11(spark, root):
    out = fill_in_middle(read(spark, root, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
