"""Token ids in binary files: patched frame-of-reference blocks with exception lists and an index of block starts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm.common import col, process_cache, query, read
from weftwork.session import fresh_path

BLOCK = 128             # ids a block
PERCENTILE = 0.9        # share of a block's ids that must fit the packed width
SEGMENT_IDS = 1 << 20   # ids after which a segment ends; a longer document makes a longer segment
CHUNK = 4 << 20         # bytes of text encoded at once
BATCH = 30_000          # new pieces that the library encodes at once, which takes a hundred bytes or more an id
ROOM = 400_000          # pieces whose ids a worker remembers
END = 0
MAGIC = b"PFOR1\0\0\0"
_HEAD = "<8sIII"  # magic, documents, ids, blocks
_FRONT = 6                       # bytes before a block's packed ids: minimum (4), width (1), exceptions (1)


class Encoder:
    """Encodes whole texts with a byte-level BPE file, remembering the ids of pieces between single blanks.

    Pre-tokens of such a file never reach across a single blank or line feed that stands between two characters
    which are not white space, so the pieces cut at those places have the ids they have inside the text. A text
    with any other white space, or with an added token of the file (which is one id), is encoded whole by the library.
    Texts are cut, their pieces told apart and ids put in place by Arrow and numpy; the library encodes each piece
    the first time it is met, a chunk's new pieces as one text.
    """

    _odd = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  |\n\n| \n|\n |\\A[ \n]|[ \n]\\z"

    def __init__(self, path: str, room: int = ROOM):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.feed = self._ids("\n")
        self.stops = {c: self._ids(c) for c in ".,"}
        if any(len(x) != 1 for x in [self.feed, *self.stops.values()]):
            raise ValueError("line feed, full stop and comma are not one id each in this file")
        self.room = room
        # What is known: pieces, where their ids stand in ``flat``, and how often each was used.
        self.known = pa.array(["", "\n"], pa.string())
        self.lengths, self.uses = np.array([0, 1]), np.array([2, 2])
        self.starts, self.flat = np.array([0, 0]), self.feed.copy()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat((self.starts[numbers] - (ends - lengths)).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)   # both far below two billion: chunks and what is known are bounded
        return self.flat[at]

    def _add(self, pieces: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, pieces])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths, self.uses = np.concatenate([self.lengths, lengths]), np.concatenate([self.uses, np.zeros(len(pieces), np.int64)])
        self.flat = np.concatenate([self.flat, ids])

    def _forget(self) -> None:
        """What has been used once goes; everything, if that would leave more than half of the room."""
        kept = self.uses > 1
        if np.count_nonzero(kept) > self.room // 2:
            kept = np.arange(len(kept)) < 2
        numbers = np.flatnonzero(kept)
        self.flat, self.known = self._gather(numbers), self.known.take(pa.array(numbers))
        self.lengths, self.uses = self.lengths[numbers], self.uses[numbers]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of different pieces, learning the new ones.

        New pieces are encoded as one text, a line each; a full stop or comma behind an ASCII letter is a pre-token of its own.
        """
        import pyarrow.compute as pc

        find = lambda x, there: pc.fill_null(pc.index_in(x, there), -1).to_numpy().astype(np.int64)
        closes = pc.match_substring_regex(pieces, r"[A-Za-z][.,]\z")
        closed = np.flatnonzero(closes.to_numpy(zero_copy_only=False))
        stems = pc.utf8_slice_codeunits(pieces.filter(closes), 0, -1)
        found = find(pa.concat_arrays([pieces, stems]), self.known)   # one search, as it hashes all that is known
        numbers, stem = found[:len(pieces)], found[len(pieces):]
        new = numbers < 0
        ends_new = new[closed]
        plain = np.flatnonzero(new & ~closes.to_numpy(zero_copy_only=False))
        fresh = pc.unique(pa.concat_arrays([pieces.take(pa.array(plain)), stems.filter(pa.array(ends_new & (stem < 0)))]))
        if len(fresh):
            base = len(self.known)
            made = []
            for at in range(0, len(fresh), BATCH):
                lines = fresh.slice(at, BATCH)
                ids = self._ids("\n".join(lines.to_numpy(zero_copy_only=False)))
                feeds = np.flatnonzero(ids == self.feed[0])
                if len(feeds) != len(lines) - 1:
                    raise ValueError("the tokenizer does not keep lines apart")
                made.append((np.diff(feeds, prepend=-1, append=len(ids)) - 1, np.delete(ids, feeds)))
            self._add(fresh, *map(np.concatenate, zip(*made)))
            numbers[plain] = base + find(pieces.take(pa.array(plain)), fresh)
            stem = np.where(stem < 0, base + find(stems, fresh), stem)
        for stop, of in self.stops.items():
            mine = ends_new & pc.ends_with(pieces.take(pa.array(closed)), stop).to_numpy(zero_copy_only=False)
            if mine.any():
                numbers[closed[mine]] = len(self.known) + np.arange(np.count_nonzero(mine))
                lengths = self.lengths[stem[mine]]
                self._add(pieces.take(pa.array(closed[mine])), lengths + 1, np.insert(self._gather(stem[mine]), np.cumsum(lengths), of[0]))
        return numbers

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = pc.match_substring_regex(texts, self._odd)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        out: list[bytes | None] = [None] * len(texts)
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = self._ids(texts[int(i)].as_py()).tobytes()
        plain = [i for i in range(len(texts)) if out[i] is None]
        for i, raw in zip(plain, self._encode(texts.filter(pc.invert(whole)))):
            out[i] = raw
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        """``encode`` for texts without odd places. A very long one is cut before blanks and goes through in parts."""
        import pyarrow.compute as pc

        parts, of, later = [], [], []
        for i, size in enumerate(pc.binary_length(texts).to_pylist()):
            if size <= CHUNK:
                continue
            text, at = texts[i].as_py(), 0
            while at < len(text):
                cut = text.find(" ", at + CHUNK // 4)
                end = len(text) if cut < 0 else cut
                parts.append(text[at:end])
                of.append(i)
                later.append(at > 0)
                at = end + 1
        if not parts:
            return self._cut(texts, None)
        raws: list[list[bytes]] = [[] for _ in range(len(texts))]
        short = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) <= CHUNK)
        for i, raw in zip(short, self._cut(texts.take(pa.array(short)), None)):
            raws[i].append(raw)
        for i, part, behind in zip(of, parts, later):
            raws[i] += self._cut(pa.array([part]), behind)
        return [b"".join(r) for r in raws]

    def _cut(self, texts: pa.Array, behind: bool | None) -> list[bytes]:
        """Ids of texts a piece at a time; ``behind``: a blank stood before the (one) text."""
        import pyarrow.compute as pc

        if not len(texts):
            return []
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        words = rows.flatten().dictionary_encode()
        codes, names = words.indices.to_numpy(), words.dictionary
        starts = rows.offsets.to_numpy()[:-1] - rows.offsets[0].as_py()
        feeds = codes == pc.index(names, "\n").as_py()
        bare = feeds.copy()                      # pieces without a blank before them: line feeds and what begins a line or text
        bare[1:] |= feeds[:-1]
        if not behind:
            bare[starts] = True
        both = np.where(bare, codes, codes + len(names))
        used = np.bincount(both, minlength=2 * len(names))
        there = np.flatnonzero(used)
        pieces = pa.concat_arrays([names, pc.binary_join_element_wise(pa.scalar(""), names, " ")]).take(pa.array(there))
        if len(self.known) > self.room:
            self._forget()
        numbers = self._numbers(pieces)
        self.uses[numbers] += used[there]
        place = np.zeros(2 * len(names), np.int32)
        place[there] = numbers
        number = place[both]
        ends = np.cumsum(self.lengths[number])
        flat = self._gather(number).tobytes()
        cuts = [0, *(4 * ends[np.append(starts[1:], len(ends)) - 1]).tolist()]
        pa.default_memory_pool().release_unused()
        return [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:])]


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    cache = process_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """(block starts with the end, bytes) of ids in blocks of BLOCK; the last block is filled up with its last id.

    A block holds its minimum, the width that fits ``percentile`` of (id - minimum), the differences that fit as planes of one
    bit an id, and for ids that need more bits their places and full differences.
    """
    if not len(ids):
        return np.zeros(1, "<u4"), np.zeros(0, "u1")
    blocks = -(-len(ids) // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1], np.int64)
    grid[:len(ids)] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(1)
    over = grid - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.ceil(np.log2(np.partition(over, at, 1)[:, at] + 1)).astype(np.int64)
    odd = over >= (1 << width)[:, None]
    odds = odd.sum(1)
    size = _FRONT + width * (BLOCK // 8) + 5 * odds
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], "u1")
    front = starts[:-1, None] + np.arange(_FRONT)
    out[front[:, :4]] = low.astype("<u4").view("u1").reshape(blocks, 4)
    out[front[:, 4]], out[front[:, 5]] = width, odds
    small = np.where(odd, 0, over).astype("<u4" if width.max() > 16 else "<u2")
    for bit in range(int(width.max())):  # one plane of bits after the other
        of = np.flatnonzero(width > bit)
        plane = np.packbits((small[of] >> small.dtype.type(bit)).astype("u1") & 1, axis=1, bitorder="little")
        out[(starts[of] + _FRONT + bit * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)] = plane
    row, place = np.nonzero(odd)
    if len(row):
        lists = starts[:-1] + _FRONT + width * (BLOCK // 8)
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(odds)])[row]
        out[lists[row] + nth] = place
        out[(lists[row] + odds[row] + 4 * nth)[:, None] + np.arange(4)] = over[row, place].astype("<u4").view("u1").reshape(-1, 4)
    return starts.astype("<u4"), out


def unpack(starts: np.ndarray, data: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` up to ``last`` (all: None), reading only those blocks."""
    starts = starts.astype(np.int64)[first:None if last is None else last + 1]
    blocks = len(starts) - 1
    if blocks <= 0:
        return np.zeros(0, np.int64)
    at = starts[:-1]
    low = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel()
    width, odds = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for bit in range(int(width.max())):
        of = np.flatnonzero(width > bit)
        plane = np.unpackbits(data[(at[of] + _FRONT + bit * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)], axis=1, bitorder="little")
        grid[of] |= plane.astype(np.uint32) << np.uint32(bit)
    row = np.repeat(np.arange(blocks), odds)
    if len(row):
        lists = at + _FRONT + width * (BLOCK // 8)
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(odds)])[row]
        place = data[lists[row] + nth]
        grid[row, place] = np.ascontiguousarray(data[(lists[row] + odds[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    return (grid + low[:, None]).ravel()


def segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment: head, document ids (and which are NULL), lengths, block starts, blocks."""
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    starts, data = pack(flat)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], "u1"), bitorder="little")
    lengths = np.array([len(x) for x in ids], "<u4")
    head = struct.pack(_HEAD, MAGIC, len(docs), len(flat), len(starts) - 1)
    return b"".join([head, docs.tobytes(), null.tobytes(), lengths.tobytes(), starts.tobytes(), data.tobytes()])


class Segment:
    """Reads a segment; ``ids(a, b)`` touches only the blocks that hold ids a up to b."""

    def __init__(self, raw: bytes):
        magic, docs, self.n, blocks = struct.unpack_from(_HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize(_HEAD)
        ids = np.frombuffer(raw, "<i8", docs, at)
        at += 8 * docs
        null = np.unpackbits(np.frombuffer(raw, "u1", -(-docs // 8), at), bitorder="little")
        at += -(-docs // 8)
        self.docs = [None if null[i] else int(d) for i, d in enumerate(ids)]
        self.lengths = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.starts = np.frombuffer(raw, "<u4", blocks + 1, at)
        self.data = np.frombuffer(raw, "u1", -1, at + 4 * (blocks + 1))

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n if b is None else min(b, self.n)
        first = a // BLOCK
        return unpack(self.starts, self.data, first, -(-b // BLOCK))[a - first * BLOCK:b - first * BLOCK]


_SEGMENTS = "part int, seq int, n_docs bigint, n_ids bigint, bytes binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id="doc_id", text="text", end: int = END) -> None:
    """Encode every whole text, append ``end``, and write segments below ``path`` in ascending order of ``doc_id``.

    NULL ids come first, a NULL text is empty (its only id is ``end``), equal ids are ordered by a hash of the text.
    Tasks hold ranges of ids; within one, segments are numbered, so (part, seq) is the order of the files.
    An empty table gives no segment. Other columns are not read.
    """
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, seq, own = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        names, ids, held, tail = [], [], 0, np.array([end], "<u4").tobytes()

        def emit():
            nonlocal seq, names, ids, held
            raw = segment(names, ids)
            out = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(names), "n_ids": held, "bytes": raw}],
                                             pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.binary())]))
            seq, names, ids, held = seq + 1, [], [], 0
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            at = 0
            while at < len(keys):
                size, to = 0, at
                while to < len(keys) and (to == at or size + sizes[to] <= CHUNK):
                    size, to = size + sizes[to], to + 1
                for key, raw in zip(keys[at:to], own.encode(texts.slice(at, to - at))):
                    names.append(key)
                    ids.append(np.frombuffer(raw + tail, "<u4"))
                    held += len(ids[-1])
                    if held >= SEGMENT_IDS:
                        yield emit()
                at = to
        if names:
            yield emit()

    rows.mapInArrow(encode, _SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Read segments back: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    segments = spark.read.parquet(path)
    schema = "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    fields = [("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if ids else []

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = Segment(raw.as_py())
                flat, ends = s.ids().astype("<u4"), np.cumsum(s.lengths)
                spans = list(zip(ends - s.lengths, ends))
                columns = [[part] * len(spans), [seq] * len(spans), s.docs, [int(a) for a, _ in spans], s.lengths, [zlib.crc32(flat[a:b].tobytes()) for a, b in spans]]
                columns += [[flat[a:b] for a, b in spans]] if ids else []
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    rows = segments.select("part", "seq", "bytes").mapInArrow(decode, schema)
    meta = segments.select("part", "seq", "n_ids")
    upto = (Window.unboundedPreceding, -1)
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a task
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("ahead"))
    starts = (meta.withColumn("seen", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*upto)), F.lit(0)))
              .join(parts, "part").select("part", "seq", (F.col("ahead") + F.col("seen")).alias("first")))
    out = rows.join(starts, ["part", "seq"])
    return out.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


@query("op6_token_blocks")
def op6(spark, root):
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(read(spark, root, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, ids=False)
