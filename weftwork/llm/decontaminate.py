"""Benchmark decontamination by pigeonhole edit matching: exact hits of pieces, verified with Myers' bit-parallel distance."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, query, read, stage, stream_udf

RATE = 0.1            # errors allowed a byte of an item
MIN_BYTES = 20        # a shorter item is easily near ordinary text, so it is searched exactly, as whole words
BLOCK_BYTES = 1 << 20  # bytes of items searched at once; more items take more passes over the documents

_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> str:
    """Lower-cased text whose ASCII punctuation and white space are single blanks, as UTF-8 bytes in a one-byte string."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()).decode("latin-1")


def whole_words(text: str, min_bytes: int = MIN_BYTES) -> str:
    """A normal text of less than ``min_bytes`` marked by a line break, which no normal text holds; others as they are."""
    return f"\n{text}" if 0 < len(text) < min_bytes else text


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of ``text``, end of the first such substring)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return best, end


def _parts(left: str, right: str, errors: int) -> tuple[str, ...]:
    """Parts of what stands around an exact piece, one more than the errors it may hold: in a match one is unchanged."""
    n = len(left) + len(right)
    parts = []
    for side in (left, right):
        k = -(-errors * len(side) // n)
        parts += [side[i * len(side) // k:(i + 1) * len(side) // k] for i in range(k)]
    return tuple(parts)


class Items:
    """The pieces of a block of test items in one automaton, and the tree of joined pieces that verifies a hit.

    An item of m bytes has a budget of k = rate·m errors and k + 1 pieces, one of which any match holds unchanged. Pieces are joined in
    pairs up to the item; a run of p pieces may hold p - 1 errors. If a run matches within its budget so does one of its
    halves, so a match shows on the whole way up from some piece, and chance hits end after a short comparison.
    An item that `whole_words` marked has no budget: it is one piece, with a blank at each end.
    """

    def __init__(self, items: list[tuple[list[int | None], str]], rate: float = RATE):
        import ahocorasick

        self.items, self.exact, at = [], set(), defaultdict(list)
        for number, (ids, text) in enumerate(items):
            k = int(rate * len(text))
            if text.startswith("\n"):
                k, text = 0, f" {text[1:]} "
                self.exact.add(number)
            edges = [i * len(text) // (k + 1) for i in range(k + 2)]
            ways: list[list[tuple]] = [[] for _ in range(k + 1)]

            def join(i, j):
                if j - i > 1:
                    join(i, (i + j) // 2)
                    join((i + j) // 2, j)
                    for p in range(i, j):
                        ways[p].append((i, j))

            join(0, k + 1)
            for p, way in enumerate(ways):
                if way:
                    i, j = way[0]
                    way[0] = (i, j, _parts(text[edges[i]:edges[p]], text[edges[p + 1]:edges[j]], j - i))
                    way[1:] = [(i, j, ()) for i, j in way[1:]]
            self.items.append((ids, text, k, edges, ways))
            for p in range(k + 1):
                at[text[edges[p]:edges[p + 1]]].append((number, p))
        self.automaton = ahocorasick.Automaton()
        for piece, hits in at.items():
            self.automaton.add_word(piece, (len(piece), hits))
        self.automaton.make_automaton()
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}

    def _near(self, number: int, i: int, j: int, text: str, start: int) -> tuple[int, int]:
        """Distance and end of pieces i to j of an item around the place ``start`` where piece i should begin."""
        _, item, _, edges, _ = self.items[number]
        pattern = item[edges[i]:edges[j]]
        budget = j - i - 1
        left = max(0, start - budget)
        window = text[left:start + len(pattern) + budget]
        if pattern in window:
            return 0, left + window.index(pattern) + len(pattern)
        masks = self.masks.get((number, i, j))
        if masks is None:
            masks = self.masks[number, i, j] = masks_of(pattern)
        distance, end = myers(masks, len(pattern), window)
        return distance, left + end

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of the best match of each item in a normal text: the least distance, then the first end."""
        best: dict[int, tuple[int, int]] = {}
        tried = set()
        for last, (size, hits) in self.automaton.iter(text):
            begin = last + 1 - size
            for number, p in hits:
                ids, item, k, edges, ways = self.items[number]
                for i, j, parts in ways[p]:
                    start = begin - (edges[p] - edges[i])
                    if parts:
                        window = text[max(0, start - j + i):begin + edges[j] - edges[p] + j - i]
                        if not any(x in window for x in parts):
                            break
                    if j - i == k + 1:
                        if (number, start) in tried:
                            break
                        tried.add((number, start))
                    distance, end = self._near(number, i, j, text, start)
                    if distance > j - i - 1:
                        break
                    if j - i == k + 1 and (number not in best or (distance, end) < best[number]):
                        best[number] = (distance, end)
                if not k and number not in best:
                    best[number] = (0, last + (number not in self.exact))
        return [(number, d, e) for number, (d, e) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_id="item_id", text="text", block_bytes: int = BLOCK_BYTES, min_bytes: int = MIN_BYTES):
    """Lists of (item ids, normal text) of about ``block_bytes`` each: what one pass searches, and what a task holds."""
    def plain(texts):
        import pandas as pd

        return pd.Series([whole_words(normal(t), min_bytes) for t in texts])

    items = benchmark.select(col(item_id).cast("bigint").alias("item_id"), F.pandas_udf(plain, "string")(col(text)).alias("text"))
    items = stage(items.where(F.length("text") > 0), "items")
    blocks = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_bytes
    for b in range(blocks):
        own = defaultdict(list)
        for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).toLocalIterator():  # block_bytes
            own[r["text"]].append(r["item_id"])
        if own:
            yield [(sorted(ids, key=lambda x: (x is None, x)), t) for t, ids in sorted(own.items())]


_HITS = "array<struct<item_id:bigint,distance:int,budget:int,end:bigint>>"


def _searcher(items: list[tuple[list[int | None], str]], rate: float):
    def search(batches):
        import pandas as pd

        own = Items(items, rate)
        for texts in batches:
            out = []
            for t in texts:
                found = own.search(f" {normal(t)} ") if t else []
                out.append([{"item_id": i, "distance": d, "budget": own.items[n][2], "end": e} for n, d, e in found for i in own.items[n][0]])
            yield pd.Series(out)

    return stream_udf(search, _HITS)


def leaks(docs: DataFrame, benchmark: DataFrame, text="text", rate: float = RATE, item_id="item_id", item_text="text") -> DataFrame:
    """A row for each row of ``docs`` and test item whose text it holds within ``rate`` errors a byte.

    The columns of ``docs`` without the text, then ``item_id``, ``distance``, ``budget`` and ``end`` (of the match in the normal text). Case,
    punctuation and blanks don't count. NULL and empty texts hold nothing; an item whose normal text is below MIN_BYTES must be
    there exactly, as whole words (``budget`` 0); an item without letters, digits and non-ASCII characters has no normal text and is in no row; items with
    equal texts are all named; repeated rows of ``docs`` are found each on its own. No document or no item: no rows.
    """
    rest = [c for c in docs.columns if c != text]
    hits = free(docs, "_hits")
    out = None
    for items in item_blocks(benchmark, item_id, item_text):
        one = docs.withColumn(hits, F.explode(_searcher(items, rate)(col(text))))
        one = one.select(*[col(c) for c in rest], *[F.col(f"{hits}.{n}").alias(free(docs.drop(text), n)) for n in ("item_id", "distance", "budget", "end")])
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.limit(0).select(*[col(c) for c in rest], *[F.lit(None).cast(t).alias(free(docs.drop(text), n)) for n, t in (("item_id", "bigint"), ("distance", "int"), ("budget", "int"), ("end", "bigint"))])
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text="text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, columns unchanged; each block of items filters what the one before left."""
    for n, items in enumerate(item_blocks(benchmark), 1):
        docs = docs.where(F.size(_searcher(items, rate)(col(text))) == 0)
        if n % 8 == 0:
            docs = stage(docs, "clean")
    return docs


@query("op5_pigeonhole_leaks")
def op5(spark, root):
    return leaks(read(spark, root, "documents").select("doc_id", "text"), read(spark, root, "benchmark"))
