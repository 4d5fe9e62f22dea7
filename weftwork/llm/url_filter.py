"""URL filter: a Bloom filter cascade that is exact over the corpus's keys, asked as an expression instead of a join."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, query, read, stage

BITS = 16                # bits a key of a level
HASHES = 5               # of them set by a key
FILTER_BYTES = 16 << 20  # largest cascade that is put into an expression; beyond it keys are joined
DEPTHS = 16              # most different numbers of labels of listed keys that are put into one
LEVELS = 64              # far more than any cascade of two disjoint sets takes

# Rules (verdict, host, path) that come before the cascade.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Words that put a host on the list of the registered query.
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path): behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end.

    A NULL URL and one without ``://`` have two empty texts.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or a parent of it and whose path starts the URL's; else NULLs.

    The text of a rule is its host and path. Of equal length the first in order of the text wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):  # the last that fits wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, does).otherwise(verdict)
    return rule, verdict


def parents(host: Column) -> Column:
    """A host and its parent domains, the host first: ``a.b.c``, ``b.c``, ``c``; none for an empty host."""
    labels = F.split(host, r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


class Cascade:
    """Levels of Bloom filters over two disjoint sets of keys; ``holds(key)`` tells for each key of either whether it is listed.

    Level 1 holds the listed keys, level 2 the other keys that level 1 lets through, level 3 the listed keys that level 2
    lets through, and so on until a level lets nothing wrong through. A key's answer is the parity of
    the first level that does not know it. Each set is a small share of the one before last, so a few levels do.
    """

    def __init__(self, listed: DataFrame, others: DataFrame, limit: int = FILTER_BYTES):
        """``listed``, ``others``: one column of distinct keys each, none in both. ``fits`` is false when the filters would pass ``limit`` bytes."""
        self.levels: list[tuple[DataFrame, int]] = []        # (one array of words, their number)
        self.sizes: list[int] = []                           # keys a level holds
        self.bytes, self.fits = 0, True
        inside, outside = stage(listed.toDF("key"), "listed"), stage(others.toDF("key"), "others")
        n = inside.count()
        while n:
            if len(self.levels) == LEVELS:
                raise RuntimeError("a Bloom filter cascade did not end: are keys in both sets?")
            size = math.ceil(n * BITS / 64)
            self.bytes += 8 * size
            if self.bytes > limit:
                self.fits = False
                return
            self.levels.append((stage(words(inside, len(self.levels), size), "level"), size))
            self.sizes.append(n)
            wrong = stage(outside.where(self.known(F.col("key"), len(self.levels) - 1)), "wrong")
            inside, outside, n = wrong, inside, wrong.count()

    def known(self, key: Column, level: int) -> Column:
        """Whether a level has all bits of the key; its words are a scalar subquery, which Spark runs once a job."""
        filter_, size = self.levels[level]
        word, mask = place(key, level, size)
        return F.get(filter_.scalar(), word).bitwiseAND(mask) == mask

    def holds(self, key: Column) -> Column:
        """Whether a key of the two sets is listed: an expression over the filters, no join. NULL is not."""
        answer = F.lit(len(self.levels) % 2 == 1)            # known to all levels
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.known(key, i), F.lit(i % 2 == 1)).otherwise(answer)
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def place(key: Column, level: int, size: int) -> tuple[Column, Column]:
    """(word, mask): a level keeps all HASHES bits of a key in one of its ``size`` words, so that a test reads one word."""
    one, two = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    mask = F.lit(0).cast("bigint")
    for i in range(HASHES):                                  # six bits of the second hash are the place of one bit
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(two, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(one, F.lit(size)).cast("int"), mask


def words(keys: DataFrame, level: int, size: int) -> DataFrame:
    """One row, one array of ``size`` 64-bit words: the filter of ``keys``. Masks are or-ed inside tasks before the one array is built."""
    word, mask = place(F.col("key"), level, size)
    set_ = keys.groupBy(word.cast("bigint").alias("word")).agg(F.bit_or(mask).alias("bits"))
    every = keys.sparkSession.range(size).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    full = every.unionByName(set_).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))


def judged(pages: DataFrame, listed: Callable[[DataFrame], DataFrame] | DataFrame, url="url", rules=RULES, limit: int = FILTER_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) added last.

    A rule decides; without one a page is blocked when its host or a parent of it is listed. ``listed``: a table of one
    column, or what makes one of the corpus's keys (column ``key``). The cascade is built over all hosts of ``pages``
    and their parents, so its answers for them are exact; only listed keys that occur there are encoded, repeated and NULL ones once
    or not at all. A NULL URL, one without ``://`` and one with an empty host have no key and are allowed. Repeated rows are judged
    alike, an empty table gives no rows. Pages are not shuffled, only distinct keys are. When the filters would pass ``limit``
    bytes (some 8 million listed keys that occur), or listed keys have more than DEPTHS different numbers of labels, the keys are
    joined instead, with the same answers. A clashing column of ``pages`` keeps its name.
    """
    h, p, r = free(pages, "_host"), free(pages, "_path"), free(pages, "_rule")
    host, path = host_path(col(url))
    parted = pages.withColumn(h, host).withColumn(p, path)
    rule, verdict = rule_of(F.col(h), F.col(p), rules)
    parted = parted.withColumn(r, F.struct(rule.alias("rule"), verdict.alias("verdict")))
    hosts = stage(parted.where(F.col(h) != "").select(F.col(h).alias("host")).distinct(), "hosts")
    universe = stage(hosts.select(F.explode(parents(F.col("host"))).alias("key")).distinct(), "keys")
    on_list = (listed(universe) if callable(listed) else listed).toDF("listed").distinct()
    marked = stage(universe.join(on_list, F.col("key") == F.col("listed"), "left"), "marked")
    keys, others = marked.where("listed IS NOT NULL").select("key"), marked.where("listed IS NULL").select("key")
    labels = keys.groupBy(F.size(F.split("key", r"\.")).alias("n")).count().limit(DEPTHS + 1)
    depths = sorted(d.n for d in labels.collect())
    cascade = Cascade(keys, others, limit) if len(depths) <= DEPTHS else None
    if cascade and cascade.fits:
        hit = F.lit(False)
        for n in depths:  # a host with fewer labels is asked itself
            hit = hit | cascade.holds(F.substring_index(F.col(h), ".", -n))
        hit = (F.col(h) != "") & hit
    else:
        bad = hosts.select("host", F.explode(parents(F.col("host"))).alias("key")).join(keys, "key").select(F.col("host").alias(free(parted, "_bad"))).distinct()
        parted = parted.join(bad, F.col(h) == F.col(bad.columns[0]), "left")
        hit = F.col(bad.columns[0]).isNotNull()
    final = F.coalesce(F.col(r)["verdict"], F.when(hit, "block").otherwise("allow"))
    return parted.select(*[col(c) for c in pages.columns], F.col(h).alias(free(pages, "host")), F.col(p).alias(free(pages, "path")),
                         F.col(r)["rule"].alias(free(pages, "rule")), final.alias(free(pages, "verdict")))


def with_bad_word(universe: DataFrame, bad=BAD_WORDS) -> DataFrame:
    """The keys whose first label has one of the words between hyphens."""
    first = F.split(F.substring_index("key", ".", 1), "-")
    return universe.where(F.arrays_overlap(first, F.array(*[F.lit(w) for w in bad]))).select("key")


def _sql() -> str:
    cases = "\n".join(f"  WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'"
                      for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    does = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in RULES)
    bad = ", ".join(f"'{w}'" for w in BAD_WORDS)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT page_id, host, path, CASE
{cases} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {does} END
  WHEN list_has_any(flatten(list_transform(string_split(host, '.'), lambda x: string_split(x, '-'))), [{bad}]) THEN 'block' ELSE 'allow' END AS verdict FROM j
"""


@query("op13_url_cascade", _sql())
def op13(spark, root):
    """The list: hosts of the corpus with a bad word in their name."""
    return judged(read(spark, root, "pages").select("page_id", "url"), with_bad_word).select("page_id", "host", "path", "rule", "verdict")
