"""How far the sources of a language are apart in their terms: an inverted index of corrections to a common baseline.

Each pair of sources (a, b) starts at what it would have if no kept term occurred in either, V times
f of the two zero-count shares. Terms then correct it. What a term of a adds against a source
without it depends on its count alone, so those corrections come from the histogram of counts of a;
what two sources that share a term add beyond both comes from the postings of that term. Corrections
that are zero aren't emitted. All of it is whole numbers: shares in parts of 10**9, f = (p - q)**2 div q.

Terms are runs of letters (A-Z lower-cased; everything beyond ASCII is a letter); a language keeps
those in at least MIN_DOCS of its rows. A list of postings above TILE sources is dealt to tiles.

Defined cases: a null text, lang or source is empty; a row without terms still makes its group
occur; rows that repeat an id are rows of their own (the id isn't looked at, nor are columns beside
text, lang and source); a language without kept terms has pairs of value 0 and no terms; a
language with one source has no pairs; a very long text is split in pieces between words; an empty table gives no
rows. Sums stay in a long as shares add up to 10**9 and one for each term: below 4e18 for 10**9 terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import given_back, table, written

MIN_DOCS, TOP, TILE = 3, 200, 1024
#: Entries that a task counts in memory before it hands them on, and bytes of a text that are split at once.
HELD, PIECE = 1 << 20, 1 << 22
#: Bytes as they count: letters A-Z lower-cased, those beyond ASCII as they are, all others blank.
LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256)).lower()
WHOLE = 1_000_000_000


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), exact for counts of any size."""
    return F.expr(f"1 + cast({WHOLE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0)) div cast({total} + {terms} as decimal(20,0))")


def f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def grouped(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: what HELD terms of the rows so far occur how often, and in how many rows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in pieces(text.translate(LETTERS)):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from emitted(held)
                held, size = {}, 0
    yield from emitted(held)


def pieces(letters: bytes) -> Iterator[list[bytes]]:
    """The words of a text, PIECE bytes or a little more at a time."""
    at = 0
    while at < len(letters):
        to = letters.find(b" ", at + PIECE)
        to = len(letters) if to < 0 else to
        yield letters[at:to].split()
        at = to


def emitted(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        if n:
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n (occurrences), lang_n (those of the language), head (one row of each term of a language)."""
    words = rows.select("lang", "source", F.col("text").cast("binary").alias("text"))
    words = words.mapInArrow(given_back(counted), "lang string, source string, term string, n bigint, docs bigint")
    counts = words.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    all_of = counts.select(
        "*",
        F.sum("docs").over(of_term).alias("lang_docs"),
        F.sum("n").over(of_term).alias("lang_n"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("head"),
        F.count(F.lit(1)).over(of_term).alias("sources"),
    )
    return all_of.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "head", "sources")


class Index:
    """Written tables of one corpus: postings (lang, source, term, n, p, p0, lang_n, sources) and groups (lang, source, total, terms, p0)."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        rows = grouped(docs)
        kept = written(kept_terms(rows, min_docs), "kept-terms")
        langs = kept.groupBy("lang").agg(F.count_if("head").alias("terms"), F.sum("n").alias("lang_total"))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
        self.groups = written(groups.withColumn("p0", F.when(F.col("terms") > 0, share("0", "total", "terms"))), "term-groups")
        self.postings = kept.join(self.groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))

    def top_terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value, rank: terms that a source has more often than its language, furthest first."""
        rows = self.postings.withColumn("q", share("lang_n", "lang_total", "terms")).where("p > q")
        rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))
        return ranked(rows).where(F.col("rank") <= top)

    def pairs(self) -> DataFrame:
        """lang, source, item (each other source), value, rank: how far the source is from the others."""
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
        base = self.groups.join(other, "lang").where("source <> item")
        base = base.select("lang", "source", "item", F.expr(f"coalesce(terms * {f('p0', 'q0')}, 0)").alias("value"))
        counts = self.postings.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
        against = written(counts, "histograms").join(other, "lang").where("source <> item")
        own = against.select("lang", "source", "item", F.expr(f"k * ({f('p', 'q0')} - {f('p0', 'q0')})").alias("value"))
        theirs = against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"k * ({f('q0', 'p')} - {f('q0', 'p0')})").alias("value"))
        tiles = F.ceil(F.col("sources") / TILE).cast("int")
        left = self.postings.select("lang", "term", "source", "p", "p0", F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"))
        right = self.postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"))
        both = left.join(right, ["lang", "term", "tile"]).where("source <> item")
        both = both.select("lang", "source", "item", F.expr(f"{f('p', 'q')} - {f('p', 'q0')} - {f('p0', 'q')} + {f('p0', 'q0')}").alias("value"))
        parts = base.unionByName(own.where("value <> 0")).unionByName(theirs.where("value <> 0")).unionByName(both.where("value <> 0"))
        return ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    index = Index(docs, min_docs)
    parts = [index.pairs().withColumn("part", F.lit("pair")), index.top_terms(top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
