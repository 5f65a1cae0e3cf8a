"""Divergence of sources by DuckDB shard aggregation: smoothed term shares of every source against the others of its language.

Tasks count the terms of the texts they read: one row per language, source and term they meet, with its
occurrences and the number of texts it is in. These rows are hashed into shards by language and term. In a
shard a DuckDB database of the task's own sums them with vectorised SQL and keeps the terms in enough
documents of the language; what is kept is staged. In a second pass each shard turns its terms into shares
and sums, for every pair of sources of a language, the absolute differences, and ranks its leading terms.
Spark adds the pair sums of the shards and ranks them, and merges the terms' rankings.

No task holds a language or source: a frequent term is one row a source and reading task, and shards are
even in terms. What grows with the square of the number of sources of a language is the result itself.

Cases: null text, language or source is ''. A document is a row: repeated rows count each. An empty table gives no
rows; a source alone in its language has no pairs. A language without kept terms has pairs of value 0 and no terms.
Terms are runs of ASCII letters and non-ASCII characters; only A-Z are lower-cased. Very long texts are counted in pieces."""

from __future__ import annotations

import contextlib
import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Shares are floor(SHARE * (count + SMOOTH) / (N + SMOOTH * V)) + 1.
SHARE, SMOOTH = 1_000_000_000, 5
#: Bytes of a text counted at a time, and distinct (group, term) held before they are handed on.
PIECE, HELD = 1 << 22, 400_000
#: Every byte that is in no term becomes a space; A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, by pieces that end between two terms."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        piece = text[at:end].translate(TERM_BYTES)
        if end < len(text):  # the piece ends after its last space; a term longer than a piece is taken whole
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):
                end = min(end + PIECE, len(text))
                piece = text[at:end].translate(TERM_BYTES)
                cut = piece.find(b" ")
            if end < len(text) or cut >= 0:
                piece = piece[: cut + 1]
        at += len(piece)
        yield piece.split()


_COUNTED = "lang string, source string, term string, occurrences long, texts long"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, occurrences, texts``, summed within tasks only."""

    def table(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, texts) in found.items():
            names = list(occurrences)
            n = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(occurrences.values(), pa.int64()), pa.array([texts[t] for t in names], pa.int64())],
                names=["lang", "source", "term", "occurrences", "texts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                group = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(group[0])
                seen: set[bytes] = set()
                for terms in terms_of(text):
                    group[0].update(terms)
                    seen.update(terms)
                group[1].update(seen)
                held += len(group[0]) - before
                if held > HELD:
                    yield from table(found)
                    found, held = {}, 0
        yield from table(found)

    text = common.text_bytes("text")
    return docs.select(_named("lang"), _named("source"), text.alias("text")).mapInArrow(run, _COUNTED)


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


@contextlib.contextmanager
def database(memory: str = "500MB"):
    """A DuckDB of one thread and bounded memory; what it spills goes with it."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="duck-") as spill, contextlib.closing(duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill})) as con:
        yield con


_KEPT = """
WITH sums AS (SELECT lang, source, term, sum(occurrences) AS occurrences, sum(texts) AS texts FROM counted GROUP BY ALL),
     kept AS (SELECT lang, term, sum(occurrences) AS occurrences FROM sums GROUP BY ALL HAVING sum(texts) >= {least})
SELECT lang, source, term, occurrences::BIGINT AS occurrences, false AS whole FROM sums SEMI JOIN kept USING (lang, term)
UNION ALL SELECT lang, '', term, occurrences::BIGINT, true FROM kept
"""


def kept_terms(counted: DataFrame, least: int, shards: int) -> DataFrame:
    """``lang, source, term, occurrences, whole`` of the terms in ``least`` documents of their language or more; rows that
    are ``whole`` are the language's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with database() as con:
            con.execute("CREATE TABLE counted (lang VARCHAR, source VARCHAR, term VARCHAR, occurrences BIGINT, texts BIGINT)")
            for batch in batches:
                if batch.num_rows:
                    con.register("batch", pa.Table.from_batches([batch]))
                    con.execute("INSERT INTO counted SELECT * FROM batch")
                    con.unregister("batch")
            yield from con.sql(_KEPT.format(least=int(least))).to_arrow_reader(65_536)

    return counted.repartition(shards, "lang", "term").mapInArrow(run, "lang string, source string, term string, occurrences long, whole boolean")


#: Shares of every source of a language for every term of the shard (also those it lacks), then sums by pair and leading terms.
_SHARES = """
CREATE TEMP TABLE shares AS
SELECT g.lang, g.source, t.term, coalesce(c.occurrences, 0) > 0 AS has,
       (1 + {share}::HUGEINT * (coalesce(c.occurrences, 0) + {smooth}) // (g.total + {smooth} * g.terms)::HUGEINT)::BIGINT AS p,
       (1 + {share}::HUGEINT * (t.occurrences + {smooth}) // (g.whole_total + {smooth} * g.terms)::HUGEINT)::BIGINT AS q
FROM groups g JOIN (SELECT * FROM kept WHERE whole) t USING (lang)
LEFT JOIN (SELECT * FROM kept WHERE NOT whole) c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
"""
_PAIRS = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
"""
_TERMS = """
SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE has AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}
"""
_PARTIAL = "lang string, source string, part string, item string, value long"


def shard_sums(kept: DataFrame, groups: DataFrame, shards: int, top: int) -> DataFrame:
    """Per shard: ``lang, source, part, item, value`` with partial sums of pairs (``source`` < ``item``) and leading terms."""

    def run(terms: pa.Table, known: pa.Table) -> pa.Table:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        if not terms.num_rows:
            return schema.empty_table()
        with database() as con:
            con.register("kept", terms)
            con.register("groups", known)
            con.execute(_SHARES.format(share=SHARE, smooth=SMOOTH))
            parts = [con.sql(sql).to_arrow_table().cast(schema) for sql in (_PAIRS, _TERMS.format(top=int(top)))]
        return pa.concat_tables(parts)

    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    spread = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return kept.withColumn("shard", shard).groupBy("shard").cogroup(spread.groupBy("shard")).applyInArrow(run, _PARTIAL)


def audit(docs: DataFrame, least: int = 30, top: int = 50, shard_terms: int = 20_000) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` compares a source with each other one of its language by the sum
    of absolute differences of shares over all kept terms, part ``term`` names its ``top`` terms above the language's share."""
    spark = docs.sparkSession
    kept = common.staged(kept_terms(term_counts(docs), least, common.partitions(spark)), "terms")
    sums = kept.groupBy("lang", "whole", F.when(~F.col("whole"), F.col("source")).alias("source")).agg(F.sum("occurrences").alias("total"), F.count(F.lit(1)).alias("terms"))
    by_source = sums.where("NOT whole").select("lang", "source", "total")
    by_lang = sums.where("whole").select("lang", F.col("total").alias("whole_total"), "terms")
    zero = {"total": 0, "whole_total": 0, "terms": 0}
    groups = common.staged(docs.select(_named("lang"), _named("source")).distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(zero), "groups")
    shards = max(1, -(-kept.where("whole").count() // shard_terms), min(common.partitions(spark), 64))
    parts = shard_sums(kept, groups, shards, top).where("value IS NOT NULL")
    parts = common.staged(parts, "sums")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")  # languages without kept terms: all pairs at 0
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source < item").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.unionByName(bare)
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p"), "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    found = both.unionByName(parts.where("part = 'term'"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return found.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))
