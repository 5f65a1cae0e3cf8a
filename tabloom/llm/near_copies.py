"""Near copies by the true Jaccard similarity of word shingles, without loss.

Texts are sets of hashed word shingles. Shingles have one order for all texts: those found often in a
sample last, the others by hash. Two sets of similarity ``least`` or more share a shingle among
the first ``n - ceil(least * n) + 1`` of each, so every such pair meets at a shingle of these prefixes;
candidates are verified on the whole sets. Which shingles the sample finds changes the work, not the result.
The sample grows with the texts, so that a shingle's postings, and with them the candidates of a text, do not.

A candidate's texts move only if its prefixes share enough. Of what two sets have in common, all up to the earlier
end of the two prefixes is in both of them, so it is at most what the prefixes share and the larger rest (``_enough_shared``).

Groups are connected components, so a pair that is connected already needs no comparison: first texts with
close SimHash fingerprints are compared (``simhash.close_pairs``), then every shingle's members with one pivot
(the member whose prefix is shared most), then those of other components with a second one, and only pairs
still in different components are listed, by components of like size at a shingle, and at those shingles that can be the first they
share: with too little of either set behind it for the similarity, a shingle is not the first. What is staged grows with the shared part of the prefixes;
whole texts move once, compressed, and only those that share something.

Defined cases: words are lower-cased (A-Z); a text shorter than a shingle is its whole word sequence;
null and wordless texts are copies of each other; a null id takes part, and its component is the smallest
id that is not null (null if there is none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import close_pairs, majority

SEED = 42
#: The sample that finds frequent shingles: one text in so many, texts at least, texts of it that make a shingle frequent, and shingles put
#: last at most. They change the order in which shingles are looked at, so the work, not the result.
ONE_IN = 10
SAMPLE = 20_000
FREQUENT = 4
LAST = 4_000_000
#: Shingles of sets just computed that verification keeps at hand: bounds a task's memory.
KNOWN = 2_000_000


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of the word shingles."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.int64)
    rows = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, map(b" ".join, rows), repeat(SEED))), np.int64))


def prefix_size(n: int, least: float) -> int:
    """Shingles of which a set of ``n`` shares one with every set of similarity ``least`` or more."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def _node(have: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(have.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = common.text_bytes(text_col)
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("th"), text.alias("text"))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``__id``, ``th`` (hash of the text), ``node`` (hash of the set), ``fp`` (SimHash fingerprint of the set) of every row."""

    def run(batch: pa.RecordBatch):
        sets = [shingles(t.as_py(), words) for t in batch.column(2)]
        nodes, prints = [_node(s) for s in sets], [majority(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64())], ["__id", "th", "node", "fp"])

    return common.arrow_map(texts, run, "__id long, th long, node long, fp long")


def frequent_shingles(texts: DataFrame, rows: int, words: int, sample: int = SAMPLE) -> np.ndarray:
    """Sorted shingles of ``FREQUENT`` texts or more of a sample: one text in ``ONE_IN``, or ``sample`` texts where that is more."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), words))], ["key"])

    kept = texts.where(F.pmod("th", F.lit(max(1, min(ONE_IN, rows // sample)))) == 0).select("text")
    found = common.arrow_map(kept, run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT)
    found, path = common.staged_at(found, "frequent")
    keys = np.sort((_most_frequent(found) if found.count() > LAST else found).select("key").toArrow().column(0).to_numpy())
    common.remove(texts.sparkSession, path)
    return keys


def _most_frequent(found: DataFrame) -> DataFrame:
    """About ``LAST`` rows of ``key`` and ``c`` (distinct hashes and how often each was found) with the highest counts; of the last count
    that fits in part, the lowest keys. A sorted limit would set memory for ``2 * LAST`` rows aside in every task, however few it has."""
    held = 0
    for c, keys in sorted(map(tuple, found.groupBy("c").count().collect()), reverse=True):
        if held + keys > LAST:
            below = -(1 << 63) + (LAST - held) * (1 << 64) // keys
            return found.where((F.col("c") > c) | (F.col("c") == c) & (F.col("key") < below))
        held += keys
    return found


def postings(texts: DataFrame, frequent: np.ndarray, words: int, least: float) -> DataFrame:
    """``key``, ``node``, ``n``, ``place`` (in the set's order, from 0): one row for each shingle of a set's prefix."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, nodes, counts = [], [], []
        for text in batch.column(0):
            have = shingles(text.as_py(), words)
            nodes.append(_node(have))
            counts.append(len(have))
            if len(frequent) and len(have):
                often = frequent[np.minimum(np.searchsorted(frequent, have), len(frequent) - 1)] == have
                have = np.concatenate([have[~often], have[often]])
            keys.append(have[: prefix_size(len(have), least)])
        sizes = [len(k) for k in keys]
        repeated = [np.repeat(np.array(v, t), sizes) for v, t in ((nodes, np.int64), (counts, np.int32))]
        places = np.concatenate([np.empty(0, np.int32), *(np.arange(size, dtype=np.int32) for size in sizes)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate([np.empty(0, np.int64), *keys]), *repeated, places)], ["key", "node", "n", "place"])

    return common.arrow_map(texts.select("text"), run, "key long, node long, n int, place int")


def shared_postings(posted: DataFrame) -> tuple[DataFrame, str]:
    """The postings, each once, of shingles that two sets or more have in their prefixes; staged, with their path. Shingles with over a
    thousandth of what is shared (a thousand at most) are broadcast, so their postings are not gathered."""
    spark = posted.sparkSession
    shared, shared_path = common.staged_at(posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    step = max(64, (shared.agg(F.sum("c")).first()[0] or 0) // 1000)
    hot = F.broadcast(shared.where(F.col("c") > step).select("key"))
    rest = posted.join(hot, "key", "left_anti").join(shared.where(F.col("c") <= step).select("key"), "key", "left_semi")
    several, several_path = common.staged_at(rest.union(posted.join(hot, "key", "left_semi")).distinct(), "several")
    common.remove(spark, shared_path)
    common.release(spark)
    alone = several.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo = hi").select("key")  # copies of one set
    alone, alone_path = common.staged_at(alone, "alone")
    members = common.staged_at(several.join(alone, "key", "left_anti"), "members")
    for path in (several_path, alone_path):
        common.remove(spark, path)
    return members


def packed_sets(texts: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``z``: one text of every set of ``nodes``, compressed."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(t.as_py()) for t in batch.column(1)], pa.binary())], ["node", "z"])

    wanted = common.staged(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")), "wanted")
    return common.arrow_map(texts.select("th", "text").join(wanted, "th").dropDuplicates(["th"]).select("node", "text"), run, "node long, z binary")


def shared_prefixes(members: DataFrame) -> DataFrame:
    """``node``, ``n`` and ``shared``: the shingles of a set's prefix that other prefixes have."""
    return members.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("key").alias("shared"))


def _enough_shared(pairs: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """The pairs whose prefixes share so much that the sets can have similarity ``least``; loses none that have it."""
    left = prefixes.select(F.col("node").alias("a"), "n", F.col("shared").alias("x"))
    right = prefixes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("shared").alias("y"))
    rest = F.ceil(least * F.greatest("n", "m") - 1e-9) - 1  # what follows the larger set's prefix
    enough = F.size(F.array_intersect("x", "y")) + rest >= least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def verified(pairs: DataFrame, packed: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets have Jaccard similarity ``least`` or more."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z, keep, known, held = zstandard.ZstdDecompressor(), [], {}, 0

        def of(node: int, packed_text: pa.Scalar) -> np.ndarray:
            nonlocal held
            have = known.get(node)
            if have is None:
                have = shingles(z.decompress(packed_text.as_py()), words)
                if held + len(have) > KNOWN:
                    known.clear()
                    held = 0
                known[node] = have
                held += len(have)
            return have

        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            x, y = of(a, x), of(b, y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = packed.select(F.col("node").alias("a"), F.col("z").alias("x"))
    right = packed.select(F.col("node").alias("b"), F.col("z").alias("y"))
    return common.arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _pairs(joined: DataFrame, least: float) -> DataFrame:
    """Distinct pairs of ``node`` and ``other`` whose sizes allow the similarity."""
    near = (F.col("node") != F.col("other")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)
    return joined.where(near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _across(open_: DataFrame, least: float) -> DataFrame:
    """Pairs of different components that can have their first shared shingle at a key: never two of one component, however large it
    is there, and only of sizes that allow the similarity.

    Components meet at a key by bands of size (a similar set is in the same band or the next), then their members do."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / least) + 1e-9).cast("int")
    rows = common.staged(open_.where("n > 0").select("key", "node", "n", "place", "root", band.alias("band")), "bands")
    # at the first shingle that two similar sets share, enough of each is left to reach the similarity
    blocks = rows.groupBy("key", "root", "band").agg(F.max(F.col("n") - F.col("place")).alias("most"), F.min("n").alias("fewest"))
    upper = blocks.select("key", F.col("root").alias("other_root"), F.col("band").alias("other_band"), F.col("most").alias("other_most"), F.col("fewest").alias("other_fewest"))
    reach = blocks.withColumn("other_band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    enough = F.least("most", "other_most") >= least / (1 + least) * (F.col("fewest") + F.col("other_fewest")) - 1e-9
    met = reach.join(upper, ["key", "other_band"]).where("root <> other_root").where((F.col("band") < F.col("other_band")) | (F.col("root") < F.col("other_root"))).where(enough)
    met = met.select("key", "root", "band", "other_root", "other_band")
    other = rows.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("place").alias("other_place"), F.col("root").alias("other_root"), F.col("band").alias("other_band"))
    needed = least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("other_place"))
    return _pairs(met.join(rows, ["key", "root", "band"]).join(other, ["key", "other_root", "other_band"]).where(left >= needed), least)


def _close_prints(sets: DataFrame) -> DataFrame:
    """Pairs of sets with equal fingerprints (each with the least) or fingerprints at two or fewer differing bits (their least)."""
    first = common.staged(sets.groupBy("fp").agg(F.min("node").alias("a")), "prints")
    equal = sets.join(first, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    near = close_pairs(first.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(first.select(F.col("fp").alias("x"), "a"), "x").join(first.select(F.col("fp").alias("y"), F.col("a").alias("b")), "y")
    return equal.union(near.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def similar_roots(texts: DataFrame, sets: DataFrame, words: int, least: float) -> DataFrame:
    """``node`` and ``root`` of the components that similar pairs of sets form; sets without a similar one are absent."""
    spark = texts.sparkSession
    frequent = frequent_shingles(texts, sets.count(), words)
    posted, path = common.staged_at(postings(texts, frequent, words, least), "postings")
    members, members_path = shared_postings(posted)
    common.remove(spark, path)
    common.release(spark)
    prints = common.staged(_close_prints(sets.where("fp <> 0").select("node", "fp").distinct()), "close")
    taking_part = members.select("node").union(prints.select("a")).union(prints.select("b")).distinct()
    packed, packed_path = common.staged_at(packed_sets(texts, sets, taking_part), "packed")
    common.release(spark)
    held = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    prefix = F.first("n") - F.ceil(least * F.first("n") - 1e-9) + 1
    central = members.join(held, "key").groupBy("node").agg((F.sum(F.log("members")) / prefix).alias("rank"))
    central = central.select("node", F.round("rank", 6).alias("rank"))
    placed, placed_path = common.staged_at(members.join(central, "node").select("key", "node", "n", "place", F.struct("rank", "node", "n").alias("lead")), "placed")
    common.remove(spark, members_path)
    common.release(spark)
    prefixes, prefixes_path = common.staged_at(shared_prefixes(placed), "prefixes")

    def with_pivot(rows: DataFrame, pivots: DataFrame) -> DataFrame:
        leading = pivots.groupBy("key").agg(F.max("lead").alias("p"))
        return _pairs(rows.join(leading.select("key", F.col("p.node").alias("other"), F.col("p.n").alias("m")), "key"), least)

    first = with_pivot(placed, placed).union(prints).distinct()
    first, first_path = common.staged_at(_enough_shared(first, prefixes, least), "pairs")
    common.release(spark)  # what made the pairs is not needed while the texts move
    links = common.staged(verified(first, packed, words, least), "links")
    common.remove(spark, first_path)
    common.release(spark)
    roots = connected_components(links)
    for all_pairs in (False, True):
        rooted = placed.join(roots.select(F.col("node").alias("__node"), F.col("root").alias("__root")), F.col("node") == F.col("__node"), "left")
        rooted, rooted_path = common.staged_at(rooted.select("key", "node", "n", "place", "lead", F.coalesce("__root", "node").alias("root")), "rooted")
        of_key = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("root", "lead").alias("first")).where("lo <> hi")
        open_, open_path = common.staged_at(rooted.join(of_key.select("key", "first"), "key"), "open")
        common.remove(spark, rooted_path)
        common.release(spark)
        if all_pairs:
            pairs = _across(open_, least)
        else:
            pairs = with_pivot(open_.where("root = first"), open_.where("root <> first"))
            pairs = pairs.union(with_pivot(open_.where("root <> first"), open_.where("root = first"))).distinct()
        pairs, pairs_path = common.staged_at(_enough_shared(pairs, prefixes, least), "pairs")
        common.remove(spark, open_path)
        common.release(spark)
        fresh = common.staged(verified(pairs, packed, words, least), "links")
        common.remove(spark, pairs_path)
        common.release(spark)
        if not fresh.isEmpty():
            roots = connected_components(roots.select("node", "root").union(fresh))
    for path in (packed_path, placed_path, prefixes_path):
        common.remove(spark, path)
    return roots


def marked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """Per row: ``__id``, ``th`` and ``component_id``."""
    texts = _texts(docs, id_col, text_col)
    sets = common.staged(shingle_sets(texts, words), "sets")
    nodes = common.staged(sets.groupBy("node").agg(F.min("__id").alias("least_id")), "nodes")
    roots = similar_roots(texts, sets, words, least)
    rooted = nodes.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = rooted.select("node", "root").join(smallest, "root").select("node", "component_id")
    return sets.select("__id", "th", "node").join(of_node, "node").select("__id", "th", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: id and ``component_id`` (smallest id reachable over pairs of similarity ``least`` or more)."""
    return marked_rows(docs, id_col, text_col, words, least).select(F.col("__id").alias(id_col), "component_id")
