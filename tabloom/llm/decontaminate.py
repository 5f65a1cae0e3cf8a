"""Benchmark decontamination with spaced seeds (DataFrame operations only).

Fixed masks of equal weight select tokens of a window and ignore the others, so a hit survives
substitutions at the ignored positions. The masked hashes of all benchmark windows are joined with
those of all document windows; each hit names a document, an item and a diagonal. Around the hit the
tokens of both are compared along the diagonal: a document is contaminated by an item when some
stretch of ``stretch`` tokens (the whole item, if it is shorter) agrees in all but a fifth of them.

Up to ``block_rows`` hashes of the benchmark are broadcast, and documents are not shuffled to be searched; beyond that
both sides' hashes are merge-joined, so documents are read once whatever the benchmark's size. Only those with hits are verified.

Items shorter than a stretch are compared whole, so each gets masks of its own length (``short_masks``): its
positions are cut into parts, and the masks leave out every choice of as many parts as tokens may differ. Whatever
tokens differ, one mask leaves all of them out, so none of these items is missed. Documents are hashed
with the masks of the lengths that the benchmark has.

Tokens are lower-case runs of letters and digits. Defined cases: null and empty texts have no tokens;
an item without tokens is in no document; a null id is an id like any other; repeated rows count once, and of
several texts with one id the closest overlap is told; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: 1 keeps a token, 0 ignores it. Each has six kept positions.
MASKS = ("1111011", "110101011", "10110010011")
#: At most so many benchmark hashes (24 bytes each) are broadcast at a time.
BLOCK_ROWS = 1_000_000


def tokens(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def short_masks(length: int, agree: float = 0.8) -> list[str]:
    """Masks of an item of ``length`` tokens of which a share ``agree`` must be equal."""
    wrong = length - math.ceil(length * agree)
    parts = min(length, wrong + 2)
    part_of = [i * parts // length for i in range(length)]
    return ["".join("0" if p in left_out else "1" for p in part_of) for left_out in combinations(range(parts), wrong)]


def _seed_hashes(hashes: Column, mask: str) -> Column:
    """Masked hashes of all windows, by window start."""
    kept = [i for i, bit in enumerate(mask) if bit == "1"]
    starts = F.when(F.size(hashes) >= len(mask), F.sequence(F.lit(0), F.size(hashes) - len(mask))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(mask), *[F.get(hashes, i + k) for k in kept]))


def _windows(rows: DataFrame, keys: list[str], masks: list[str]) -> DataFrame:
    """``keys``, window start ``at`` and ``seed`` of every masked window; rows have ``toks``."""
    hashed = rows.select(*keys, F.transform("toks", lambda w: F.xxhash64(w)).alias("hs"))
    seeds = hashed.select(*keys, F.size("hs").alias("n"), F.concat(*[_seed_hashes(F.col("hs"), m) for m in masks]).alias("seeds"))
    # the outer form: for the inner one the optimizer would filter on the array's size and compute all of it twice
    each = seeds.select(*keys, "n", F.posexplode_outer("seeds").alias("at", "seed")).where("seed IS NOT NULL")
    at, before = F.col("at"), F.lit(0)
    start = at
    for mask in masks[:-1]:  # the masks' hashes stand one after the other
        before = before + F.greatest(F.col("n") - len(mask) + 1, F.lit(0))
        start = F.when(at >= before, at - before).otherwise(start)
    return each.select(*keys, start.cast("int").alias("at"), "seed")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    masks: tuple[str, ...] = MASKS, stretch: int = 13, agree: float = 0.8, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per contaminated (document, item): ``__id``, ``__th`` (the text's hash), ``__item``, the tokens that
    agree in the best stretch, its length, where it starts in the document, and the item's tokens that agree on that diagonal."""
    items = benchmark.select(F.col(item_col).alias("__item"), tokens(item_text).alias("toks")).distinct().withColumn("__item_hash", F.xxhash64("toks"))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__th"), F.col(text_col).alias("__text"))
    sizes = F.least(F.size("toks"), F.lit(stretch)).alias("n")
    lengths = sorted(r["n"] for r in items.select(sizes).distinct().collect())  # at most ``stretch`` numbers
    keys, found, used = ["__item", "__item_hash", "n"], [], []
    for length in (n for n in lengths if n > 0):
        own = list(masks) if length == stretch else short_masks(length, agree)
        found.append(_windows(items.select("__item", "__item_hash", F.size("toks").alias("n"), "toks").where(sizes == length), keys[:2], own).join(items.select("__item_hash", F.size("toks").alias("n")).distinct(), "__item_hash"))
        used += [m for m in own if m not in used]
    if not found:
        found, used = [items.where("false").select("__item", "__item_hash", F.lit(0).alias("at"), F.lit(0).cast("long").alias("seed"), F.size("toks").alias("n"))], ["1"]
    probes = common.staged(reduce(DataFrame.unionByName, found), "probes")
    few = probes.count() <= block_rows
    windows = _windows(rows.select("__id", "__th", tokens("__text").alias("toks")), ["__id", "__th"], used)
    part = probes.withColumnRenamed("at", "item_at")
    met = windows.join(F.broadcast(part) if few else part.hint("shuffle_merge"), "seed")  # one pass over the documents, whatever the benchmark's size
    hits = met.select("__id", "__th", *keys, (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = common.staged(hits.groupBy("__id", "__th").agg(F.collect_set(F.struct(*keys, "shift")).alias("hits")), "hits")
    same_row = rows["__id"].eqNullSafe(hits["__id"]) & (rows["__th"] == hits["__th"])
    held = rows.join(hits, same_row).select(rows["__id"], rows["__th"], "__text", "hits").dropDuplicates(["__id", "__th"])
    # a hit takes along only the document's tokens on its diagonal
    beside = lambda h: F.slice("toks", F.greatest(h["shift"], F.lit(0)) + 1, F.greatest(h["n"] + F.least(h["shift"], F.lit(0)), F.lit(0)))
    cut = F.transform("hits", lambda h: F.struct(h["__item"].alias("__item"), h["__item_hash"].alias("__item_hash"), h["shift"].alias("shift"), beside(h).alias("part")))
    each = held.select("__id", "__th", "hits", tokens("__text").alias("toks")).select("__id", "__th", F.explode(cut).alias("hit")).select("__id", "__th", "hit.*")
    same_item = each["__item"].eqNullSafe(items["__item"]) & (each["__item_hash"] == items["__item_hash"])
    pairs = each.join(items, same_item).select("__id", "__th", each["__item"], "shift", "part", "toks")
    place = lambda k: k + F.least(F.col("shift"), F.lit(0))
    agreeing = F.transform(F.col("toks"), lambda t, k: F.coalesce(F.when(place(k) >= 0, F.get("part", place(k))) == t, F.lit(False)).cast("int"))
    compared = pairs.select("__id", "__th", "__item", "shift", agreeing.alias("same"), F.least(F.size("toks"), F.lit(stretch)).alias("need"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("need")),
        lambda s: F.struct(F.aggregate(F.slice("same", s + 1, F.col("need")), F.lit(0), lambda a, x: a + x).alias("agreed"), (-s).alias("from")),
    )
    best = compared.withColumn("best", F.array_max(sums)).withColumn("total", F.aggregate("same", F.lit(0), lambda a, x: a + x))
    passed = best.where(F.col("best.agreed") >= F.ceil(F.col("need") * F.lit(agree)))
    top = passed.groupBy("__id", "__th", "__item").agg(F.max(F.struct("best.agreed", "total", (-(F.col("shift") - F.col("best.from"))).alias("at"), "need", F.size("same").alias("n"))).alias("m"))
    return top.select(
        "__id", "__th", "__item", F.col("m.agreed").cast("long").alias("agreed"), F.col("m.need").cast("long").alias("stretch"),
        (-F.col("m.at")).cast("long").alias("doc_token"), F.col("m.total").cast("long").alias("item_agreed"), F.col("m.n").cast("long").alias("item_tokens"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """Contaminated documents by item: id, item id, and the overlap's figures."""
    found = overlaps(docs, benchmark, id_col=id_col, item_col=item_col, **options)
    figures = ["agreed", "item_agreed", "stretch", "item_tokens", "doc_token"]
    best = found.groupBy("__id", "__item").agg(F.max(F.struct(*figures)).alias("m"))
    return best.select(F.col("__id").alias(id_col), F.col("__item").alias(item_col), *[f"m.{c}" for c in ("agreed", "stretch", "doc_token", "item_agreed", "item_tokens")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    bad = common.staged(overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("__id", "__th").distinct(), "contaminated")
    marked = docs.withColumn("__own", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    return marked.join(bad, marked[id_col].eqNullSafe(bad["__id"]) & (marked["__own"] == bad["__th"]), "left_anti").drop("__own")
