"""SimHash near-duplicates with pigeonhole blocks.

A text's 64-bit fingerprint sums the bits of the hashes of its word shingles. Two fingerprints that
differ in at most ``max_bits`` bits agree on at least ``blocks - max_bits`` of ``blocks`` equal
blocks, so every close pair shares one of the C(blocks, max_bits) combinations of blocks. Distinct
fingerprints are joined on those combinations and verified by Hamming distance.

Combinations shared by more than ``crowd`` fingerprints are not expanded into pairs. For distances up
to two their members go through one-bit centres instead: two fingerprints differ in at most two bits
exactly when some value lies within one bit of both, and at most 65 fingerprints surround a value, so
a crowd costs 65 rows a member, loses no link and never grows with the square of its size.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; texts
shorter than a shingle hash their whole word sequence; repeated rows give repeated result rows; a null
id keeps its fingerprint, and its component is the smallest id that is not null (null if there is
none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

BITS = 64
SEED = 42
#: Shingles whose bits are unpacked at a time: bounds a task's memory for very long texts.
CHUNK = 100_000


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint of lower-cased (A-Z) words."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, CHUNK):
        part = w[start : start + CHUNK + words - 1]
        rows = zip(*(part[i:] for i in range(words)), strict=False) if len(w) >= words else [part]
        digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, rows), repeat(SEED)))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def majority(hashes: np.ndarray) -> int:
    """Signed fingerprint of a set of 64-bit hashes; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK].astype(">i8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``__id`` and ``fp`` of every row."""

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), words) for t in batch.column(1)], pa.int64())], ["__id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("__id"), common.text_bytes(text_col).alias("__text"))
    return common.arrow_map(slim, run, "__id long, fp long")


def block_combinations(max_bits: int, blocks: int) -> list[int]:
    """Masks of the block combinations of which every close pair shares one."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [signed(sum(c)) for c in combinations(masks, blocks - max_bits)]


def close_pairs(nodes: DataFrame, max_bits: int = 2, blocks: int = 6, crowd: int = 64) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints of ``nodes.fp`` (distinct) within ``max_bits``.

    Outside crowds these are all close pairs; inside, each centre's members are linked to its least."""
    if max_bits > 2:
        raise ValueError("crowded blocks have an exact way for distances up to two bits only")
    masks = block_combinations(max_bits, blocks)
    keyed = nodes.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)])).alias("k")
    ).select("fp", "k.combo", "k.block")
    shared = keyed.groupBy("combo", "block").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    keyed = common.staged(keyed.join(shared, ["combo", "block"]), "blocks")
    few = keyed.where(F.col("members") <= crowd).select("combo", "block", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["combo", "block"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )
    flips = [0] if max_bits < 2 else [0, *(1 << i if i < BITS - 1 else -(1 << i) for i in range(BITS))]
    crowded = keyed.where(F.col("members") > crowd).select("fp").distinct()
    if max_bits == 1:  # one bit apart: the members of a centre are the value itself and its neighbours
        flips = [0, *(1 << i if i < BITS - 1 else -(1 << i) for i in range(BITS))]
    centres = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("centre"))
    around = centres.groupBy("centre").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)  # 65 at most
    if max_bits == 1:
        linked = around.where(F.array_contains("near", F.col("centre"))).select(F.col("centre").alias("a"), F.explode("near").alias("b")).where("a <> b")
    else:
        linked = around.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return pairs.union(linked)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, blocks: int = 6, crowd: int = 64) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable)."""
    fps = common.staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = common.staged(fps.groupBy("fp").agg(F.min("__id").alias("least_id")), "nodes")
    roots = common.staged(connected_components(close_pairs(nodes.select("fp"), max_bits, blocks, crowd)), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; repeated rows of that id are kept once
    (the first by hash), rows without an id are all kept."""
    return representatives(docs, near_duplicates(docs, id_col, text_col, **options), id_col)


def representatives(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``keep_representatives`` for groups given as ``marked`` (id, ``component_id``)."""
    kept = marked.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept")).distinct()
    chosen = docs.join(kept, docs[id_col] == kept["__kept"], "left_semi")
    rest = [c for c in docs.columns if c != id_col]
    ordered = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = chosen.groupBy(id_col).agg(F.min_by(F.struct(*rest), F.xxhash64(*ordered)).alias("__row")) if rest else chosen.distinct()
    once = one.select(*[F.col(id_col) if c == id_col else F.col("__row")[c].alias(c) for c in docs.columns])
    return once.unionByName(docs.where(F.col(id_col).isNull()))
