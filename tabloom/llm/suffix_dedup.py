"""Exact substring deduplication with suffix arrays built by induced sorting.

Every byte covered by a ``span``-byte string that also starts elsewhere in the corpus is removed.

1. One pass cuts every text into blocks of up to ``WIDTHS[0]`` windows, aligned to content-defined anchors,
   so equal windows are cut alike. All windows of a block contain its core, the bytes common to every
   window at its place; only the core's hash and the block's place are kept. Windows whose core occurs
   once cannot repeat; most of the corpus ends here.
2. The blocks that are left get their bytes: the core's 128-bit hash and the few bytes before and after
   it. Equal blocks are pre-aggregated to one block and its number.
3. Shards are the blocks of whole cores. A shard's text is its blocks, separated, each core one symbol,
   and a block that occurs more than once stands in it twice. Its suffix array is built by induced sorting, and the
   permuted common prefixes decide: a window repeats exactly when the suffix at its start shares a
   window's length with a neighbour. Small cores are sorted in step (``suffix_array.induced_rows``).
4. A core with more than ``crowd`` different blocks is not put into one shard: its blocks are cut into
   narrower ones, whose cores hold more context and are dealt out anew, and the same suffix arrays
   decide on them. The last width is single windows, of which a core has one block at most.

Texts without a repeated core are finished when they are first joined; the others are staged and read
again to be cut and to lose their bytes. Keys with over a thousandth of all blocks (a thousand at most)
are broadcast instead of joined, so no key's rows meet in one task.

Defined cases: a null text is empty; texts below ``span`` bytes lose nothing; repeated rows count as
further occurrences, so both lose their windows; a null id is an id like any other; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .anchors import ROLL, least_runs, rolling_hashes
from .suffix_array import repeated_starts, repeated_starts_rows

SPAN = 400
GRAM = 64
#: Windows per block, from wide to single.
WIDTHS = (128, 16, 1)
#: Different blocks of one core that may go to one suffix array.
CROWD = 256
#: Symbols of a core up to which it is sorted in step with others, symbols that wait for that, and symbols sorted at a time.
ROW_SYMBOLS = 4_096
BATCH_SYMBOLS = 8_000_000
STEP_SYMBOLS = 600_000
#: Texts of much the same length below which sorting in step does not pay.
FEW_ROWS = 32
_CODES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_CUT = "core long, id long, th long, first int, off int, n int"
_TEXT = "id long, th long, n_bytes long, sha string, z binary, cuts array<struct<first:int,off:int,n:int>>"
_BLOCK = "g1 long, g2 long, head binary, tail binary, n int"
_FOUND = "g1 long, g2 long, b long, lo int, hi int"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hash128(*parts: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128()
    for p in parts:
        h.update(p)
    v = h.intdigest()
    return _signed(v >> 64), _signed(v & ((1 << 64) - 1))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = common.text_bytes(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def cuts(rows: DataFrame, span: int, gram: int, width: int) -> DataFrame:
    """Blocks of all windows: hash of the core, text, first window, its distance from the aligned place, windows."""

    def of_text(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        raw = np.frombuffer(text, np.uint8)
        step = ROLL - span + 1
        for start in range(0, max(0, len(raw) - span + 1), step):
            grams, cores = rolling_hashes(_CODES[raw[start : start + ROLL]], gram, span - width + 1)
            begin, end, at = least_runs(grams, span - gram + 1)
            aligned = at + (begin - at) // width * width
            count = (end - aligned + width - 1) // width
            run = np.repeat(np.arange(len(begin)), count)
            place = aligned[run] + width * (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
            first = np.maximum(place, begin[run])
            yield cores[place + width - 1].view(np.int64), first + start, first - place, np.minimum(place + width, end[run]) - first

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(4)]
        owners, sizes = [], []
        for number, text in enumerate(batch.column(2)):
            for found in of_text(text.as_py()):
                owners.append(number)
                sizes.append(len(found[0]))
                for part, values in zip(parts, found, strict=True):
                    part.append(values)
        if owners:
            owner = pa.array(np.repeat(owners, sizes))
            core, first, off, n = (np.concatenate(p) for p in parts)
            small = [pa.array(v, pa.int32()) for v in (first, off, n)]
            yield pa.RecordBatch.from_arrays([pa.array(core), batch.column(0).take(owner), batch.column(1).take(owner), *small], ["core", "id", "th", "first", "off", "n"])

    return common.arrow_map(rows, run, _CUT)


def _repeated_cores(cut: DataFrame) -> DataFrame:
    """The rows of ``cut`` whose core occurs twice or more."""
    shared = common.staged(cut.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "cores")
    step = max(64, (shared.agg(F.sum("c")).first()[0] or 0) // 1000)
    hot = F.broadcast(shared.where(F.col("c") > step).select("core"))  # under 1000 rows
    rest = cut.join(hot, "core", "left_anti").join(shared.where(F.col("c") <= step).select("core"), "core", "left_semi")
    return cut.join(hot, "core", "left_semi").union(rest)


def texts_with_cuts(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Every text with its blocks of repeated cores; texts without such blocks have their checksum instead of their bytes."""
    lists = _repeated_cores(cut).groupBy("id", "th").agg(F.collect_set(F.struct("first", "off", "n")).alias("cuts"))
    packed = _packed(rows)
    joined = packed.join(lists, packed["id"].eqNullSafe(lists["id"]) & (packed["th"] == lists["th"]), "left").select(packed["id"], packed["th"], "n_bytes", "sha", "z", "cuts")
    done = F.col("cuts").isNull()
    return common.staged(joined.select("id", "th", "n_bytes", F.when(done, F.col("sha")).alias("sha"), F.when(~done, F.col("z")).alias("z"), "cuts"), "texts")


def _packed(rows: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        texts = [t.as_py() for t in batch.column(2)]
        columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([z.compress(t) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "th", "n_bytes", "sha", "z"])

    return common.arrow_map(rows, run, "id long, th long, n_bytes long, sha string, z binary")


def blocks(texts: DataFrame, span: int, width: int) -> DataFrame:
    """The blocks of ``texts.cuts`` with their bytes, and where they are."""
    schema = _BLOCK + ", id long, th long, at int"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        z = zstandard.ZstdDecompressor()
        for ident, th, packed, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
            text, ident, th = z.decompress(packed.as_py()), ident.as_py(), th.as_py()
            flat = spans.values.flatten()
            for first, off, n in zip(*(c.to_pylist() for c in flat), strict=True):
                core, end = first - off + width - 1, first - off + span
                rows.append((*_hash128(text[core:end]), text[first:core], text[end : first + n + span - 1], n, ident, th, first))
            if len(rows) > 20_000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return common.arrow_map(texts.where("cuts IS NOT NULL").select("id", "th", "z", "cuts"), run, schema)


def _narrowed(rows: DataFrame, wide: int, width: int) -> DataFrame:
    """Wide blocks cut into narrower ones whose cores hold more context; ``p1``, ``p2``, ``pb``, ``at``: the wide one and the place in it."""
    schema = _BLOCK + ", weight long, p1 long, p2 long, pb long, at int"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for b in batch.to_pylist():
            head, tail = b["head"], b["tail"]
            offset = wide - 1 - len(head)  # of the block's first window in its aligned place
            place = offset // width * width
            core = b["g1"].to_bytes(8, "big", signed=True) + b["g2"].to_bytes(8, "big", signed=True)
            while place < offset + b["n"]:
                first, stop = max(place, offset), min(place + width, offset + b["n"])
                core_at = place + width - 1 - offset
                g1, g2 = _hash128(core, place.to_bytes(4, "big"), len(head[core_at:]).to_bytes(4, "big"), head[core_at:], tail[:place])
                out.append((g1, g2, head[first - offset : core_at], tail[place : stop - 1], stop - first, b["weight"], b["g1"], b["g2"], b["b"], first - offset))
                place += width
        if out:
            yield _batch(out, schema)

    return common.arrow_map(rows.select("g1", "g2", "head", "tail", "n", "weight", "b"), run, schema)


def _different(rows: DataFrame, weight) -> DataFrame:
    """Equal blocks as one, with their number."""
    return rows.groupBy("g1", "g2", "b").agg(F.sum(weight).alias("weight"), *[F.first(c).alias(c) for c in ("head", "tail", "n")])


_IDENTITY = F.xxhash64  # of head, its length and tail, within one core


def _core_text(group: list[tuple]) -> np.ndarray:
    """The text of one core: its blocks, separated; blocks that occur more than once stand in it twice."""
    parts, separators = [], sum(1 + (b[5] > 1) for b in group)
    number = 0
    for _, _, _, head, tail, weight, _ in group:
        body = [np.frombuffer(head, np.uint8).astype(np.int64) + separators, [separators + 256], np.frombuffer(tail, np.uint8).astype(np.int64) + separators]
        for _ in range(1 + (weight > 1)):
            parts += [*body, [number]]
            number += 1
    return np.concatenate(parts).astype(np.int32)


def _group_repeats(group: list[tuple], repeated: np.ndarray) -> Iterator[tuple]:
    """Runs of repeated windows of each block: (g1, g2, b, first, end)."""
    at = 0
    for g1, g2, b, head, tail, weight, n in group:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], repeated[at : at + n], [False])).astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            yield g1, g2, b, lo, hi
        at += (len(head) + len(tail) + 2) * (1 + (weight > 1))


def array_repeats(rows: DataFrame, width: int) -> DataFrame:
    """Suffix arrays over the blocks of whole cores, which must come together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[list[tuple], np.ndarray]] = []
        group: list[tuple] = []
        symbols = 0

        def sort() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            short = sorted((w for w in waiting if len(w[1]) <= ROW_SYMBOLS), key=lambda w: len(w[1]))
            while short:  # texts of much the same length are sorted in step
                most = 1.25 * len(short[0][1]) + 4
                take = [w for w in short[: 1 + STEP_SYMBOLS // len(short[0][1])] if len(w[1]) <= most]
                texts = [t for _, t in take]
                sorted_ = repeated_starts_rows(texts, width) if len(take) >= FEW_ROWS else [repeated_starts(t, width) for t in texts]
                for (blocks_, _), found in zip(take, sorted_, strict=True):
                    out += _group_repeats(blocks_, found)
                short = short[len(take) :]
            for blocks_, text in waiting:
                if len(text) > ROW_SYMBOLS:
                    out += _group_repeats(blocks_, repeated_starts(text, width))
            waiting.clear()
            if out:
                yield _batch(out, _FOUND)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("g1", "g2", "b", "head", "tail", "weight", "n")]
            for b in zip(*columns, strict=True):
                if group and group[0][:2] != b[:2]:
                    if len(group) > 1 or group[0][5] > 1:
                        waiting.append((group, _core_text(group)))
                        symbols += len(waiting[-1][1])
                    group = []
                    if symbols > BATCH_SYMBOLS:
                        yield from sort()
                        symbols = 0
                group.append(b)
        if group and (len(group) > 1 or group[0][5] > 1):
            waiting.append((group, _core_text(group)))
        yield from sort()

    spark = rows.sparkSession
    dealt = rows.select("g1", "g2", "b", "head", "tail", "weight", "n").repartition(common.partitions(spark), "g1", "g2").sortWithinPartitions("g1", "g2")
    return dealt.mapInArrow(run, _FOUND)


def _found(rows: DataFrame, level: int, crowd: int) -> DataFrame:
    """Repeated windows of different blocks (``rows``): ``g1``, ``g2``, ``b``, first ``lo``, end ``hi``."""
    width = WIDTHS[level]
    if width == 1:
        return array_repeats(rows, 1)
    crowded_cores = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks") > crowd).select("g1", "g2")
    crowded_cores = common.staged(crowded_cores, "crowded")
    if crowded_cores.isEmpty():
        return array_repeats(rows, width)
    few = array_repeats(rows.join(crowded_cores, ["g1", "g2"], "left_anti"), width)
    narrow = _narrowed(rows.join(crowded_cores, ["g1", "g2"], "left_semi"), width, WIDTHS[level + 1])
    narrow = common.staged(narrow.withColumn("b", _IDENTITY("head", F.length("head"), "tail")), "narrow")
    deeper = _found(common.staged(_different(narrow, "weight"), "different"), level + 1, crowd)
    back = narrow.select("g1", "g2", "b", "p1", "p2", "pb", "at").join(deeper, ["g1", "g2", "b"])
    return few.union(back.select("p1", "p2", "pb", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))


def repeated_windows(texts: DataFrame, span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """Runs of repeated windows: ``id``, ``th``, first start ``lo`` and end of starts ``hi``."""
    made, path = common.staged_at(blocks(texts, span, WIDTHS[0]).withColumn("b", _IDENTITY("head", F.length("head"), "tail")), "blocks")
    different, different_path = common.staged_at(_different(made, F.lit(1)), "different")
    found = common.staged(_found(different, 0, crowd), "found")
    common.remove(texts.sparkSession, different_path)
    back = made.select("g1", "g2", "b", "id", "th", "at").join(found, ["g1", "g2", "b"])
    out = common.staged(back.select("id", "th", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")), "repeats")
    common.remove(texts.sparkSession, path)
    return out


def _removed(text: bytes, runs: list[tuple[int, int]], span: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and the bytes that stay."""
    kept, at, spans, gone = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(runs):
        hi += span - 1
        if lo > end:  # not touching the run before
            spans += 1
            kept.append(text[at:lo])
            at = lo
        if hi > at:
            gone += hi - at
            at = hi
        end = max(end, hi)
    kept.append(text[at:])
    return gone, spans, b"".join(kept)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept`` bytes."""
    spark = docs.sparkSession
    rows = _hashed(docs, id_col, text_col)
    cut, path = common.staged_at(cuts(rows, span, gram, WIDTHS[0]), "cuts")
    texts = texts_with_cuts(rows, cut)
    common.remove(spark, path)
    runs = repeated_windows(texts, span, crowd)
    lists = runs.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    held = texts.where("cuts IS NOT NULL").select("id", "th", "z")
    joined = held.join(lists, held["id"].eqNullSafe(lists["id"]) & (held["th"] == lists["th"]), "left").select(held["id"], "z", "runs")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z, rows = zstandard.ZstdDecompressor(), []
        for packed, found in zip(batch.column(1), batch.column(2), strict=True):
            text = z.decompress(packed.as_py())
            gone, spans, kept = _removed(text, [(r["lo"], r["hi"]) for r in found.as_py() or ()], span)
            rows.append((len(text), gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        arrays = [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    cleaned = common.arrow_map(joined, run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if with_text:
        whole = _hashed(docs, id_col, text_col)
        same = texts.where("cuts IS NULL").select("id", "th", "n_bytes", "sha").distinct()
        whole = whole.join(same, whole["id"].eqNullSafe(same["id"]) & (whole["th"] == same["th"])).select(whole["id"], "n_bytes", F.lit(0).cast("long"), F.lit(0).cast("long"), "sha", "text")
    else:
        zero = F.lit(0).cast("long")
        whole = texts.where("cuts IS NULL").select("id", "n_bytes", zero, zero, "sha", F.lit(None).cast("binary"))
    out = cleaned.union(whole).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
