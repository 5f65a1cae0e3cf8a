"""Sharding by histogram sort (DataFrame operations only).

Rows are ordered by a 63-bit key: 39 bits of the text's hash, then 24 bits of the id's hash, so equal
texts are neighbours and a group of copies that is larger than a shard can still be cut. The shard
borders are found like the splitters of a histogram sort: every pass counts the exact bytes in the
cells between probe keys over all partitions, keeps for each border only the cell that holds its
byte rank, and probes that cell more finely, until the border is within tolerance of its rank. Only
then do rows move, once: they are exchanged by key range and numbered inside their range.

Law: ``bytes`` (shards have nearly equal bytes).

Defined cases: a null text has no bytes (size 16) and the checksum of the empty text; a null id is an
id like any other; repeated rows are kept and get slots of their own; ``assign`` can cut
between rows that agree in id and text, ``shard`` keeps those in one shard; with fewer rows than shards some shards are empty; an empty table gives no rows;
extra columns are ignored by ``assign`` and carried by ``shard``.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of the key that each counting pass has resolved.
LEVELS = (12, 20, 28, 36, 44, 52, 60, 63)
KEY_BITS = 63
ROW_BYTES = 16


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def key_of(id_col: str, text: str, *ties: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 25), 24)
    return high.bitwiseOR(F.xxhash64(F.col(id_col), *ties).bitwiseAND(F.lit((1 << 24) - 1)))


@dataclass
class _Target:
    """A border that is being searched: its rank, and the cell known to hold it."""

    rank: float
    tolerance: float
    by: int  # 1: bytes, 2: rows
    prefix: int = 0
    below: int = 0
    cut: int | None = None


@dataclass
class ShardPlan:
    """Borders and ranges; everything in it is bounded by shards and shuffle partitions."""

    splitters: list[int]
    cuts: list[int]  # keys at which a range begins inside a first-pass cell
    base: list[int]  # range number of each first-pass cell, cuts aside
    first_slot: list[int] = field(default_factory=list)  # by range number
    passes: int = 0


def _int_array(values: list[int], kind: str) -> Column:
    """An array literal; folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _count_at_or_below(key: Column, cuts: list[int]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(_int_array(cuts, "bigint"), lambda cut: cut <= key))


def shard_of(key: Column, plan: ShardPlan) -> Column:
    return _count_at_or_below(key, plan.splitters).cast("int")


def range_of(key: Column, plan: ShardPlan) -> Column:
    """Number of the key's range. Cells without a cut need no comparison: their number is looked up."""
    shift = KEY_BITS - LEVELS[0]
    before = [bisect_left(plan.cuts, cell << shift) for cell in range(1 << LEVELS[0])]
    split_cells = sorted({cut >> shift for cut in plan.cuts})
    cell = F.shiftright(key, shift).cast("int")
    inside = F.element_at(_int_array(before, "int"), cell + 1)
    if split_cells:
        inside = F.when(cell.isin(split_cells), _count_at_or_below(key, plan.cuts)).otherwise(inside)
    return (F.element_at(_int_array(plan.base, "int"), cell + 1) + inside).cast("int")


def _settle(target: _Target, cells: list[tuple[int, int, int]], level: int) -> None:
    """Move a target into the cell that holds its rank, or cut at that cell's nearer edge."""
    shift = KEY_BITS - LEVELS[level]
    below = target.below
    for cell in cells:
        amount = cell[target.by]
        if target.rank < below + amount:
            break
        below += amount
    else:  # the rank is the end of the parent cell
        target.cut = ((cells[-1][0] + 1) << shift) if cells else target.prefix
        return
    low, high = target.rank - below, below + amount - target.rank
    if min(low, high) <= target.tolerance or level == len(LEVELS) - 1:
        target.cut = (cell[0] if low <= high else cell[0] + 1) << shift
    else:
        target.prefix, target.below = cell[0], below


def plan_shards(slim: DataFrame, shards: int, tolerance: float = 0.001) -> ShardPlan:
    """Find the borders from a frame with ``__key`` and ``__size``. Each pass is one aggregation whose
    result has at most 4096 rows, or 256 for each border still searched."""
    ranges = common.partitions(slim.sparkSession)

    def histogram(frame: DataFrame, level: int) -> list[tuple[int, int, int]]:
        cell = F.shiftright("__key", KEY_BITS - LEVELS[level])
        rows = frame.groupBy(cell.alias("cell")).agg(F.sum("__size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["cell"], r["b"], r["n"]) for r in rows)

    top = histogram(slim, 0)
    total_bytes, total_rows = sum(c[1] for c in top), sum(c[2] for c in top)
    share, even = total_bytes / shards, max(1, total_rows // ranges)
    targets = [_Target(share * i, tolerance * share, 1) for i in range(1, shards)]

    base, number, gathered, seen, filled = [], 0, 0, 0, dict((c[0], c) for c in top)
    for cell in range(1 << LEVELS[0]):
        rows = filled.get(cell, (0, 0, 0))[2]
        if gathered and gathered + rows > even:
            number, gathered = number + 1, 0
        base.append(number)
        gathered += rows
        if rows > 2 * even:  # a heavy cell: cut it by rows as well
            targets += [_Target(seen + even * i, even / 4, 2) for i in range(1, rows // even)]
        seen += rows

    for target in targets if total_rows else []:
        _settle(target, top, 0)
    passes = 1
    for level in range(1, len(LEVELS)):
        open_targets = [t for t in targets if t.cut is None]
        if not total_rows or not open_targets:
            break
        parent = F.shiftright("__key", KEY_BITS - LEVELS[level - 1])
        cells = histogram(slim.where(parent.isin(sorted({t.prefix for t in open_targets}))), level)
        step = LEVELS[level] - LEVELS[level - 1]
        children: dict[int, list[tuple[int, int, int]]] = {}
        for cell in cells:
            children.setdefault(cell[0] >> step, []).append(cell)
        for target in open_targets:
            _settle(target, children[target.prefix], level)
        passes += 1

    end = 1 << KEY_BITS
    splitters = sorted(min(t.cut, end - 1) for t in targets if t.by == 1 and t.cut is not None)
    cuts = sorted({min(t.cut, end - 1) for t in targets if t.cut is not None})
    return ShardPlan(splitters, cuts, base, passes=passes)


def number_ranges(slim: DataFrame, plan: ShardPlan) -> ShardPlan:
    """Count the rows of each range; the first slot of a range follows the rows before it in its shard."""
    rows = (
        slim.groupBy(range_of(F.col("__key"), plan).alias("range"), shard_of(F.col("__key"), plan).alias("shard"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    first = [0] * (plan.base[-1] + len(plan.cuts) + 1)
    filled: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["range"], r["shard"])):
        first[r["range"]] = filled.get(r["shard"], 0)
        filled[r["shard"]] = first[r["range"]] + r["n"]
    plan.first_slot = first
    return plan


def place(rows: DataFrame, plan: ShardPlan, ties: list[Column]) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have ``__key``: the one exchange."""
    ranged = rows.withColumns({"__range": range_of(F.col("__key"), plan), "shard": shard_of(F.col("__key"), plan)})
    in_range = Window.partitionBy("__range").orderBy("__key", *ties)
    slot = F.row_number().over(in_range) - 1 + F.element_at(_int_array(plan.first_slot, "bigint"), F.col("__range") + 1)
    return ranged.withColumn("slot", slot.cast("long")).drop("__range", "__key")


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """Shard and slot of every row, without the texts: id, size, text_crc32, law, shard, slot, grown_shard."""
    slim = common.staged(
        docs.select(
            F.col(id_col).alias("__id"),
            size_of(text_col).alias("__size"),
            F.crc32(common.text_bytes(text_col)).alias("__crc"),
            key_of(id_col, text_col, F.monotonically_increasing_id()).alias("__key"),  # staged here, so it stays
        ),
        "shard",
    )
    plan = number_ranges(slim, plan_shards(slim, shards, tolerance))
    return place(slim, plan, [F.col("__id"), F.col("__crc")]).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot`` (columns of those names are replaced)."""
    docs = docs.drop("shard", "slot")
    slim = common.staged(docs.select(size_of(text_col).alias("__size"), key_of(id_col, text_col).alias("__key")), "shard")
    plan = number_ranges(slim, plan_shards(slim, shards, tolerance))
    return place(docs.withColumn("__key", key_of(id_col, text_col)), plan, [F.col(id_col)])


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder per shard, rows in slot order inside each file."""
    shard(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
