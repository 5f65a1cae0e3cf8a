"""Substring deduplication over a log-structured fingerprint index.

A word is removed when it lies in a window of ``span`` consecutive words that also starts in a
document with a smaller id.

The index maps window fingerprints to documents. Windows that follow each other mostly share a
fingerprint (the least hash among their ``gram``-word pieces), so the index is complete for all windows
at a fraction of their number. It is log-structured: documents arrive in batches; each batch becomes an
immutable run, a table bucketed by fingerprint with one sorted file a bucket; it is merge-joined with the runs of history,
bucket by bucket and without moving or sorting them, to find the fingerprints that more than one document has;
and runs of one level are compacted into one of the next by merging their sorted files bucket by bucket (a full merge
join on all columns, without an exchange), so a run always has one file a bucket. A manifest names the runs
of an index in a folder of its own: it can be opened again and given the next batch (``deduplicate_batch``).

Candidates are then verified window by window: the texts behind shared fingerprints are cut into runs
of windows, equal runs are counted once, and where runs with one fingerprint differ each window is
compared by a second hash, over all its words, together with the fingerprint: 128 bits in all. The
document with the smallest id keeps the window.

Defined cases: a null text has no words; documents below ``span`` words lose nothing; rows with one id
are one document for "smaller", so repeated rows do not remove each other; a null id counts as larger
than all others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .anchors import anchor_runs, gram_hashes

SPAN = 13
GRAM = 5
NO_ID = (1 << 63) - 1
POSTING = "fp long, rank long, part tinyint"


def _word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ident = F.col(id_col).cast("long")
    text = common.text_bytes(text_col)
    return docs.select(F.coalesce(ident, F.lit(NO_ID)).alias("rank"), ident.alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _part(th: str = "th"):
    """Divides the texts of one id, so that an id that very many rows have is not one group."""
    return F.pmod(th, F.lit(128)).cast("tinyint").alias("part")


def postings(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``fp``, ``rank``, ``part``: the fingerprints of every document's windows, once each."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps, ranks, parts = [], [], []
        for rank, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = text.as_py().split()
            if len(words) < span:
                continue
            keys = np.unique(np.concatenate([key for _, _, _, key in anchor_runs(_word_codes(words), span, gram)])).view(np.int64)
            fps.append(keys)
            ranks.append(np.full(len(keys), rank, np.int64))
            parts.append(np.full(len(keys), part, np.int8))
        if fps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (fps, ranks, parts)], ["fp", "rank", "part"])

    return common.arrow_map(docs.select("rank", _part(), "text"), run, POSTING)


#: One sorted file a bucket is read as sorted, and equal keys may be a bucket's key and more.
_MERGE = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextlib.contextmanager
def merge_plans(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside read runs in their order."""
    before = {k: spark.conf.get(k, None) for k in _MERGE}
    for k, v in _MERGE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@dataclass
class FingerprintIndex:
    """Sorted immutable runs of postings, newest last. With a ``root`` they are kept there, named by a manifest."""

    spark: SparkSession
    fan_in: int = 2
    root: str | None = None
    buckets: int = 0
    runs: list[tuple[int, str, str]] = field(default_factory=list)  # level, table, path
    version: int = 0
    given: list[str] = field(default_factory=list)  # staged candidates

    def __post_init__(self) -> None:
        self.buckets = self.buckets or common.partitions(self.spark)

    @classmethod
    def open(cls, spark: SparkSession, root: str, fan_in: int = 2) -> FingerprintIndex:
        """The index that ``save`` left in ``root``, by its newest manifest."""
        rows = spark.read.schema("version int, buckets int, position int, level int, path string").json(f"{root}/manifest")
        newest = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("position").collect()
        index = cls(spark, fan_in, root, newest[0]["buckets"], version=newest[0]["version"])
        for row in newest:
            name = f"tabloom_run_{uuid.uuid4().hex[:12]}"
            clustered = f"CLUSTERED BY (fp) SORTED BY (fp, rank, part) INTO {index.buckets} BUCKETS"
            spark.sql(f"CREATE TABLE {name} ({POSTING}) USING parquet {clustered} LOCATION '{row['path']}'")
            index.runs.append((row["level"], name, row["path"]))
        return index

    def save(self) -> None:
        """Write a manifest of the runs as they are now, beside the older ones."""
        self.version += 1
        rows = [(self.version, self.buckets, i, level, path) for i, (level, _, path) in enumerate(self.runs)]
        self.spark.createDataFrame(rows, "version int, buckets int, position int, level int, path string").coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str, str]:
        name = f"tabloom_run_{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{name}" if self.root else common.scratch(self.spark, "run")
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp", "rank", "part").option("compression", "zstd").option("path", path).saveAsTable(name)
        return level, name, path

    def _forget(self, run: tuple[int, str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[1]}")
        common.remove(self.spark, run[2])

    def add(self, batch: DataFrame) -> DataFrame:
        """Append a batch of postings as a run; returns the postings of all fingerprints of the batch that
        more than one document has (in history or in the batch)."""
        run = self._write(batch.repartition(self.buckets, "fp").dropDuplicates(), 0)
        with merge_plans(self.spark):
            candidates, path = common.staged_at(self.shared(run), "candidates")
        self.given.append(path)
        self.runs.append(run)
        self._compact()
        return candidates

    def shared(self, run: tuple[int, str, str]) -> DataFrame:
        """The postings of a new run, and of the runs before, whose fingerprint another document has too."""
        new = self.spark.table(run[1])
        several = new.groupBy("fp").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi").select("fp")
        found = [new.join(several.hint("merge"), "fp", "left_semi")]
        for _, name, _ in self.runs:
            old = self.spark.table(name)
            found += [new.join(old.hint("merge"), "fp", "left_semi"), old.join(new.hint("merge"), "fp", "left_semi")]
        return reduce(DataFrame.union, found)

    def merged(self, runs: list[tuple[int, str, str]]) -> DataFrame:
        """The postings of some runs, each once: their sorted buckets, merged."""
        return reduce(lambda a, b: a.join(b.hint("merge"), ["fp", "rank", "part"], "full"), [self.spark.table(name) for _, name, _ in runs])

    def forget_candidates(self) -> None:
        """Remove the staged candidates that ``add`` gave, when they have been used."""
        for path in self.given:
            common.remove(self.spark, path)
        self.given = []

    def _compact(self) -> None:
        """Merge the newest runs while they are of one level. Their files are bucketed and sorted alike, so a bucket of the merged
        run is written by the task that merges its files: no row is exchanged."""
        while len(self.runs) >= self.fan_in and len({level for level, _, _ in self.runs[-self.fan_in :]}) == 1:
            old = self.runs[-self.fan_in :]
            with merge_plans(self.spark):
                merged = self._write(self.merged(old), old[0][0] + 1)
            self.runs[-self.fan_in :] = [merged]
            if self.root:
                self.save()  # before the old runs go
            for run in old:
                self._forget(run)

    def drop(self) -> None:
        for run in self.runs:
            self._forget(run)
        self.runs = []


def _with_candidates(rows: DataFrame, candidates: DataFrame, with_text: bool) -> DataFrame:
    """Every row with its shared fingerprints; rows without have their counts, and rows with them their compressed text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        counts, shas, packed = [], [], []
        for t in batch.column(3):
            text = t.as_py()
            words = text.split()
            counts.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            packed.append(z.compress(text))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(packed, pa.binary())], ["rank", "id", "th", "n_words", "sha", "z"])

    packed = common.arrow_map(rows.select("rank", "id", "th", "text"), run, "rank long, id long, th long, n_words long, sha string, z binary")
    lists = candidates.groupBy("rank", "part").agg(F.collect_set("fp").alias("fps"))
    joined = packed.withColumn("part", _part()).join(lists, ["rank", "part"], "left")
    held = F.col("fps").isNotNull() | F.lit(with_text)
    return joined.select("rank", "id", "th", "n_words", "sha", F.when(held, F.col("z")).alias("z"), "fps")


def _shared_runs(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """Runs of windows behind shared fingerprints; ``wh`` has the window hashes, 8 bytes each."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(6)]
        z = zstandard.ZstdDecompressor()
        for rank, th, packed_text, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            codes = _word_codes(z.decompress(packed_text.as_py()).split())
            if len(codes) < span:
                continue
            wanted = np.sort(fps.values.to_numpy(zero_copy_only=False))
            hashes = gram_hashes(codes, span)
            for begin, end, _, key in anchor_runs(codes, span, gram):
                key = key.view(np.int64)
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                cols[0] += key[hit].tolist()
                cols[1] += [rank] * len(hit)
                cols[2] += [th] * len(hit)
                cols[3] += begin[hit].tolist()
                cols[4] += (end - begin)[hit].tolist()
                cols[5] += [hashes[b:e].tobytes() for b, e in zip(begin[hit].tolist(), end[hit].tolist(), strict=True)]
            if len(cols[0]) > 50_000:
                yield _run_batch(cols)
                cols = [[] for _ in range(6)]
        if cols[0]:
            yield _run_batch(cols)

    return common.arrow_map(texts.where("fps IS NOT NULL").select("rank", "th", "z", "fps"), run, "fp long, rank long, th long, start long, n int, wh binary")


def _run_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["fp", "rank", "th", "start", "n", "wh"])


def _windows(runs: DataFrame) -> DataFrame:
    """One row per window of each run: ``fp``, ``h``, ``first``, the run ``rk`` and the offset in it."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        hashes = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(3)]
        n = np.array([len(h) for h in hashes])
        repeated = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n)) for i in range(3)]
        offset = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
        yield pa.RecordBatch.from_arrays([*repeated, pa.array(np.concatenate(hashes)), pa.array(offset)], ["fp", "rk", "first", "h", "offset"])

    return common.arrow_map(runs.select("fp", "rk", "first", "wh"), run, "fp long, rk long, first long, h long, offset int")


def verified(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Runs of windows to remove: ``rank``, ``th``, first window ``lo``, end ``hi``."""
    spark = texts.sparkSession
    members, members_path = common.staged_at(_shared_runs(texts, span, gram).withColumn("rk", F.xxhash64("wh")), "members")
    distinct, distinct_path = common.staged_at(members.groupBy("fp", "rk").agg(F.min("rank").alias("first")), "runs")
    several = distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp")
    # the window hashes move only where runs with one fingerprint differ, and once for equal runs
    one = members.select("fp", "rk", "wh").join(several, "fp", "left_semi").dropDuplicates(["fp", "rk"])
    windows, windows_path = common.staged_at(_windows(one.join(distinct, ["fp", "rk"])), "windows")
    common.release(spark)
    least = windows.groupBy("fp", "h").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").drop("most")
    seen = windows.join(least, ["fp", "h"]).where("least < first").groupBy("fp", "rk", "first").agg(F.collect_set("offset").alias("offsets"))
    known = distinct.select("fp", "rk", "first").join(seen, ["fp", "rk", "first"], "left")
    joined = members.select("fp", "rk", "rank", "th", "start", "n").join(known, ["fp", "rk"]).where("rank > first OR offsets IS NOT NULL")
    whole = F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi")))
    single = F.transform("offsets", lambda o: F.struct((F.col("start") + o).alias("lo"), (F.col("start") + o + 1).alias("hi")))
    flagged = joined.select("rank", "th", F.inline(F.when(F.col("rank") > F.col("first"), whole).otherwise(single)))
    out = common.staged(flagged, "flagged")
    for path in (members_path, distinct_path, windows_path):
        common.remove(spark, path)
    common.release(spark)
    return out


def _cleaned(texts: DataFrame, flagged: DataFrame, span: int, id_col: str, with_text: bool) -> DataFrame:
    """The result rows of ``texts``: those without shared fingerprints as they are, the others without their repeated words."""
    lists = flagged.groupBy("rank", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("cover"))
    joined = texts.where("z IS NOT NULL").join(lists, ["rank", "th"], "left").select("id", "z", "cover")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z, out = zstandard.ZstdDecompressor(), []
        for text, cover in zip(batch.column(1), batch.column(2), strict=True):
            words = z.decompress(text.as_py()).split()
            gone = np.zeros(len(words) + 1, np.int32)
            for r in cover.as_py() or []:
                gone[r["lo"]] += 1
                gone[r["hi"] - 1 + span] -= 1
            stay = np.cumsum(gone[:-1]) == 0
            kept = b" ".join([w for w, keep in zip(words, stay.tolist(), strict=True) if keep])
            out.append((len(words), int(len(words) - stay.sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = common.arrow_map(joined, run, "id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    whole = texts.where("z IS NULL").select("id", "n_words", F.lit(0).cast("long"), "sha", F.lit(None).cast("binary"))
    out = out.union(whole).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out.drop("kept")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = 3, fan_in: int = 2, with_text: bool = False
) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, the ``kept`` text.

    The table is fed to the index in ``batches`` of rising ids, rows without an id last."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    bounds = [None, *sorted(set(cuts)), None]
    index, found = FingerprintIndex(spark, fan_in), []
    try:
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            part = docs if lo is None else docs.where((F.col(id_col) > lo) | F.col(id_col).isNull() if hi is None else F.col(id_col) > lo)
            part = part if hi is None else part.where(F.col(id_col) <= hi)
            found.append(index.add(postings(_prepared(part, id_col, text_col), span, gram)))
    finally:
        index.drop()
    common.release(spark)
    texts = common.staged(_with_candidates(_prepared(docs, id_col, text_col), reduce(DataFrame.union, found), with_text), "texts")
    index.forget_candidates()
    common.release(spark)
    return _cleaned(texts, verified(texts, span, gram), span, id_col, with_text)


def deduplicate_batch(
    index: FingerprintIndex, batch: DataFrame, history: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, with_text: bool = False
) -> DataFrame:
    """``deduplicate`` for a new batch only, against the documents that ``index`` has already (``history``, of which only
    the texts that share a fingerprint with the batch are kept and verified). The batch is added to the index."""
    rows = _prepared(batch, id_col, text_col)
    candidates = index.add(postings(rows, span, gram))
    if index.root:
        index.save()
    new = _with_candidates(rows, candidates, with_text).withColumn("new", F.lit(True))
    old = _with_candidates(_prepared(history, id_col, text_col), candidates, False).where("fps IS NOT NULL").withColumn("new", F.lit(False))
    texts = common.staged(new.union(old), "texts")
    index.forget_candidates()
    return _cleaned(texts.where("new"), verified(texts, span, gram), span, id_col, with_text)
