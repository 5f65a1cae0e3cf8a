"""Token ids in binary files of Re-Pair grammars, in ascending order of document ids.

``write`` deals documents by range of id, encodes every whole text and ends each document with ``end``. A
task cuts its ids into shards at documents' ends and compresses each by a grammar of its own (``grammar``). The
file format is a Parquet folder (Spark commits it, so lost executors and repeated tasks leave no half file) with one row a shard:

- ``part``, ``shard``: the range of ids and the shard within it; ``first``: ids of the range before the shard; ``n_ids``;
- ``vocabulary``; ``rules``: two symbols a nonterminal; ``lengths``: ids each expands to; ``symbols``: the text of
  the grammar (all little-endian unsigned 32-bit, compressed by the file);
- ``doc_ids``, ``doc_symbols``, ``doc_tokens``: by document its id, symbols and ids.

``read`` decodes all; ``window`` decodes some ids of some documents: it prunes shards by id and expands no symbol outside.

Where the tokenizer's own rules part texts at white space, words are encoded apart, each distinct one once while
a task's worker remembers it: the ids are those of the whole text. Other tokenizers get whole texts.

Cases: a null or empty text has only the end id. Equal document ids are put in order of their texts, null ids come first. A text of any
length is one document of one shard. An empty table gives an empty folder and no rows."""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .grammar import Grammar, compress

#: Ids a shard holds before it is closed at a document's end.
SHARD_IDS = 1_000_000
#: Distinct words a worker remembers; when they are more, it starts anew.
WORDS = 800_000
#: Bytes of text encoded at a time.
PIECE = 8 << 20
#: Marks that may end a word: letters before them are a token run of their own.
ENDINGS = ".,;:!?"

SCHEMA = (
    "part int, shard int, first long, n_ids long, least_id long, greatest_id long, vocabulary int, rules binary, lengths binary, symbols binary, "
    "doc_ids array<long>, doc_symbols array<int>, doc_tokens array<int>"
)


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def parts_at_spaces(tokenizer: dict) -> bool:
    """Does a ``tokenizers`` JSON lower-case texts and drop white space between parts that are encoded apart: is a text's encoding that
    of its words, and a word of a-z one part that the model gets as it is?"""
    steps = tokenizer.get("normalizer") or {}
    kinds = [s["type"] for s in steps.get("normalizers", [steps] if steps else [])]
    first, *rest = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[\p{L}]+" in first.get("pattern", {}).get("Regex", "").split("|")
    plain = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in rest)
    special = all(t["special"] and not t["normalized"] and "<" in t["content"] for t in tokenizer.get("added_tokens", []))
    return bool(drops and plain and special and "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"} and tokenizer["model"]["type"] == "BPE")


class Encoder:
    """Ids of texts by a ``tokenizers`` JSON; where it parts texts at white space, each distinct word is encoded once and remembered."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.by_words = parts_at_spaces(json.loads(tokenizer))
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def _cores(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words without the marks at their ends, and these marks; in lower case where that changes no special token."""
        cores = pc.ascii_rtrim(words, ENDINGS)
        plain = pc.and_(pc.invert(pc.match_substring(words, "<")), pc.match_substring_regex(cores, r"[\pL\pN]$"))
        tails = pc.replace_substring_regex(words, f"^.*?([{ENDINGS}]*)$", r"\1")
        return pc.if_else(plain, pc.ascii_lower(cores), words), pc.if_else(plain, tails, "")

    def places(self, words: pa.Array) -> np.ndarray:
        """Where in ``starts`` each of some distinct words' ids are; those not known are encoded."""
        found = pc.index_in(words, value_set=self.known)
        fresh = words.filter(pc.is_null(found))
        if len(fresh) and len(self.known) and len(self.known) + len(fresh) > WORDS:
            self._reset()
            fresh = words
        at = len(self.known)
        if len(fresh):
            model, texts = self.tokenizer.model, fresh.to_pylist()
            encoded = [[t.id for t in model.tokenize(w)] if w.isascii() and w.isalpha() else None for w in texts]
            odd = [i for i, e in enumerate(encoded) if e is None]
            for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
                encoded[i] = e.ids
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(encoded), np.uint32)])
            self.starts = np.concatenate([self.starts, np.cumsum([len(e) for e in encoded]) + self.starts[-1]])
            self.known = pa.concat_arrays([self.known, fresh])
        if len(fresh) == len(words):
            return np.arange(at, at + len(words))
        out = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        out[out < 0] = np.arange(at, at + len(fresh))
        return out

    def _ragged(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.starts[places + 1] - self.starts[places]
        return gathered(self.ids, self.starts[places], sizes), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(e) for e in found], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        if not len(words.dictionary):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        cores, tails = (x.dictionary_encode() for x in self._cores(words.dictionary))
        both = pa.concat_arrays([cores.dictionary, tails.dictionary]).dictionary_encode()
        place = self.places(both.dictionary)[both.indices.to_numpy()]
        table, sizes = self._ragged(np.stack([place[cores.indices.to_numpy()], place[len(cores.dictionary) + tails.indices.to_numpy().astype(np.int64)]], axis=1).ravel())
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        used = words.indices.to_numpy()
        n = sizes[used]
        ids = gathered(table, starts[used], n)
        ends = np.concatenate([[0], np.cumsum(n)])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return ids, np.diff(ends[bounds])


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and len(values) < 2**31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


def _encoder(tokenizer: str) -> Encoder:
    """The worker's encoder: it outlives the task, as words recur from task to task."""
    kept = sys.modules.setdefault("_tabloom_worker", types.ModuleType("_tabloom_worker")).__dict__
    key = f"encoder-{zlib.crc32(tokenizer.encode())}"
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(tokenizer)
    return kept[key]


def _little(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 1, shard_ids: int = SHARD_IDS, parts: int | None = None) -> None:
    """Encode ``doc_id`` and ``text`` into a new folder; ``tokenizer`` is the path of a ``tokenizers`` JSON."""
    with open(tokenizer or public_path(), encoding="utf-8") as f:
        given = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the corpus

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(given.value)
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        names: list = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal shard, first, held, names, ids, sizes
            row = _row(part, shard, first, names, np.concatenate(ids), np.concatenate(sizes), encoder.vocabulary)
            shard, first, held, names, ids, sizes = shard + 1, first + held, 0, [], [], []
            return row

        for batch in batches:
            for piece in _pieces(batch):
                found, n = encoder.encode(piece.column(1))
                bounds = np.concatenate([[0], np.cumsum(n)])
                found = np.insert(found, bounds[1:], np.uint32(end))  # each document's end
                n, doc_ids, begin, done = n + 1, piece.column(0).to_pylist(), 0, 0
                for stop in np.append(np.flatnonzero(np.diff((held + np.cumsum(n)) // shard_ids, prepend=held // shard_ids)) + 1, len(n)):
                    if stop == begin:
                        continue
                    taken = int(n[begin:stop].sum())
                    names += doc_ids[begin:stop]
                    ids.append(found[done : done + taken])
                    sizes.append(n[begin:stop])
                    held, done, begin = held + taken, done + taken, stop
                    if held >= shard_ids:
                        yield closed()
        if names:
            yield closed()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    dealt = chosen.repartitionByRange(parts or common.partitions(docs.sparkSession), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    dealt.mapInArrow(shards, SCHEMA).write.option("compression", "zstd").parquet(path)
    given.unpersist()


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PIECE`` bytes of text, one row at least."""
    upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PIECE)))
        yield batch.slice(begin, end - begin)
        begin = end


def _row(part: int, shard: int, first: int, names: list, ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> pa.RecordBatch:
    grammar, symbols, held = compress(ids, sizes, vocabulary)
    known = [n for n in names if n is not None]
    values = {
        "part": part, "shard": shard, "first": first, "n_ids": len(ids), "least_id": min(known, default=None), "greatest_id": max(known, default=None), "vocabulary": vocabulary,
        "rules": _little(np.stack([grammar.left, grammar.right], axis=1).ravel()), "lengths": _little(grammar.lengths), "symbols": _little(symbols), "doc_ids": names, "doc_symbols": held.tolist(), "doc_tokens": sizes.tolist(),
    }
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values.values(), kinds, strict=True)], names=list(values))


def _opened(row: dict) -> tuple[Grammar, np.ndarray]:
    rules = _numbers(row["rules"]).reshape(-1, 2)
    return Grammar(row["vocabulary"], rules[:, 0], rules[:, 1], _numbers(row["lengths"])), _numbers(row["symbols"])


def _decoded(row: dict) -> np.ndarray:
    """All ids of a shard."""
    grammar, symbols = _opened(row)
    table, starts = grammar.flat()
    everything = np.concatenate([np.arange(grammar.vocabulary, dtype=np.uint32), table.astype(np.uint32)])
    begins = np.where(symbols < grammar.vocabulary, symbols, 0)
    if len(starts):
        deep = symbols >= grammar.vocabulary
        begins[deep] = starts[symbols[deep] - grammar.vocabulary] + grammar.vocabulary
    return gathered(everything, begins, grammar.sizes(symbols))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: ``doc_id, part, first`` (ids of its part before it), ``n_tokens, ids_crc32`` and, if asked for, ``ids``."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            ids = _decoded(row).astype("<u4")
            n = np.asarray(row["doc_tokens"], np.int64)
            ends = np.cumsum(n)
            view = memoryview(ids).cast("B")
            crcs = [zlib.crc32(view[4 * int(b - k) : 4 * int(b)]) for b, k in zip(ends, n, strict=True)]
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(n), pa.int32()), pa.array(row["first"] + ends - n), pa.array(n), pa.array(crcs, pa.int64())]
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int32)))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + lists, names=["doc_id", "part", "first", "n_tokens", "ids_crc32", *["ids"][: len(lists)]])

    return _stored(spark, path).mapInArrow(documents, "doc_id long, part int, first long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def window(spark: SparkSession, path: str, least_id: int, greatest_id: int, first: int, last: int) -> DataFrame:
    """``doc_id, ids``: ids ``first`` to ``last`` (exclusive) of each document between two ids, by random access."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            grammar, symbols = _opened(row)
            ends = np.cumsum(row["doc_symbols"])
            for name, end, held, size in zip(row["doc_ids"], ends, row["doc_symbols"], row["doc_tokens"], strict=True):
                if name is not None and least_id <= name <= greatest_id:
                    ids = grammar.cut(symbols[end - held : end], min(max(first, 0), size), min(last, size))
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    near = _stored(spark, path).where((F.col("greatest_id") >= least_id) & (F.col("least_id") <= greatest_id))
    return near.mapInArrow(cut, "doc_id long, ids array<int>")


def digests(docs: DataFrame, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files written for ``docs``."""
    spark = docs.sparkSession
    path = common.scratch(spark, "ids")
    write(docs, path, tokenizer, end)
    total, bases = 0, []
    for row in _stored(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one number a part
        bases.append((row["part"], total))
        total += row["n"]
    known = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return read(spark, path, with_ids=False).join(known, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
