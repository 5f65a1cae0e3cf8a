"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import components, cotraining, decontaminate, license_scan, line_rules, mixing, near_copies, sharding, simhash, substring_index, suffix_dedup, templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double"


def make_docs():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(130))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    texts += [texts[3]] * 4 + [f"{t} {passage} {t}" for t in texts[5:10]] + [None, "", "   \n\t ", "one", "Ünïcode é ß " * 40, "x" * 5000, passage]
    texts += [texts[20] + " changed"]
    rows = [(i, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}", len(t or ""), 1, 0.0) for i, t in enumerate(texts)]
    return [*rows, (None, texts[7], "en", "hot", 1, 1, 0.0), rows[2]]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def key(r):
    return tuple(str(x) for x in r)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, bits=2):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash(docs, rows, empty, crowd):
    got = [tuple(r) for r in simhash.near_duplicates(docs, crowd=crowd).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_one_of_a_group(docs, rows):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_components(rows)}
    assert {r.doc_id for r in kept.collect()} == want | {None}


def brute_jaccard_components(rows, least=0.8):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or a and b and len(a & b) >= least * len(a | b) - 1e-9:
                group = [group[j] if g == group[i] else g for g in group]
    ids = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            ids[g] = min(ids.get(g, r[0]), r[0])
    return [(r[0], ids.get(g)) for r, g in zip(rows, group, strict=True)]


@pytest.mark.parametrize("small", [0, 100_000])
def test_components(spark, small):
    rng = random.Random(8)
    edges = [(9000, n) for n in range(200)] + [(n, n + 1) for n in range(1000, 1040)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    edges += [edges[0], (5, 5), (199, 1040), (-7, 8000)]
    least = {}

    def find(n):
        while least.setdefault(n, n) != n:
            n = least[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    want = {(n, find(n)) for edge in edges if edge[0] != edge[1] for n in edge}
    got = components.connected_components(spark.createDataFrame(edges, "x long, y long"), small=small).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert components.connected_components(spark.createDataFrame([], "x long, y long"), small=small).count() == 0


def test_near_copies_compares_only_texts_whose_prefixes_share_enough(spark, monkeypatch):
    texts = [[f"w{i}x{j}" for j in range(200)] for i in range(60)]
    for i in range(60):
        for j in range(10):  # a passage of five words with each of ten others
            for k, slot in ((i, j), ((i + j + 1) % 60, 10 + j)):
                texts[k][10 * slot : 10 * slot + 5] = [f"p{i}q{j}r{x}" for x in range(5)]
    texts.append([*texts[0][:-3], "other", "last", "words"])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    compared, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = dict(map(tuple, near_copies.near_copies(docs).collect()))
    assert found == {i: i for i in range(60)} | {60: 0}
    assert sum(compared) <= 3  # not the pairs that share a passage only


def test_frequent_shingles_hold_no_sorted_limit_in_their_tasks(spark, monkeypatch):
    data = [(i, " ".join("abcdefg"[k] for k in range(7) if i < (6, 5, 4, 4, 4, 4, 3)[k])) for i in range(6)]
    texts = near_copies._texts(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text")
    of = lambda words: {int(near_copies.shingles(w.encode(), 1)[0]) for w in words}
    plans, frame = [], type(texts)
    seen = lambda df: plans.append(df._jdf.queryExecution().toString()) or df
    monkeypatch.setattr(frame, "toArrow", lambda self, f=frame.toArrow: f(seen(self)))
    monkeypatch.setattr(near_copies.common, "staged_at", lambda df, label, f=near_copies.common.staged_at: f(seen(df), label))
    for last, least, most in ((4_000_000, "abcdef", "abcdef"), (2, "ab", "ab"), (4, "ab", "abcdef")):
        monkeypatch.setattr(near_copies, "LAST", last)
        found = near_copies.frequent_shingles(texts, len(data), 1).tolist()
        assert of(least) <= set(found) <= of(most) and sorted(found) == found
    assert plans and not any("TakeOrdered" in p or "Limit" in p for p in plans)  # each task would set memory aside for twice LAST rows


def test_pipeline_removes_all_near_copies(spark, rows, empty):
    import corpus_pipeline

    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(120)] for _ in range(5)]
    changed = lambda w, n: [f"z{rng.randint(0, 10**6)}" if i % (len(w) // n) == 7 else x for i, x in enumerate(w)]
    texts = [" ".join(changed(w, n)) for w in base for n in (1, 2, 2, 2, 3, 4, 6)] + [" ".join(w) for w in base]  # about 0.92 to 0.6 of the original
    chain = base[0]
    for _ in range(6):  # each a near copy of the one before only
        chain = [*chain[8:], *(f"y{rng.randint(0, 10**6)}" for _ in range(8))]
        texts.append(" ".join(chain))
    data = [*rows, *((1000 + i, t, "en", "a", 1, 1, 0.0) for i, t in enumerate(texts))]
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = brute_jaccard_components(data)
    close = {c for i, c in want if i is not None and i >= 1000}
    assert 5 <= len(close) < len(texts) / 2
    assert sorted(map(tuple, near_copies.near_copies(docs).collect()), key=key) == sorted(want, key=key)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want} | {None}
    assert near_copies.near_copies(empty).count() == 0


def brute_windows(rows, span):
    first = {}
    for r in rows:
        w, rank = split(r[1]), (1 << 63) - 1 if r[0] is None else r[0]
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            first[k] = min(first.get(k, rank), rank)
    out = []
    for r in rows:
        w, rank = split(r[1]), (1 << 63) - 1 if r[0] is None else r[0]
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < rank:
                gone |= set(range(i, i + span))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_index(docs, rows, empty):
    got = [tuple(r) for r in substring_index.deduplicate(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_windows(rows, 13), key=key)
    assert substring_index.deduplicate(empty).count() == 0


def test_substring_index_reopened(spark, docs, rows, tmp_path):
    root = f"file://{tmp_path}/index"
    known = docs.where("doc_id < 20")
    substring_index.deduplicate_batch(substring_index.FingerprintIndex(spark, root=root), known, known.limit(0)).count()
    index = substring_index.FingerprintIndex.open(spark, root)
    fresh = docs.where("doc_id >= 20 or doc_id is null")
    got = [tuple(r) for r in substring_index.deduplicate_batch(index, fresh, known).collect()]
    assert sorted(got, key=key) == sorted([r for r in brute_windows(rows, 13) if r[0] is None or r[0] >= 20], key=key)
    assert [level for level, _, _ in substring_index.FingerprintIndex.open(spark, root).runs] == [1]  # compacted
    index.drop()


def test_runs_are_merged_files(spark, docs):
    """After compaction a run has one sorted file a bucket; merging and joining runs exchanges nothing and sorts no run."""
    import glob

    index = substring_index.FingerprintIndex(spark, fan_in=2, buckets=3)
    made = substring_index.postings(substring_index._prepared(docs, "doc_id", "text"), 13, 5)
    halves = [made.where(F.col("rank") % 4 == k) for k in range(4)]
    try:
        for half in halves[:2]:
            index.add(half)
        ((level, name, path),) = index.runs
        assert level == 1
        files = glob.glob(path.removeprefix("file://") + "/*.parquet")
        assert 1 <= len(files) <= 3 and len({f.rpartition("_")[2] for f in files}) == len(files)
        for f in files:
            rows = spark.read.parquet("file://" + f).collect()
            assert rows == sorted(rows)
        index.add(halves[2])
        index.add(halves[3].union(halves[3]))  # repeated rows are one posting
        assert [r[0] for r in index.runs] == [2]
        assert spark.table(index.runs[0][1]).count() == made.distinct().count()
        new = index._write(halves[0].repartition(3, "fp").dropDuplicates(), 0)
        with substring_index.merge_plans(spark):
            for df, sorts in ((index.shared(new), 1), (index.merged([index.runs[0], new]), 0)):  # one sorts the few shared fingerprints of the new run
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Sort [") == sorts, plan
        index._forget(new)
    finally:
        index.drop()


def brute_bytes(rows, span):
    count = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - span + 1):
            count[b[i : i + span]] = count.get(b[i : i + span], 0) + 1
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [256, 1])
def test_suffix_dedup(docs, rows, empty, crowd):
    got = [tuple(r) for r in suffix_dedup.deduplicate(docs, crowd=crowd).collect()]
    assert sorted(got, key=key) == sorted(brute_bytes(rows, 400), key=key)
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.assign(docs, shards=6).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows), key=key)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(6))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(6)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    assert sharding.assign(empty).count() == 0
    assert sharding.shard(docs.withColumn("shard", docs["n_chars"])).count() == len(rows)


def test_line_rules(docs, rows, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_rules.clean(docs).collect()}
    want = set()
    for r in rows:
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        want.add((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    assert got == want
    assert line_rules.clean(empty).count() == 0


def brute_verdict(text, rules):
    """The rules of the docstring, line by line on strings."""
    failed, lost, total, kept = [], 0, 0, []
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        size = sum(len(w.encode()) for w in words)
        total += size
        menu = [w for w in words if w in {x.decode() for x in line_rules.SEPARATORS}]
        symbols = len(re.findall(r"[#*$%&|<>]", line))
        rule = None
        if words and len(words) < rules.min_line_words and not any(words[-1].endswith(c.decode()) for c in line_rules.CLOSING):
            rule = "punctuation"
        elif len(menu) >= 3 and len(menu) * 5 >= len(words):
            rule = "navigation"
        elif words and symbols > 3 and symbols > rules.max_symbol_share * size:
            rule = "punctuation"
        elif words and len(words) <= rules.max_notice_words and any(p in "".join(c.lower() if c.isascii() else c for c in line) for p in line_rules.BOILERPLATE):
            rule = "boilerplate"
        if rule:
            failed.append(rule)
            lost += size
        else:
            kept.append(line)
    return [failed.count(r) for r in ("punctuation", "navigation", "boilerplate")], lost <= rules.max_loss * total, "\n".join(kept)


def test_line_rules_verdict(spark, rows):
    """Every table text and planted notices of four languages against the rules stated plainly."""
    body = "This line of prose has quite a few words and it ends as a sentence does.\n"
    notices = ["Alle Rechte vorbehalten, Verlag und Autor.", "Tous droits réservés par la maison du livre.", "Todos los derechos reservados por la casa.", "Subscribe to our letters and never miss a thing.", "home | news | about | contact | more |", "Short end", "a # b # c # d # e #"]
    planted = [(2000 + i, body * 2 + n) for i, n in enumerate(notices)] + [(2100 + i, n + "\n" + n + "\n" + n + " and then some more words here.") for i, n in enumerate(notices)]
    tables = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    everything = [(r[0], r[1]) for r in rows] + planted + tables
    rules = line_rules.LineRules()
    out = line_rules.clean(spark.createDataFrame(everything, "doc_id long, text string"), with_text=True).collect()
    got = sorted(str((r.doc_id, [r.lines_punctuation, r.lines_navigation, r.lines_boilerplate], r.kept, r.clean_text)) for r in out)
    base = {(r.doc_id, r.n_words, r.n_repeat_words): r.base_failed for r in out}
    want = []
    for r in everything:
        counts, fine, text = brute_verdict(r[1], rules)
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        failed = {v for (d, k, _), v in base.items() if d == r[0] and k == n}
        assert len(failed) == 1
        want.append(str((r[0], counts, fine and not failed.pop(), text)))
    assert got == sorted(want)
    assert {r.doc_id for r in out if r.doc_id and 2000 <= r.doc_id < 2004 and r.lines_boilerplate == 1} == {2000, 2001, 2002, 2003}


def test_decontaminate(spark, docs, rows, empty):
    rng = random.Random(9)
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil green tea at midnight in old towers"
    near = item.split()
    near[4] = near[11] = "swapped"
    planted = [(100, "start " + item + " end"), (101, " ".join(near)), (102, " ".join(rng.choice(item.split()) for _ in range(60))), (103, None), (104, "")]
    table = spark.createDataFrame([(i, t, "x") for i, t in planted], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short absent"), (None, "")], "item_id long, text string")
    found = decontaminate.contaminated(table.drop("item_id"), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(100, 1), (101, 1)}
    merged = decontaminate.contaminated(table.drop("item_id"), bench, block_rows=3)
    assert sorted(map(str, merged.collect())) == sorted(map(str, found.collect()))
    assert {r.doc_id for r in decontaminate.decontaminate(table, bench).collect()} == {102, 103, 104}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def brute_contaminated(docs, items):
    out = set()
    for i, text in docs:
        d = [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w]
        for k, item in items:
            t = [w for w in re.split(r"[^a-z0-9]+", (item or "").lower()) if w]
            need = min(len(t), 13)
            for shift in range(-len(t), len(d)) if t else ():
                same = [0 <= j + shift < len(d) and d[j + shift] == w for j, w in enumerate(t)]
                if any(10 * sum(same[a : a + need]) >= 8 * need for a in range(len(t) - need + 1)):
                    out.add((i, k))
    return out


def test_short_items_are_never_missed(spark):
    """All substitutions that the rule accepts, at every length below a stretch, against brute force."""
    from itertools import combinations

    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in range(1, 14)]
    docs = []
    for n, item in items:
        words = item.split()
        for k in range(3 if n < 13 else 2):
            for gone in combinations(range(n), k):
                docs.append((1000 * n + len(docs), " ".join(["other", *("zz" if j in gone else w for j, w in enumerate(words)), "words"])))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == brute_contaminated(docs, items)


def test_cotraining(spark, empty):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("aeiourstn") for _ in range(5)) for _ in range(60))
    bad = lambda: " ".join(f"{x.upper()}!!" for x in good().split())
    data = [(i, bad() if i % 4 == 0 else good(), "en", "a", 0) for i in range(400)] + [(900, None, None, None, 0), (901, "", "en", "a", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score long")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scored = {r.doc_id: r.kept for r in cotraining.classify(docs, labels).collect()}
    held_out = [scored[i] == (i % 4 != 0) for i in range(200, 400)]
    assert sum(held_out) / len(held_out) >= 0.97 and len(scored) == 402
    kept = cotraining.filter_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in scored.items() if k}
    assert all(r.kept and r.score is None for r in cotraining.classify(docs, labels.limit(0)).collect())
    assert cotraining.classify(empty, labels).count() == 0


def test_mixing(spark, docs, rows, empty):
    drawn = mixing.sample(docs, fraction=0.6)
    again = mixing.sample(docs.repartition(2), fraction=0.6)
    assert sorted(map(str, drawn.collect())) == sorted(map(str, again.collect()))
    assert mixing.sample(docs, keep_columns=True).columns == docs.columns
    assert mixing.sample(empty).count() == 0
    cells = spark.createDataFrame([("a", "x", "p", 60), ("a", "y", "p", 20), ("b", "x", "p", 10), ("b", "y", "q", 10)], "source string, lang string, topic string, tokens long")
    share = lambda d, t: spark.createDataFrame(list(t.items()), f"{d} string, share double")
    targets = {"source": share("source", {"a": 0.5, "b": 0.5}), "lang": share("lang", {"x": 0.6, "y": 0.4})}
    raked, _, error = mixing.rake(mixing._with_targets(cells, targets), ("source", "lang"), 60)
    assert error < 1e-3
    by = {r.source: r.s for r in raked.groupBy("source").agg({"share": "sum"}).withColumnRenamed("sum(share)", "s").collect()}
    assert abs(by["a"] - 0.5) < 1e-3


def test_mixing_holds_the_marginals_when_cells_are_taken_whole(spark):
    cells = spark.createDataFrame([("a", "x", "p", 600), ("a", "y", "p", 900), ("b", "x", "p", 300), ("b", "y", "p", 400)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}}
    got = mixing.calibrated(cells, targets, 0.7, 0.5, 30, 1e-4).collect()
    assert any(r.probability == 1 for r in got) and all(0 <= r.probability <= 1 and r.weight == 1 for r in got)
    for dimension, target in targets.items():
        for value, share in target.items():
            assert abs(sum(r.probability * r.tokens for r in got if r[dimension] == value) / 1100 - share) < 1e-3


def test_mixing_reports_targets_out_of_reach(spark):
    cells = spark.createDataFrame([("a", "x", "p", 9000), ("b", "x", "p", 900), ("c", "x", "p", 100)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="source 'c': 2.0000% of 10.0000%"):
        got = {r.source: r for r in mixing.calibrated(cells, {"source": {"a": 0.8, "b": 0.1, "c": 0.1}}, 0.7, 0.5, 30, 1e-4).collect()}
    assert got["c"].probability == 1 and abs(sum(r.probability * r.tokens for r in got.values()) - 5000) < 1
    assert abs(got["a"].probability * 9000 / (got["b"].probability * 900) - 8) < 1e-2  # the others keep their proportion
    assert all(abs(got[s].probability * got[s].tokens * got[s].weight / 5000 - w) < 1e-3 for s, w in (("a", 0.8), ("b", 0.1), ("c", 0.1)))


def test_templates(spark):
    def page(i, host="h.example.com", body=None):
        story = body or f"<p>Story {i} has &amp; keeps  its\nwords.<p>Second {i} part<br>goes on."
        return (i, f"https://{host}/{i}", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home<li>News</ul></nav><div class='cookie-notice'>We use cookies.</div>"
                f"<article><h1>Title {i}</h1>{story}<script>var a='<p>';</script></article><section class=comments><p>nice {i}</p></section><form>Search</form><footer>&copy; {i}</footer></body></html>")

    plain = [(50 + i, f"http://plain.example.com/{i}", f"<html><body><div class=top>Welcome to our site</div><div><p>Only text {i} here.</p></div><div id=sidebar>x</div></body></html>") for i in range(8)]
    data = [page(i) for i in range(6)] + [page(6, "lonely.example.org")] + plain + [(90, None, None), (91, "http://e.example.com", ""), (92, "http://e.example.com/2", "<p>cut &am")]
    pages = spark.createDataFrame([(*d, "clash") for d in data], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in templates.extract(pages).collect()}
    for i in range(7):
        want = f"Title {i}\nStory {i} has & keeps its words.\nSecond {i} part goes on."
        assert got[i] == (want, len(want))
    assert got[50][0] == "Only text 0 here."  # the welcome line is on every page: template
    assert got[90] == ("", 0) and got[91] == ("", 0) and got[92][0] == "cut &am"
    assert templates.extract(pages.limit(0)).count() == 0


def test_templates_decide_without_names(spark):
    """Furniture under names that say nothing: brute force over the host's pages finds what repeats at its place."""
    def html(i):
        return f"<html><body><div class=q7><ul><li>Alpha<li>Beta</ul></div><div class=k2><p>Own words {i} of page {i * i}.</p><p>Shared by {i % 4}.</p></div><div class=z9>Bottom line. <span class=ad-box>buy</span></div></body></html>"

    pages = spark.createDataFrame([(i, f"http://x.example.com/{i}", html(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r for r in templates.extract(pages).collect()}
    blocks = {i: ["Alpha", "Beta", f"Own words {i} of page {i * i}.", f"Shared by {i % 4}.", "Bottom line."] for i in range(12)}
    often = {b for b in {x for v in blocks.values() for x in v} if sum(b in v for v in blocks.values()) >= 6}
    for i, own in blocks.items():
        assert got[i].text == "\n".join(b for b in own if b not in often)
        assert got[i].template_blocks == 3
    alone = templates.extract(pages.limit(1)).first()
    assert alone.text.startswith("Alpha") and alone.template_blocks == 0  # one page has no template


def test_token_classes_match_vectors(spark):
    pages = spark.createDataFrame([(i, f"http://a.example.com/{i}", "<html><body><ul>" + "<li>x" * (i % 3 + 1) + "</ul><footer>f</footer></body></html>") for i in range(9)], "page_id long, url string, html string")
    rows = templates._prepared(pages, "page_id", "url", "html")
    tokens = templates.page_tokens(rows).where("kind = 2").collect()
    vectors = {}
    for t in tokens:
        vectors.setdefault(t.token, {})[t.page] = t.n
    classes = {}
    for r in templates.token_classes(templates.page_tokens(rows))[0].where("kind = 2").collect():
        classes.setdefault((r.c1, r.c2), set()).add(r.token)
    for members in classes.values():
        assert len({tuple(sorted(vectors[m].items())) for m in members}) == 1
    assert len(classes) == len({tuple(sorted(v.items())) for v in vectors.values()}) == 2


def test_license_scan(spark, empty):
    texts = ["story\nReleased under the MIT License.", "Released under the old MIT License.", "no terms here", None, "", "x " * 3000 + "Licensed under CC BY-NC 4.0. " + "y " * 3000, "a license to thrill is not a wording"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect() if r.verdict != "unconfirmed"}
    assert set(got) == {0, 1, 5}
    assert (got[0].license, got[0].verdict) == ("MIT", "exact") and (got[5].license, got[5].verdict) == ("CC-BY-NC-4.0", "exact")
    assert got[1].verdict == "modified" and "old" in got[1].differences
    assert license_scan.scan(empty).count() == 0


def test_license_scan_in_prose(spark):
    """Wordings within prose, side by side and far apart in long texts: every planted one is found at its place."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(n))
    wordings = [w for w in license_scan.WORDINGS if w[0] not in ("Proprietary",)]
    rows, want = [], set()
    for i, (name, wording) in enumerate(wordings):
        before = prose(rng.choice((0, 9, 60, 900)))
        text = f"{before} {wording} {prose(rng.choice((0, 9, 60, 900)))}"
        rows.append((i, text))
        want.add((i, name, "exact"))
    rows.append((900, f"{prose(40)} Released under the MIT License. {prose(3)} Licensed under the Apache License, Version 2.0. {prose(5000)} Licensed under CC BY 4.0."))
    want |= {(900, "MIT", "exact"), (900, "Apache-2.0", "exact"), (900, "CC-BY-4.0", "exact")}
    rows += [(950 + k, prose(200) + " license " + prose(50)) for k in range(5)]
    got = {(r.doc_id, r.license, r.verdict) for r in license_scan.scan(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect()}
    assert {g for g in got if g[2] != "unconfirmed"} >= want
    assert {g[0] for g in got if g[2] == "exact"} == {w[0] for w in want}


def test_license_scan_among_many_cues(spark):
    """A cue every few words, texts of any length: cues that follow each other hide no wording."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9)))
    rows, want = [], set()
    for size in (500, 5_000, 20_000, 100_000):
        for gap in (60, 400):
            for i, (name, wording) in enumerate(license_scan.WORDINGS):
                words, n, since = [], 0, 0
                while n < size:
                    words.append("license" if since >= gap else word())
                    since = 0 if words[-1] == "license" else since + len(words[-1]) + 1
                    n += len(words[-1]) + 1
                at = rng.randrange(len(words))
                if size == 100_000 and i % 4:
                    continue
                rows.append((len(rows), " ".join([*words[:at], wording, *words[at:]])))
                want.add((rows[-1][0], name))
    got = {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).where("verdict = 'exact'").collect()}
    assert want <= got and len(got - want) == 0, (len(want - got), got - want)


def test_license_blocks_cover_every_wording():
    for text, reach in (("a license " * 900, 50), ("x" * 70 + "license" + "y" * 500 + "copyright" + "z" * 10, 40)):
        for lo, hi, cues in license_scan.candidate_stretches(text, reach):
            blocks = list(license_scan.candidate_blocks(lo, hi, cues, reach))
            assert all(b - a <= 3 * reach for a, b, _ in blocks)
            for a, b in cues:
                assert all(any(x <= s and s + reach <= y and (a, b) in inside for x, y, inside in blocks) for s in range(max(lo, b - reach), min(a, hi - reach) + 1))


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = f"{docs.sparkSession.conf.get('spark.checkpoint.dir', None) or '/tmp'}/pipeline-test-{random.random()}"
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if (name, stage) != corpus_pipeline.STAGES[-1]:
            assert after.columns == docs.columns
        assert 0 < after.count() <= before
        docs, before = after, after.count()
    assert {"shard", "slot"} <= set(docs.columns)
