"""Whitening, token files and the divergence audit against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import divergence, grammar, token_ids, whitening

from .test_operators import docs, empty, rows  # noqa: F401


def vectors(spark, found):
    return spark.createDataFrame(found, "vec_id long, embedding array<float>, label int, component string, n string")


@pytest.fixture(scope="module")
def some_vectors(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(40, 40)) / 5
    x = (rng.normal(size=(300, 40)) @ mix).astype(np.float32)
    found = [(i, [float(v) for v in r], 1, "c", "n") for i, r in enumerate(x)]
    found += [found[7]] * 3 + [(None, found[8][1], None, None, None)]
    bad = [(900, None, 1, "", ""), (901, [None, *found[0][1][1:]], 1, "", ""), (902, [float("nan"), *found[0][1][1:]], 1, "", ""), (903, [float("inf")] * 40, 1, "", ""), (904, [], 1, "", ""), (905, [1.0, 2.0], 1, "", "")]
    return found + bad, found


def test_whitening(spark, some_vectors):
    given, good = some_vectors
    out = whitening.whiten(vectors(spark, given).repartition(7)).toPandas()
    x = np.floor(64 * np.array([r[1] for r in good], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    assert len(out) == n * 32 and set(out["n"]) == {n}
    assert sorted(out["component"]) == sorted(list(range(1, 33)) * n)
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    deviation = {r[0]: int(d) for r, d in zip(good, ((n * x - sums) ** 2).sum(axis=1), strict=True)}
    white = {r[0]: w for r, w in zip(good, (centred @ basis) / np.sqrt(np.maximum(values, 1e-300)), strict=True)}
    signs = {}
    for r in out.itertuples():
        name = None if r.vec_id != r.vec_id else int(r.vec_id)
        assert r.deviation == deviation[name]
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        expected = white[name][r.component - 1]
        sign = signs.setdefault(r.component, np.sign(expected * r.whitened)) if abs(expected) > 1e-3 else signs.get(r.component)
        if sign is not None:
            assert abs(sign * r.whitened - expected) < 1e-6
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-8


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [], 1, "", ""), (2, None, 1, "", "")])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25, -1.0], 1, "", "")])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0)]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0], 1, "", "") for i in range(4)])).where("component = 2").collect()
    assert {r.whitened for r in flat} == {0.0} and flat[0].identity_error < 1e-12


def test_moments_merge_as_one():
    x = np.random.default_rng(1).normal(1e6, 1, (500, 5))
    n, mean, scatter = whitening.merged(whitening.moments(x[:3]), whitening.merged(whitening.moments(x[3:70]), whitening.moments(x[70:])))
    assert n == 500 and np.allclose(mean, x.mean(axis=0)) and np.allclose(scatter, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))


def test_deviation_beyond_a_long_is_null():
    fitted = whitening.Whitening(10**9, np.zeros(1), np.ones((1, 1)), np.array([0], object), 1)
    assert fitted.deviations(np.array([[3], [10]])) == [9 * 10**18, None]


def brute_ids(texts, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.public_path())
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


AWKWARD = [
    "Don't stop, THEY'LL say: it's 5:30... ok?! <|endoftext|>, <|ENDOFTEXT|>. a<|startoftext|>b", "é ́x ΑΣ ΣΑΣ.", "tab\tline\nfeed\x0b\x0c\r  end", " non breaking wide ", "''s 's' x's.", "İstanbul ǅ ß ﬁ", "日本語 テスト。", "1.5,2;3", "....", "A.B.C. a.b,", "!", '"',
    "<b>Bold</b>, <I>Y</I>", "\x1c\x1d\x85x", "a" * 3000,
]


def test_token_ids(spark, docs, rows, empty):  # noqa: F811
    extra = [(1000 + i, t, "en", "s", 1, 1, 0.0) for i, t in enumerate(AWKWARD)]
    everything = [*rows, *extra]
    out = token_ids.digests(docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(4)).toPandas()
    assert list(out.columns) == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(out) == len(everything)
    expected = Counter((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r, ids in zip(everything, brute_ids([r[1] for r in everything]), strict=True))
    name = [None if x != x else int(x) for x in out["doc_id"]]
    assert Counter(zip(name, out["n_tokens"], out["ids_crc32"], strict=True)) == expected
    ordered = sorted(zip(out["start"], out["n_tokens"], [-1 if x is None else x for x in name], strict=True))
    assert [s for s, _, _ in ordered] == list(np.concatenate([[0], np.cumsum([n for _, n, _ in ordered])[:-1]]))
    assert [x for _, _, x in ordered] == sorted(x for _, _, x in ordered)
    assert token_ids.digests(empty).count() == 0


def test_token_files_in_small_shards_and_by_random_access(spark, docs, rows, tmp_path):  # noqa: F811
    path = str(tmp_path / "ids")
    token_ids.write(docs, path, shard_ids=700, parts=3)
    stored = spark.read.parquet(path)
    assert stored.count() > 6 and stored.agg(F.sum(F.length("symbols")) / 4 < F.sum("n_ids")).first()[0]
    truth = dict(zip([r[0] for r in rows], brute_ids([r[1] for r in rows]), strict=True))
    assert {r.doc_id: r.ids for r in token_ids.read(spark, path).collect()} == truth
    for first, last in ((0, 5), (3, 40), (20, 21), (0, 10**6), (10**6, 10**7)):
        assert {r.doc_id: r.ids for r in token_ids.window(spark, path, 4, 45, first, last).collect()} == {d: ids[first:last] for d, ids in truth.items() if d is not None and 4 <= d <= 45}


def test_words_are_forgotten_when_they_are_many(monkeypatch):
    import pyarrow as pa

    with open(token_ids.public_path(), encoding="utf-8") as f:
        encoder = token_ids.Encoder(f.read())
    monkeypatch.setattr(token_ids, "WORDS", 20)
    texts = [f"Word{i} same, {i}! {'z' * i}." for i in range(60)] + AWKWARD
    got = []
    for i in range(0, len(texts), 7):
        ids, n = encoder.encode(pa.array(texts[i : i + 7]))
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [ids[:-1] for ids in brute_ids(texts)]


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string")
    token_ids.write(rows, str(tmp_path / "ids"), tokenizer=path, end=50256)
    got = {r.doc_id: r.ids for r in token_ids.read(spark, str(tmp_path / "ids")).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 50256] for i, x in enumerate(AWKWARD)}


def test_grammar_round_trips():
    rng = np.random.default_rng(2)
    for n, v in ((0, 5), (1, 5), (2, 1), (50, 1), (5000, 3), (20000, 300)):
        ids = rng.integers(0, v, n)
        sizes = np.array([*np.diff(np.sort(np.append(rng.integers(0, n + 1, 9), [0, n])))])
        g, symbols, held = grammar.compress(ids, sizes, 300, pairs=16, least=4)
        assert (g.expand(symbols) == ids).all() and held.sum() == len(symbols)
        assert (np.add.reduceat(np.append(g.sizes(symbols), 0), np.cumsum(held) - held)[held > 0] == sizes[held > 0]).all() if n else True
        assert len(symbols) < 0.7 * n or n < 50 or v == 300
        for a, b in ((0, 3), (n // 3, n // 2), (n, n + 5)):
            assert g.cut(symbols, min(a, n), min(b, n)).tolist() == ids[a:b].tolist()


def brute_audit(found, least):
    import re

    terms = [[t.translate({i: i + 32 for i in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")] for r in found]
    lang, source = [r[2] or "" for r in found], [r[3] or "" for r in found]
    out = set()
    for g in set(lang):
        texts = Counter(t for w, x in zip(lang, terms, strict=True) if w == g for t in set(x))
        kept = [t for t, n in texts.items() if n >= least]
        counts = {s: Counter(t for w, y, x in zip(lang, source, terms, strict=True) if w == g and y == s for t in x) for s in {y for w, y in zip(lang, source, strict=True) if w == g}}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:50]
            out |= {(g, s, part, item.decode(), -v, i + 1) for part, items in (("pair", pairs), ("term", over)) for i, (v, item) in enumerate(items)}
    return out


def test_divergence(spark, docs, rows, empty):  # noqa: F811
    extra = [(500 + i, t, None if i % 2 else "xx", None, 1, 1, 0.0) for i, t in enumerate(["ZÉRO Zéro a_b A1b", None, "", "xx yy"])]
    given = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for least in (1, 3, 30):
        out = divergence.audit(given, least=least, shard_terms=50)
        assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
        got = [tuple(r) for r in out.collect()]
        assert set(got) == brute_audit([*rows, *extra], least) and len(got) == len(set(got))
    assert divergence.audit(empty).count() == 0


def test_terms_in_pieces(monkeypatch):
    text = ("ab Cd,é " * 50 + "X" * 300 + " y" * 40 + " " + "z" * 100).encode()
    whole = [t for part in divergence.terms_of(text) for t in part]
    for size in (7, 64, 250):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [t for part in divergence.terms_of(text) for t in part] == whole
    assert len(whole) == 192
