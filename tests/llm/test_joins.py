"""Near duplicates and repeated strings against brute force; components; the pipeline."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from barloom import session
from barloom.llm import ngram_join, suffix_dedup
from barloom.llm.components import connected_components
from tests.llm.conftest import AWKWARD, words


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([[f"e{r.randrange(10**6)}"], [], [w[k], f"e{r.randrange(10**6)}"]])
    return " ".join(w)


def test_near_duplicates_brute_force(spark, rng):
    rows = []
    for size in (3, 9, 11, 12, 13, 20, 33, 62, 66, 70, 99, 146, 300, 700):
        for _ in range(3):
            base = words(rng, size, 10**6)
            rows += [base, base.upper()] + [edited(rng, base, e) for e in (1, 1, 2, max(1, size // 60), max(1, size // 40), max(2, size // 30), max(2, size // 20), size // 3)]
    passage = words(rng, 120, 10**6)
    rows += [passage + " " + words(rng, rng.randrange(5, 60), 10**6) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(rows)] + [(2000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, rows[0]), (5, rows[5])]
    df = spark.createDataFrame([(*x, "a") for x in rows], "doc_id long, text string, component_id string")
    got = ngram_join.link_documents(df).collect()
    want = brute_components(rows)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
    left = ngram_join.drop_near_duplicates(df)
    kept = left.collect()
    groups = {c for (_, n, c) in want if n} | {d for d, n, _ in want if not n}
    assert left.columns == df.columns and len(kept) == len(groups)


def test_every_link_shares_a_key():
    r = random.Random(4)
    for n in [9, 10, 11, 19, 57, 58, 60, 63, 64, 65, 90, 97, 98, 145, 146, 220, 1000]:
        for _ in range(40):
            draw = lambda k: [r.getrandbits(64) for _ in range(k)]
            a = np.array(sorted(draw(n)), np.uint64)
            most = 2 * n // 19
            gone, new = r.randrange(most + 1), 0
            while (n - gone) * 100 >= 90 * (n + new + 1) and r.random() < 0.9:
                new += 1
            if (n - gone) * 100 < 90 * (n + new):
                continue
            b = np.array(sorted(r.sample(a.tolist(), n - gone) + draw(new)), np.uint64)
            assert ngram_join.links(a, b)
            assert set(ngram_join.keys_of(a).tolist()) & set(ngram_join.keys_of(b).tolist())


def test_sparse_groups_still_meet():
    """Sets whose hashes crowd together leave groups empty and are keyed by prefix too."""
    a = np.array(sorted(random.Random(1).sample(range(1 << 50), 200)), np.uint64)
    b = np.concatenate([a[5:], np.array([1 << 51, 1 << 52], np.uint64)])
    assert ngram_join.links(a, b) and set(ngram_join.keys_of(a).tolist()) & set(ngram_join.keys_of(b).tolist())


def test_tree_search_misses_no_link():
    r = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        base = np.unique(r.integers(0, 1 << 63, r.integers(30, 400)).astype(np.uint64))
        sets.append(base)
        for e in (1, 3, 8, 20, 60):
            sets.append(np.unique(np.concatenate([base[e // 2 :], r.integers(0, 1 << 63, e).astype(np.uint64)])))
    classes = [bytes([i // 256, i % 256]) for i in range(len(sets))]
    found = ngram_join.search_block(classes, sets, list(classes), list(range(len(sets))), list(range(len(sets))))
    root = {c: c for c in classes}

    def top(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in found:
        root[top(a)] = top(b)
    for i in range(len(sets)):
        for j in range(i):
            if ngram_join.links(sets[i], sets[j]):
                assert top(classes[i]) == top(classes[j])
            for q, p in ((i, j), (j, i)):
                assert ngram_join.links(sets[q], sets[p]) == ngram_join.links(sets[p], sets[q])


def five_word_components(rows, width=5, percent=80):
    """As ``brute_components``, for shingles of ``width`` words and a similarity of ``percent``."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("paired", [64, 2])
def test_near_duplicates_of_five_words_brute_force(spark, rng, monkeypatch, paired):
    """The pipeline's rule: copies between its threshold and op9's, such as one with a fifth appended, are linked too."""
    rule = pytest.importorskip("corpus_pipeline").NEAR
    assert (rule.width, rule.percent) == (5, 80)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "ORDER_TEXTS", 200)
    texts = []
    for size in (4, 5, 8, 9, 13, 20, 33, 62, 70, 99, 146, 300, 700):
        for _ in range(3):
            base = words(rng, size, 10**6)
            texts += [base, base.upper(), base + " " + words(rng, size // 5, 10**6), base + " " + words(rng, size // 3, 10**6), " ".join(base.split()[size // 6 :])]
            texts += [edited(rng, base, e) for e in (1, 2, max(1, size // 100), max(1, size // 60), max(2, size // 50), max(2, size // 40), max(2, size // 20))]
    passage = words(rng, 120, 10**6)
    texts += [passage + " " + words(rng, rng.randrange(5, 60), 10**6) for _ in range(90)]
    rows = list(enumerate(texts + AWKWARD))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = five_word_components(rows)
    got = ngram_join.link_documents(df, rule=rule).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == want
    base = words(rng, 150, 10**6)
    near = spark.createDataFrame([(1, base), (2, base + " " + words(rng, 27, 10**6)), (3, base + " " + words(rng, 90, 10**6))], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(corpus_stages())["n-gram Jaccard join"](spark, near, "").collect()) == [1, 3]


def test_prefixes_are_of_exact_counts(spark, rng):
    """A shingle of one set is no key, and the others are counted over all documents: those that a sample misses too."""
    rule = ngram_join.Rule(5, 80)
    base = [words(rng, 60, 10**6) for _ in range(30)]
    often = words(rng, 12, 10**6)
    texts = [b + " " + often for b in base] + [edited(rng, base[0], 1) + " " + often, base[1].upper() + " " + often, "a b", None] + [words(rng, 40, 10**6) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = {}
    for t in texts:
        h = ngram_join.shingle_set((t or "").encode(), rule)
        if len(h) >= rule.least:
            sets[ngram_join.class_of(h)] = h
    hashes, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    number = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    want = []
    for name, h in sets.items():
        first = sorted(h.view(np.int64).tolist(), key=lambda x: (number[x % 2**64], x))[: rule.prefix(len(h))]
        want += [(name, len(h), x) for x in first if number[x % 2**64] > 1]
    rows = ngram_join.describe(df, "doc_id", "text", rule)
    got = [(bytes(r["class"]), r.n, r.key) for r in ngram_join._prefixes(df, "text", rows, rule).collect()]
    assert sorted(got) == sorted(want) and len({name for name, _, _ in got}) == 2


def corpus_stages():
    return pytest.importorskip("corpus_pipeline").STAGES


@pytest.mark.parametrize("percent", [80, 70, 95])
def test_every_link_shares_a_key_at_any_similarity(percent):
    rule, r = ngram_join.Rule(5, percent), random.Random(percent)
    for n in [rule.least, rule.least + 1, 11, 20, 51, 57, 63, 64, 80, 97, 120, 220, 1000]:
        for _ in range(30):
            draw = lambda k: [r.getrandbits(64) for _ in range(k)]
            a = np.array(sorted(draw(n)), np.uint64)
            gone, new = r.randrange(2 * n * rule.apart // rule.total + 1), 0
            while (n - gone) * 100 >= percent * (n + new + 1) and r.random() < 0.95:
                new += 1
            if (n - gone) * 100 < percent * (n + new):
                continue
            b = np.array(sorted(r.sample(a.tolist(), n - gone) + draw(new)), np.uint64)
            assert ngram_join.links(a, b, rule)
            assert (gone == new == 0) or set(ngram_join.keys_of(a, rule).tolist()) & set(ngram_join.keys_of(b, rule).tolist())
            often = np.array(sorted(r.sample(a.tolist(), n // 2)), np.uint64)
            p, q = (set(ngram_join.prefix_of(x, (often, np.ones(len(often), np.int8)), rule).tolist()) for x in (a, b))
            both = -(-percent * (len(a) + len(b)) // rule.total)
            assert (gone == new == 0) or len(p & q) >= max(1, min(rule.prefix(len(x)) - (len(x) - both) for x in (a, b)))


@pytest.mark.parametrize("paired", [64, 1])
def test_near_duplicates_of_five_words_leave_no_sets(spark, rng, monkeypatch, tmp_path, paired):
    """Tables as large as shingles or sets are gone when the links are known; the rows and the components are left."""
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(session, "checkpoint_root", lambda spark: f"file://{tmp_path}")
    base = words(rng, 200, 10**6)
    df = spark.createDataFrame([(i, f"{base} {words(rng, i, 10**6)}") for i in range(1, 6)] + [(9, words(rng, 50, 10**6))], "doc_id long, text string")
    linked = ngram_join.link_documents(df, rule=ngram_join.Rule(5, 80))
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "barloom").iterdir()}
    assert "rows" in left and not left & {"shared", "prefixes", "met", "pairs", "chains", "under-large", "sets"}
    assert sorted((r.id, r.component_id) for r in linked.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (9, 9)]


def test_near_duplicates_of_nothing(spark, empty):
    assert ngram_join.link_documents(empty).count() == 0 and ngram_join.drop_near_duplicates(empty).count() == 0
    few = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "A"), (4, "A")], "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_join.link_documents(few).collect()) == [1, 2, 3, 3, 3]
    assert ngram_join.drop_near_duplicates(few).count() == 3


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_cut(texts, length):
    seen = {}
    for d in texts:
        for s in range(len(d) - length + 1):
            seen[d[s : s + length]] = seen.get(d[s : s + length], 0) + 1
    out = []
    for d in texts:
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), len(d) - len(kept), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("strip", "limit"), [(12, 48_000_000), (1, 48_000_000), (12, -1), (200, -1)])
def test_repeated_strings_brute_force(spark, rng, monkeypatch, strip, limit):
    monkeypatch.setattr(suffix_dedup, "STRIP", strip)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 10)
    monkeypatch.setattr(suffix_dedup, "_PLACE", np.uint64((1 << 11) - 1))
    passages = [words(rng, n, 10**6) for n in (30, 40, 90)]
    texts = [words(rng, rng.randrange(200), 10**6) for _ in range(12)]
    texts += [words(rng, rng.randrange(40), 10**6) + p + words(rng, rng.randrange(40), 10**6) for p in passages for _ in range(6)]
    texts += [edited(rng, texts[3] + " x", 3), texts[4], texts[4], "ab" * 300, "é" * 150, "x" * 199, "y" * 200, "z" * 201, passages[2] * 2, None, "", "x" * 199]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, texts[5], "a"), (4, texts[4], "a")]
    got = suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string, n_spans string"), keep_text=True).collect()
    want = brute_cut([(t or "").encode() for _, t, _ in rows], 200)
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *w) for (i, _, _), w in zip(rows, want, strict=True))
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_a_hot_passage_with_many_surroundings(spark, rng):
    """One passage in most texts, cut at any byte at both ends, beside copies of the whole."""
    passage = words(rng, 60, 10**6)
    texts = []
    for i in range(400):
        a, b = rng.randrange(120), rng.randrange(len(passage) - 120, len(passage))
        texts.append(words(rng, rng.randrange(20), 10**6) + passage[a:b] + words(rng, rng.randrange(20), 10**6))
        if i % 10 == 0:
            texts.append(texts[-1])
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_cut([t.encode() for t in texts], 200)))


def test_repeated_strings_of_nothing(empty):
    assert suffix_dedup.cut(empty).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path, rng):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = words(rng, 14, 10**6)
    base = words(rng, 150, 10**6)
    good = [words(rng, rng.randrange(30, 120), 10**6) for _ in range(150)]
    junk = [" ".join(f"w{rng.randrange(50)}%%%" for _ in range(60)) for _ in range(40)]
    texts = good + junk + [base, edited(rng, base, 1), good[0].replace(" ", "  "), words(rng, 20, 10**6) + " " + item, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(190)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, counts = docs, []
    for _, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        counts.append({r.doc_id for r in left.collect()})
    assert not counts[0] & set(range(150, 190)) and len(counts[0] & set(range(150))) >= 148
    assert counts[0] - counts[1] <= {0, 192, 194, 195} and len(counts[0] & {0, 192}) - len(counts[1] & {0, 192}) == 1
    assert counts[1] - counts[2] == {191} & counts[1] and counts[2] - counts[3] == {193} & counts[2]
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == counts[3]
