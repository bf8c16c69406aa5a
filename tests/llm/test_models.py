"""Tokenizers against their libraries, extraction and quality against labels."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pytest

from barloom.llm import html_extract, pieces, quality, sp_bpe, token_count
from barloom.llm.queries import model_path
from tests.llm.conftest import AWKWARD, words


@pytest.fixture(scope="module")
def model():
    pytest.importorskip("public_tokenizers")
    return model_path()


def samples(rng, model):
    known = list(pieces.load(model).normal())
    out = [t or "" for t in AWKWARD] + ["<s> </s> <unk>", "<0x0A>", "aaaa" * 300, "  two  spaces  "]
    out += ["".join(rng.choice("aeinorst▁ thABzé😀\n\x00<0xA>ß") for _ in range(rng.randrange(60))) for _ in range(1500)]
    return out + ["".join(rng.choice(known) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]


def test_bpe_equals_the_library(rng, model):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=model), sp_bpe.BpeCodec(model)
    for t in samples(rng, model):
        ids = sp.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == sp.decode(ids), t


def test_backtracking_equals_merging(rng, model):
    own = sp_bpe.codec(model)
    for _ in range(500):
        t = "".join(rng.choice("aeinorsth▁") for _ in range(rng.randrange(1, 14)))
        assert own.segment(t) == own.merge(t)


def test_bpe_caches_stay_bounded(model, monkeypatch, rng):
    monkeypatch.setattr(sp_bpe, "CACHE", 10)
    monkeypatch.setattr(sp_bpe, "PAIRS", 10)
    own, fresh = sp_bpe.BpeCodec(model), sp_bpe.codec(model)
    for _ in range(50):
        t = words(rng, 20, 10_000)
        assert own.encode(t) == fresh.encode(t)
    assert len(own.cache) <= 10 and len(own.older) <= 10 and len(own.compatible) <= 10


def test_kept_runs_are_small(model):
    """Both generations, full, of runs of some ten letters take less than 60 MB of a worker."""
    own = sp_bpe.BpeCodec(model)
    text = " ".join(f"w{i}x{i * 7919 % 10007}" for i in range(20_000))
    want = own.digest(text)
    own.cache, own.older = {}, {}  # the pairs of pieces stay
    tracemalloc.start()
    assert own.digest(text) == want
    kept = tracemalloc.get_traced_memory()[0] / len(own.cache)
    tracemalloc.stop()
    assert 2 * sp_bpe.CACHE * kept < 60e6, kept


def test_bpe_operators(spark, awkward, empty, model):
    own = sp_bpe.codec(model)
    ids = sp_bpe.encode_texts(awkward.withColumnRenamed("kept", "ids"), model)
    back = sp_bpe.decode_ids(ids, model)
    for r in back.collect():
        assert r.ids == own.encode(r.text or "") and r.decoded == own.decode(r.ids)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in sp_bpe.digest_texts(awkward, model).collect()), key=str)
    want = [(r.doc_id, len(own.encode(r.text or "")), hashlib.sha256(",".join(map(str, own.encode(r.text or ""))).encode()).hexdigest()) for r in awkward.collect()]
    assert got == sorted(want, key=str)
    assert sp_bpe.digest_texts(empty, model).count() == 0


def test_unigram_counts_equal_the_library(rng, model):
    tokenizers = pytest.importorskip("tokenizers")
    v = pieces.load(model)
    # Control and byte pieces aren't text: under names that no text has.
    names = [p if k == pieces.NORMAL else f"{p}" if k == pieces.BYTE else f"\ue000{i}" for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True))]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(list(zip(names, v.scores, strict=True)), unk_id=0, byte_fallback=True))
    own = token_count.UnigramCounter(model)
    for t in samples(rng, model):
        if "<0x" in t:
            continue  # the library takes these for byte pieces
        assert own.count(t) == len(library.encode("▁" + t.replace(" ", "▁") if t else "").ids), t


def test_count_operator(spark, awkward, empty, model):
    own = token_count.counter(model)
    assert sorted(((r.doc_id, r.n_tokens) for r in token_count.count_tokens(awkward, model).collect()), key=str) == sorted(((r.doc_id, own.count(r.text or "")) for r in awkward.collect()), key=str)
    assert token_count.count_tokens(empty, model).count() == 0


def test_viterbi_brute_force(model):
    own = token_count.counter(model)
    scores = {p: pieces.load(model).scores[i] for p, i in pieces.load(model).normal().items()}

    def best(t):
        if not t:
            return 0.0
        return max((best(t[: len(t) - n]) + scores[t[-n:]] for n in range(1, len(t) + 1) if t[-n:] in scores), default=-np.inf)

    for t in ("▁hello", "▁thenti", "on", "▁tation"):
        assert own.viterbi(t)[0] == best(t)


def test_viterbi_ties():
    """Of equal scores the piece that starts earliest wins, against every segmentation of short texts."""
    import ahocorasick

    scores = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, "bb": -1.0, "aab": -3.0}
    own = token_count.UnigramCounter.__new__(token_count.UnigramCounter)
    own.single, own.unknown, own.automaton = {"a", "b"}, -13.0, ahocorasick.Automaton()
    for p, x in scores.items():
        own.automaton.add_word(p, (len(p), x))
    own.automaton.make_automaton()

    def best(t):
        """(score, count), the last piece as long as can be among equals."""
        if not t:
            return 0.0, 0
        found = [(best(t[:-n])[0] + scores[t[-n:]], n) for n in range(1, len(t) + 1) if t[-n:] in scores]
        if t[-1] not in "ab":
            found.append((best(t[:-1])[0] - 13.0, 1))
        top, n = max(found)
        return top, best(t[:-n])[1] + (1 if t[-1] in "ab" else len(t[-1].encode()))

    from itertools import product

    for k in range(1, 8):
        for t in map("".join, product("ab", repeat=k)):
            assert own.viterbi(t) == best(t), t
    assert own.viterbi("aéb") == best("aéb") == (-15.0, 4)


def test_very_long_page_and_clashing_columns(spark):
    body = [f"Sentence number {i} of a very long story." for i in range(20_000)]
    page = "<nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in body) + "</article><footer>&copy; us</footer>"
    r = html_extract.extract_text(spark.createDataFrame([(1, page, 7, "label", "x")], "page_id long, html string, n_chars int, hint string, features string")).first()
    assert r.text == "\n".join(body) and r.n_chars == len(r.text) and (r.hint, r.features) == ("label", "x")


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header class="site-header"><p>Brand</p></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B</h1><p>First  line<br>goes <b>on</b>&#33;
<p>Second paragraph.</p><div class="ad">Buy now.</div><blockquote><p>Quoted text here.</p></blockquote></article><aside class="sidebar"><h3>Related</h3><li><a href="/a">Other story</a></li></aside>
<section class="comments"><p>Nice post!</p></section><form><label>Mail</label><input><button>Go</button></form><footer>&copy; Brand</footer>"""


def test_page_by_hand():
    assert html_extract.extract(PAGE, html_extract.default_chain()) == "A & B\nFirst line goes on!\nSecond paragraph.\nQuoted text here."


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "template"])
def test_unclosed_tag_keeps_the_article(tag):
    assert [t for t, _ in html_extract.blocks(f"<div>Menu <{tag} class=x>More</div><article><p>Body text.</p></article>")][-1] == "Body text."
    assert [t for t, _ in html_extract.blocks(f"<p>Before <{tag}>inside</{tag}> after.</p>")] == ["Before after."]
    assert [t for t, _ in html_extract.blocks("<p>Where <math><mi>x</mi> = <mn>2</mn></math> holds.</p>")] == ["Where x = 2 holds."]


def test_extraction_accuracy_on_unseen_layouts():
    chain = html_extract.default_chain()
    right = total = 0
    for page, labels in html_extract.labelled_pages(150, seed=1234):
        found = html_extract.blocks(page)
        assert len(found) == len(labels)
        right += sum(a == b for a, b in zip(chain.viterbi([f for _, f in found]), labels, strict=True))
        total += len(labels)
    assert right / total > 0.99


def test_viterbi_is_the_best_labelling():
    from itertools import product

    chain = html_extract.default_chain()
    fs = [f for _, f in html_extract.blocks(PAGE)][:9]
    value = lambda y: sum(chain.emit[list(f), s].sum() for f, s in zip(fs, y, strict=True)) + sum(chain.move[a, b] for a, b in zip(y, y[1:], strict=False))
    assert tuple(chain.viterbi(fs)) == max(product((0, 1), repeat=len(fs)), key=value)


@pytest.mark.parametrize("page", ["", "<", "<p", "plain", "</p></div>", "<!-- open", "<script>x", "<p title='>'>t", "<a<b>c", "<p>" * 3000, "&#x0; &bogus; &lt;b&gt;", "<div " + "a=' " * 2000])
def test_broken_markup_is_tolerated(page):
    assert isinstance(html_extract.extract(page, html_extract.default_chain()), str)


def test_extraction_operator(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (None, "u", "", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract_text(df).collect()
    text = "A & B\nFirst line goes on!\nSecond paragraph.\nQuoted text here."
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "u", "", 0), (1, "u", text, len(text))], key=str)
    assert html_extract.extract_text(df.limit(0)).count() == 0


def labelled(spark, rng, n=400):
    good = lambda: words(rng, rng.randrange(10, 80))
    bad = lambda: " ".join(f"w{rng.randrange(50)}%%%" for _ in range(rng.randrange(10, 80)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int"), {r[0]: r[2] for r in rows}


def test_quality_on_the_held_out_fold(spark, rng):
    docs, labels, truth = labelled(spark, rng)
    got = [r for r in quality.classify(docs, labels, keep=["doc_id"]).collect()]
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if quality.crc32_fold(i) == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_quality_ignores_held_out_labels(spark, rng):
    docs, labels, truth = labelled(spark, rng, 200)
    wrong = labels.withColumn("quality", (1 - labels.quality) * quality.held_out(labels.doc_id).cast("int") + labels.quality * (1 - quality.held_out(labels.doc_id).cast("int")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.classify(docs, x).collect()) for x in (labels, wrong))
    assert a == b


def test_quality_of_awkward_rows(spark, rng, awkward, empty):
    docs, labels, _ = labelled(spark, rng, 100)
    assert quality.classify(awkward, labels).count() == awkward.count()
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    # Columns that are named like those of the classifier keep their values.
    own = docs.selectExpr("*", "doc_id * 1.5 as score", "doc_id as predicted", "'h' as held_out", "'s' as __score", "1L as positive", "2L as x")
    left = quality.drop_low_quality(own, labels)
    assert left.columns == own.columns
    kept = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in own.collect() if r.doc_id in kept} and 0 < len(kept) < 100


def test_quality_learns_without_negative_labels(spark, rng):
    docs, labels, _ = labelled(spark, rng, 200)
    a, b = (sorted((r.doc_id, r.score) for r in quality.classify(docs, x).collect()) for x in (labels, labels.where("quality = 1")))
    assert a == b


def test_repeated_ids_count_once_in_training(spark, rng):
    docs, labels, _ = labelled(spark, rng, 120)
    again = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1"))
    a, b = (dict((r.doc_id, r.score) for r in quality.classify(x, labels).collect()) for x in (docs, again))
    assert a == b


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_and_its_gradient(prior):
    """Against the formula in plain Python and finite differences, on both sides of zero."""
    r = np.random.default_rng(3)
    zp, zu = r.normal(0.5, 1, 6), r.normal(-0.5, 1, 9)
    loss = lambda z: np.log1p(np.exp(-z))

    def parts(zp, zu):
        return prior * sum(map(loss, zp)) / len(zp), sum(map(loss, -zu)) / len(zu) - prior * sum(map(loss, -zp)) / len(zp)

    first, rest, gp, gu = quality.risk_step(zp, zu, prior)
    assert np.allclose((first, rest), parts(zp, zu)) and (rest < 0) == (prior == 0.9)
    # Where the rest is negative the step goes up its slope, else down that of the whole.
    aim = lambda *z: -parts(*z)[1] if rest < 0 else sum(parts(*z))
    for i in range(len(zp)):
        e = np.eye(len(zp))[i] * 1e-6
        assert np.isclose(gp[i], (aim(zp + e, zu) - aim(zp - e, zu)) / 2e-6, atol=1e-7)
    for i in range(len(zu)):
        e = np.eye(len(zu))[i] * 1e-6
        assert np.isclose(gu[i], (aim(zp, zu + e) - aim(zp, zu - e)) / 2e-6, atol=1e-7)


@pytest.mark.parametrize("share", [0.4, 0.7, 0.9])
def test_prior_and_separation(share):
    r = np.random.default_rng(0)
    draw = lambda n, at: r.normal(at, 1, (n, 5))
    p, u = draw(1500, 1.5), np.concatenate([draw(int(2000 * share), 1.5), draw(2000 - int(2000 * share), -1.5)])
    prior = quality.estimate_prior(p, u)
    assert -0.08 < prior - share < 0.02  # a standard error low, so that the rest of the risk isn't forced below zero
    m = quality.train(p, u, prior)
    s = m.score(np.concatenate([draw(500, 1.5), draw(500, -1.5)]))
    assert (s[:500][:, None] > s[500:][None]).mean() > 0.999
    # With few negatives among the unlabelled rows their scores come less far down.
    assert ((s[:500] >= quality.THRESHOLD).mean() + (s[500:] < quality.THRESHOLD).mean()) / 2 > (0.97 if share < 0.9 else 0.94)


def test_quality_on_the_test_tables():
    """Labels of the held-out fold of a test table; the figure in README."""
    import os

    duckdb = pytest.importorskip("duckdb")
    here = "/root/testdata/sf0.1"
    if not os.path.isdir(here):
        pytest.skip("no test tables")
    rows = duckdb.sql(f"select doc_id, coalesce(text, ''), quality from '{here}/documents.parquet' left join '{here}/labels.parquet' using (doc_id) order by hash(doc_id), doc_id").fetchall()
    x = np.stack([quality.features(t.encode()) for _, t, _ in rows])
    held, label = np.array([quality.crc32_fold(i) == 0 for i, _, _ in rows]), np.array([-1 if q is None else q for _, _, q in rows])
    p, u = x[(label == 1) & ~held][:5000], x[~held][:5000]
    m = quality.train(p, u, quality.estimate_prior(p, u))
    use = held & (label >= 0)
    s, y = m.score(x[use].astype(float)), label[use]
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.99 and ((s >= quality.THRESHOLD) == y).mean() > 0.99
