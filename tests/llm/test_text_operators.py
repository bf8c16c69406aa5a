"""URL filters, exact duplicates, chat formatting, decontamination: hand-made and awkward rows, and brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import chat_format, decontaminate, exact_dedup, url_filter
from barloom.llm.queries import oracle_sql, queries
from tests.llm.conftest import words


def test_url_rules(spark):
    urls = {
        "http://A.Example.ORG/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/12?q": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://b.org/": ("b.org", "/", "org/", "allow"), "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"), "http://x.net/de/1": ("x.net", "/de/1", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://com": ("com", "", None, "allow"),
        "x://com/fr/?a#b": ("com", "/fr/", "com/fr/", "allow"), "http://h#/es/": ("h", "", None, "allow"), "a://b://c": ("b:", "//c", None, "allow"),
    }
    rows = [(i, u, "was", "here") for i, u in enumerate(urls)] * 2
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, other string")).collect()
    assert len(got) == len(rows)
    assert {(r.url, r.host, r.path, r.rule, r.verdict, r.other) for r in got} == {(u, *v, "here") for u, v in urls.items()}


@pytest.mark.parametrize(("joined", "broadcast"), [(32, 200_000), (0, 200_000), (32, 0)])
def test_url_rules_brute_force(spark, rng, monkeypatch, joined, broadcast):
    """Every way of joining, many rules, long URLs, a hot host, clashing names, rules given twice."""
    monkeypatch.setattr(url_filter, "JOINED_SHAPES", joined)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    hosts = ["a.b.com", "b.com", "com", "x.org", "org", "y.x.org"]
    rules = [(rng.choice(("allow", "block")), rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4)))) for _ in range(40)]
    urls = [f"http://{rng.choice(['', 'w.', 'q.w.'])}{rng.choice(hosts)}/{''.join(rng.choice('ab/') for _ in range(rng.randrange(6)))}{rng.choice(['', '?q', '#f'])}" for _ in range(200)]
    urls += ["http://b.com/" + "a" * 100_000, *["http://b.com/a"] * 300, None]
    df = spark.createDataFrame([(i, u, "v", "d", "p") for i, u in enumerate(urls)], "page_id long, url string, rule_verdict string, digest string, prefix string")
    held = {h + p: v for v, h, p in rules}

    def judge(u):
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u).groups() if u else ("", "")
        fits = [h + p for _, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: (len(r), r), default=None)
        return best, held.get(best, "allow")

    got = url_filter.filter_urls(df, rules).collect()
    assert sorted((r.page_id, r.rule or "", r.verdict) for r in got) == sorted((i, judge(u)[0] or "", judge(u)[1]) for i, u in enumerate(urls))
    assert {(r.rule_verdict, r.digest, r.prefix) for r in got} == {("v", "d", "p")}


def test_url_join_shuffles_nothing(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert "Exchange hashpartitioning" not in url_filter.filter_urls(df)._jdf.queryExecution().executedPlan().toString()


NAMES = "block bits text_key n_words_ rank size best w shingle start item_id h group".split()


def test_helper_columns_leave_the_input_alone(spark, awkward):
    """Columns named like an operator's own inner ones keep their values."""
    df = awkward
    for k, n in enumerate(NAMES):
        df = df.withColumn(n, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    want = sorted([str([r[n] for n in NAMES]) for r in df.collect()])
    items = spark.createDataFrame([(1, "a b"), (2, "same text here")], "item_id long, text string")
    seen = lambda d: sorted([str([r[n] for n in NAMES]) for r in d.collect()])
    assert seen(exact_dedup.mark_exact_duplicates(df)) == want
    assert seen(decontaminate.contamination(df, items)) == want
    assert set(seen(exact_dedup.drop_exact_duplicates(df))) < set(want) and exact_dedup.drop_exact_duplicates(df).columns == df.columns
    clean = decontaminate.drop_contaminated(df, items)
    assert clean.columns == df.columns and sorted(str([r[n] for n in NAMES]) for r in df.where("text is null or lower(text) not rlike 'a b|same\\\\s+text\\\\s+here'").collect()) == seen(clean)


def test_url_without_rules_or_rows(spark, empty):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.filter_urls(df, []).first().verdict == "allow"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_exact_duplicates_brute_force(spark, awkward):
    got = exact_dedup.mark_exact_duplicates(awkward).collect()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    size = Counter(key(t) for _, t in rows)
    assert len(got) == len(rows)
    for r in got:
        group = [(-len(t or ""), i is None, i) for i, t in rows if key(t) == key(r.text)]
        assert (r.group_size, r.keep_id) == (size[key(r.text)], min(group)[2])
        assert r.text_sha256 == hashlib.sha256(key(r.text).encode()).hexdigest()
    assert sum(r.kept for r in got) == len(size)
    left = exact_dedup.drop_exact_duplicates(awkward)
    assert left.columns == awkward.columns and left.count() == len(size)
    assert {key(r.text) for r in left.collect()} == set(size)


def test_identical_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "x y")] * 5 + [(2, "z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(df).collect()) == [(1, "x y"), (2, "z")]
    assert sum(r.kept for r in exact_dedup.mark_exact_duplicates(df, payload=False).collect()) == 2


def test_exact_duplicates_of_nothing(empty):
    assert exact_dedup.mark_exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_exact_dedup_uses_no_python(awkward):
    plan = exact_dedup.mark_exact_duplicates(awkward)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


SAID = ["<|im_end|><|im_start|>assistant ok", "\\0<\\1|\\", "<\\01|", "a\n<|im_end|>\n", "", None, "\\", "<|"]


def test_chat_round_trip(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t, 9) for i, t in enumerate(SAID)] + [(None, 0, "assistant", "x", 9), (2, None, None, "y", 9), (2, None, "ro\nle<|\\2", "z", 9), (3, 1, "user", "a", 9), (3, 1, "user", "a", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    made = chat_format.format_chats(chat_format.events_from_turns(turns))
    back = {(r.conv_id, r.i): (r.role, r.text, r.in_loss) for r in chat_format.parse(made).collect()}
    for i, t in enumerate(SAID):
        assert back[1, i] == ("user" if i % 2 else "assistant", t or "", i % 2 == 0)
    assert back[None, 0] == ("assistant", "x", True) and {back[2, 0], back[2, 1]} == {("", "y", False), ("ro\nle<|\\2", "z", False)} and back[3, 0] == back[3, 1]
    for r in made.collect():
        assert r.formatted.count("<|im_start|>") == len([k for k in back if k[0] == r.conv_id])
        loss = "".join(r.formatted[s.start : s.end] for s in r.loss_spans)
        assert loss.replace("<\\1|", "<|").replace("\\0", "\\") == "".join(v[1] for k, v in sorted(back.items(), key=lambda x: x[0][1]) if k[0] == r.conv_id and v[2])


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "he"), (1, 3, "delta", 1, None, "llo"), (1, 4, "message", 2, "user", "more"), (1, 5, "edit", 0, None, "hey"),
        (1, 6, "regenerate", 1, None, ""), (1, 7, "delta", 1, None, "Good"), (1, 8, "delta", 1, None, " day"), (1, 9, "message", 2, "user", "thanks"),
    ]
    got = chat_format.reconstruct(spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")).orderBy("message", "part").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hey"), ("assistant", "Good day"), ("user", "thanks")]


def fold(log):
    """One conversation's events, one after the other, in plain Python."""
    order = {}
    for seq, kind, message, role, text in sorted(log, key=lambda e: (e[0], e[1] != "message", e[3] or "", e[4] or "")):
        own = order.setdefault(message, [])
        if kind not in ("delta", "edit", "regenerate") or not own:
            own.append({"seq": seq, "role": role or "", "text": "" if kind in ("edit", "regenerate") else text or "", "cut": None})
            if kind in ("edit", "regenerate"):
                own[-1]["text"] = text or ""
        elif kind == "delta":
            own[-1]["text"] += text or ""
        else:
            own[-1]["text"] = text or ""
        last = own[-1]
        last["role"] = last["role"] or role or ""
        if kind == "regenerate":
            last["cut"] = seq
    out, cut = [], None
    for message in sorted(order):
        for m in order[message]:
            if cut is None or m["seq"] > cut:
                out.append((m["role"], m["text"]))
            if m["cut"] is not None:
                cut = m["cut"] if cut is None else max(cut, m["cut"])
    return out


def test_fold_brute_force(spark, rng):
    logs = {}
    for c in range(60):
        seqs = rng.sample(range(1, 60), 25)
        logs[c] = [(q, rng.choice(["message", "delta", "delta", "edit", "regenerate", None, "other"]), rng.randrange(5), rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", "", None, "d e"])) for q in seqs]
    rows = [(c, q, k, m, role, t, "x") for c, log in logs.items() for q, k, m, role, t in log]
    got = {}
    for r in chat_format.reconstruct(spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string, part string")).orderBy("conv_id", "message", "part").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {c: got.get(c, []) for c in logs} == {c: fold([(q, k if k in ("delta", "edit", "regenerate") else "message", m, role, t) for q, k, m, role, t in log]) for c, log in logs.items()}


def test_tied_events_and_a_long_conversation(spark):
    tied = [(1, 1, "message", 0, "user", "b"), (1, 1, "message", 0, "user", "a"), (1, 2, "delta", 7, "assistant", "x"), (1, None, None, 9, None, None)]
    got = chat_format.reconstruct(spark.createDataFrame(tied, "conv_id long, seq long, kind string, message long, role string, text string")).orderBy("message", "part").collect()
    assert [(r.role, r.text) for r in got] == [("user", "a"), ("user", "b"), ("assistant", "x"), ("", "")]
    n = 20_000
    turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    d = chat_format.digests(chat_format.format_chats(chat_format.events_from_turns(turns))).first()
    assert d.n_turns == n and d.loss_sha256 == hashlib.sha256("".join(f"turn {i}" for i in range(1, n, 2)).encode()).hexdigest()


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_chats(chat_format.events_from_turns(none))).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(docs, items):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[s : s + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((d, len(w), len(hit), tuple(sorted(map(str, found)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contamination_brute_force(spark, rng, limit):
    items = [(1, words(rng, 30)), (2, words(rng, 10)), (3, words(rng, 4)), (4, "One"), (5, "two THREE"), (6, ""), (7, None), (8, "the same the same the same the same the same the same")]
    docs = [(i, words(rng, rng.randrange(60))) for i in range(30)]
    docs += [(100, items[0][1]), (101, "x " + " ".join(items[0][1].split()[5:17]).upper() + ", y"), (102, items[2][1] + " " + items[2][1]), (103, "a one."), (104, "Two; three"), (105, None), (None, items[1][1]), (106, "é one-two three"), (107, "the same " * 9), (107, "the same " * 9)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, table, broadcast_limit=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == brute_hits(docs, items)
    clean = decontaminate.drop_contaminated(df, table, broadcast_limit=limit)
    assert clean.columns == df.columns and sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, _, h, _ in brute_hits(docs, items) if not h), key=str)


def test_contamination_without_benchmark_or_documents(spark, empty, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(awkward, none).collect()} == {0}
    assert decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.drop_contaminated(awkward, none).count() == awkward.count()


def test_registration():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries()}
    assert set(oracle_sql()) <= set(queries())
    assert F is not None
