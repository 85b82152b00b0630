"""URL filters, quality rules, chat, mixing: worked and odd cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.llm import chat, mixing, quality_rules, url_filters

RULES = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("b.example.net", "/", "block"), ("org", "/fr/", "allow"), ("", "/", "block"), ("x.org", None, "block")]


def judge(url, rules=RULES, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + (p or "")), h.lower(), p or "", v) for h, p, v in rules if h and host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    best = max(fits, key=lambda r: (r[0], len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[3] if best else default


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["net", "a.net", "example.net", "A.Example.NET", "b.example.net", "q.b.example.net", "xexample.net", "org", "w.org", "x.org", "com", "example.net:80", "net-x", ""]
    tails = ["", "/", "/en/", "/en", "/fr/x?y=/en/", "?q", "#f", "/en/p#q"]
    urls = [f"{s}://{h}{t}" for s in ("http", "x") for h in hosts for t in tails] + [None, "", "no scheme", "a://b://c/en/", "http:/x"]
    urls += ["http://hot.net/en/"] * 300
    rng.shuffle(urls)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    rules = spark.createDataFrame(RULES, url_filters.RULE_SCHEMA)
    for cuts in (1, 5, 40, None):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df, rules, cuts=cuts).collect()}
        assert got == {i: judge(u) for i, u in enumerate(urls)}


def test_urls_empty_tables(spark):
    rules = spark.createDataFrame(RULES, url_filters.RULE_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.net/"), (None, None), (1, "http://a.net/")], "page_id long, url string")
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filters.filter_urls(pages, rules.limit(0), default="block").collect()] == ["block"] * 3


def test_urls_that_are_very_long_and_ids_of_any_type(spark):
    host, path = ".".join(["a"] * 20_000) + ".example.net", "/en/" + "x" * 1_000_000
    urls = {"p": f"http://{host}{path}", "q": "http://example.net" + path, "r": "x" * 1_000_000, "s": "http://" + "b" * 500_000 + ".org/fr/"}
    df = spark.createDataFrame(list(urls.items()), "page_id string, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df, spark.createDataFrame(RULES, url_filters.RULE_SCHEMA)).collect()}
    assert got == {i: judge(u) for i, u in urls.items()}


def rule_counts(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in seen for k in range(5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(covered)


def test_quality_rules_counts(spark, odd_docs, no_docs):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("a b c é.".split(), k=rng.randint(0, 60))) for _ in range(60)] + ["x | y # z\nx | y # z\n\nsame.\nsame.", "𝒳 y" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.judge_documents(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == rule_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    odd = quality_rules.judge_documents(odd_docs, with_text=True)
    assert odd.count() == odd_docs.count() and quality_rules.judge_documents(no_docs).count() == 0
    assert {r.n_words for r in odd.where("doc_id IN (2, 3, 4)").collect()} == {0}


def test_quality_rules_lines(spark):
    prose = "This line is prose, and it has an end to it.\n" * 1
    menu = "Home | News | Sport | Weather | More\n"
    text = prose + "Another line of prose stands here to make ten words.\n" + menu + "no marks in this one"
    rows = spark.createDataFrame([(1, text), (2, menu * 3 + "Ten words of prose would stand here if there were any.")], "doc_id long, text string")
    first, second = quality_rules.judge_documents(rows, with_text=True).orderBy("doc_id").collect()
    assert first.kept and first.n_failed_lines == 2 and "Home" not in first.clean_text and first.clean_text.startswith("This line")
    assert not second.kept


def test_quality_rules_very_long_lines(spark):
    """Lines of 10^6 separators or symbols, 10^6 words, and 10 MB without a gap."""
    texts = ["a | " * 1_000_000, "#>" * 500_000, "> " * 1_000_000 + "end.", "word " * 1_000_000 + "end.", "x" * 10_000_000, "l.\n" * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in quality_rules.judge_documents(df).collect()}
    assert [got[i].n_words for i in range(6)] == [len(t.split()) for t in texts]
    assert [got[i].n_symbols for i in range(6)] == [sum(t.count(c) for c in "#*$%&|<>") for t in texts]
    assert [got[i].n_failed_lines for i in range(6)] == [1, 1, 1, 0, 1, 0] and got[5].n_dup_lines == 299_999


hostile = st.text(alphabet="<|\\im_startend>\n aé", max_size=40)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd role\n<|", "", None]), hostile), min_size=1, max_size=30))
def test_chat_round_trip(spark, turns):
    rows = spark.createDataFrame([(7, i, role, text) for i, (role, text) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    blocks = chat.render(chat.fold(chat.events_of(rows, delta_chars=3)), block_turns=4)
    read = chat.parse(blocks).orderBy("block").collect()
    assert [(t.role, t.text) for b in read for t in b.turns] == [(role or "", text) for role, text in turns]
    assert "".join(b.loss_text for b in read) == "".join(text for role, text in turns if role == "assistant")
    assert sum(b.formatted_chars for b in read) == sum(len(r.formatted) for r in blocks.collect())


def test_chat_fold(spark):
    log = [
        (1, 0, 1, "start", "user", None), (1, 0, 2, "delta", None, "Hel"), (1, 0, 3, "delta", None, "lo"),
        (1, 1, 1, "start", "assistant", None), (1, 1, 2, "delta", None, "bad"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "good"),
        (1, 2, 1, "start", "user", None), (1, 2, 2, "delta", None, "x"), (1, 2, 3, "edit", None, "new"), (1, 2, 4, "delta", None, "er"),
        (None, None, 1, "delta", None, None),
    ]
    events = spark.createDataFrame([(c, t, 1, s, k, r, x) for c, t, s, k, r, x in log], "conv_id long, turn long, nth int, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "newer"), (None, None): ("", "")}


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b" * 3000)], "conv_id long, turn long, role string, text string")
    for name in ("seq", "kind", "nth", "block", "spans"):
        rows = rows.withColumn(name, F.lit(0))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.render(chat.fold(chat.events_of(rows)))).collect()}
    assert got == {None: (1, 0), 1: (3, 3000)}
    assert chat.digests(chat.render(chat.fold(chat.events_of(rows.limit(0))))).count() == 0


def shares(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    """Targets by sharing again and again what is over the cap."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = {}, budget * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = {s: w[s] * rest / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "b", "c", "d", None] + ["big"] * 6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = mixing.curriculum(df)
    first = copies.where("copy = 0").select("doc_id", "size", "source_size", "target", "taken").collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = shares(sizes)
    taken = {}
    for r in first:
        source = rows[r.doc_id][2]
        taken[source] = taken.get(source, 0) + r.taken
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source]
    assert len(first) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.curriculum(df.repartition(13)).where("copy = 0").select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))
    places = [r.position for r in copies.where("position IS NOT NULL").select("position").collect()]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    whole = mixing.curriculum(df, whole=True, keep=("text",)).where("words > 0").collect()
    assert all(r.words == r.size and len(r.text.split()) == r.words for r in whole)


def test_mixing_odd_rows(odd_docs, no_docs):
    got = mixing.curriculum(odd_docs).where("copy = 0")
    assert got.count() == odd_docs.count() and got.where("size = 0 AND taken <> 0").count() == 0
    assert mixing.curriculum(no_docs).count() == 0


def test_chat_deltas_of_very_long_texts(spark):
    """Deltas put together are the text, cut at code points; four million characters are no trouble."""
    texts = ["", "\U0001f600" * 5, "abc\n\r\n" * 3, "x" * 1024, "é\n" * 1025]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)] + [(1, 9, "user", None)], "conv_id long, turn long, role string, text string")
    for size in (1, 3, 1024):
        events = chat.events_of(df, size).where("kind = 'delta'")
        assert events.agg(F.max(F.length("text"))).first()[0] == min(size, 2050)
        got = {r.turn: r.text for r in chat.fold(chat.events_of(df, size)).collect()}
        assert got == {**dict(enumerate(texts)), 9: ""}
    long = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("ab<|cé\n"), 600_000).alias("text"))
    assert chat.digests(chat.render(chat.fold(chat.events_of(long)))).first().loss_chars == 4_200_000
