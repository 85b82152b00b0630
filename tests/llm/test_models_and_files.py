"""WARC, token files, language, quality, decontamination, pipeline."""

import hashlib
import random
import zlib
from base64 import b32encode

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cadence.llm import decontaminate, language_id, quality_model, token_files, warc
from cadence.llm.common import crc_mod
from cadence.session import work_path

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def digest(html):
    return b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}\r\nno: header", "é<p>" * rng.choice([0, 1, 3, 400, 2000, 5000]) + str(i % 11)) for i in range(60)]
    rows += [(60, None, None), (61, "u", ""), (None, "u", "same"), (62, "u", "same"), (63, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("last", F.lit(2))
    paths = warc.write_warc(df, work_path(spark, "warc"))
    got = {r.page_id: r for r in warc.read_warc(spark, paths, with_payload=True).collect()}
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    for i, _, html in rows:
        r, first = got[i], last[html or ""]
        assert r.complete and r.payload_bytes == len((html or "").encode()) and r.payload_digest == digest(html)
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == (html or "").encode()
    assert len(got) == len(rows)


def test_warc_missing_segment(spark):
    from cadence.llm.common import Published

    parts = list(warc.page_records(1, "u", b"x" * 10_000, digest("x" * 10_000), None, "0", "2024-01-01T00:00:00Z", 4096, 2048))
    path = work_path(spark, "broken") + "/a.warc.gz"
    out = Published(path)
    out.write(b"".join(parts[:1] + parts[2:]))
    out.close()
    assert not warc.read_warc(spark, [path]).first().complete
    assert warc.read_warc(spark, []).count() == 0


def archive_of(spark, *members):
    from cadence.llm.common import Published

    path = work_path(spark, "broken") + "/a.warc.gz"
    out = Published(path)
    out.write(b"".join(members))
    out.close()
    return path


def test_warc_broken_records(spark):
    """Whole records stay whole beside a missing length, a chunk cut short, a size that is no number, and a cut archive."""
    import gzip

    payload = b"x" * 3000
    whole = list(warc.page_records(1, "u", payload, digest("x" * 3000), None, "0", "2024-01-01T00:00:00Z", 1 << 20, 2048))[0]
    plain = gzip.decompress(whole)
    named = lambda n, data: gzip.compress(data.replace(b"x-page:1#", b"x-page:%d#" % n))
    no_length = plain.replace(b"\r\nContent-Length: ", b"\r\nX-Length: ", 1)
    short = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x-page:3#0>")], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"800\r\nxyz\r\n0\r\n\r\n")
    no_number = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x-page:4#0>")], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"zz\r\nxyz\r\n0\r\n\r\n")
    path = archive_of(spark, named(2, no_length), short, no_number, whole, named(5, plain)[:-60])
    got = {r.page_id: (r.complete, r.payload_bytes) for r in warc.read_warc(spark, [path]).collect()}
    assert got == {1: (True, 3000), 2: (False, None), 3: (False, None), 4: (False, None), 5: (False, None)}


def test_warc_very_long_payloads_and_clashing_names(spark):
    rows = [(1, "u", "é" * 6_000_000), (2, None, "é" * 6_000_000), (3, "u", "z" * 5_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("sha1", F.lit("x")).withColumn("n", F.lit(1))
    got = {r.page_id: (r.record_type, r.payload_bytes, r.complete) for r in warc.read_warc(spark, warc.write_warc(df, work_path(spark, "long"))).collect()}
    assert got == {1: ("revisit", 12_000_000, True), 2: ("response", 12_000_000, True), 3: ("response", 5_000_000, True)}


def test_warc_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a")], "page_id long, url string, html string")
    assert warc.write_warc(df.limit(0), work_path(spark, "none")) == []
    got = warc.read_warc(spark, warc.write_warc(df, work_path(spark, "twice"))).collect()
    assert [r.record_type for r in got] == ["response"] * 2


def test_token_files(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200).select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(9999, "it's <|endoftext|>x<|startoftext|> ΣΑΣ e\u0301 12ab\x1cq")], "doc_id long, text string"))
    folder = work_path(spark, "tokens")
    manifest = token_files.write_tokens(docs, folder, TOKENIZER)
    got = token_files.read_tokens(spark, folder, with_ids=True).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    encode = Tokenizer.from_file(TOKENIZER).encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    start = 0
    for r, (row, e) in zip(sorted(got, key=lambda r: r.start), zip(rows, encode, strict=True), strict=True):
        ids = [*e.ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (row.doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert manifest["tokens"] == start
    token_files.write_tokens(no_docs, work_path(spark, "empty"), TOKENIZER)
    empty = work_path(spark, "empty")
    assert token_files.write_tokens(no_docs, empty, TOKENIZER)["tokens"] == 0 and token_files.read_tokens(spark, empty).count() == 0


def test_token_files_with_tokenizers_that_keep_white_space(spark):
    from tokenizers import Tokenizer

    texts = ["a a b", "  two  spaces\n\nlines ", "", "it's <|endoftext|> x", "word " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = work_path(spark, "tokens")
    token_files.write_tokens(docs, folder, path)
    own = Tokenizer.from_file(path)
    got = {r.doc_id: list(r.ids) for r in token_files.read_tokens(spark, folder, with_ids=True).collect()}
    assert got == {i: [*own.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert token_files.PieceEncoder(TOKENIZER).by_piece and not token_files.PieceEncoder(path).by_piece


def test_white_space_rules():
    base = {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}}
    assert token_files.drops_white_space(base)
    split = {"type": "Split", "pattern": {"Regex": r" ?\w+|\s+"}, "behavior": "Removed", "invert": True}
    for other in ({"normalizer": {"type": "Prepend", "prepend": "_"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Metaspace"}}, {"pre_tokenizer": split},
                  {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}):
        assert not token_files.drops_white_space(base | other)


def test_ranges_of_unmapped_files(tmp_path):
    from pyarrow import fs

    from cadence.llm.common import _Ranges

    np.arange(100, dtype="<i8").tofile(tmp_path / "f")
    part = _Ranges(fs.LocalFileSystem(), str(tmp_path / "f"), "<i8")
    assert len(part) == 100 and part[3:7].tolist() == [3, 4, 5, 6] and part[5:5].tolist() == []


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    held = docs.where(crc_mod(F.col("doc_id"), 5) == 0)
    got = held.select("doc_id", "lang").join(language_id.predict(held, model), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    english, german = (docs.where(F.col("lang") == x).orderBy("doc_id").first().text[:400] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, english + "\n" + german)], "doc_id long, text string")
    spans = language_id.predict(mixed, model, with_spans=True).first().spans
    assert [s.lang for s in spans[:2]] == ["en", "de"] and abs(spans[1].start - 401) < 40


def test_language_viterbi():
    scores = np.random.default_rng(2).normal(size=(30, 3)).astype("f4")
    labeller = language_id.Labeller(language_id.Model(["a", "b", "c"], np.zeros((1, 3), "f4"), np.ones((13, 3), bool)), 1.5)
    labeller.scores = np.vstack([np.zeros((1, 3), "f4"), scores])
    labeller.place = {str(i): i + 1 for i in range(30)}
    rng = random.Random(1)
    texts = [[str(rng.randrange(30)) for _ in range(n)] for n in (1, 4, 6, 0)]

    def value(text, path):
        return sum(scores[int(w), k] for w, k in zip(text, path, strict=True)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    from itertools import product

    for text, path in zip(texts, labeller.paths(texts), strict=True):
        best = max((value(text, p) for p in product(range(3), repeat=len(text))), default=0)
        assert value(text, path.tolist()) == pytest.approx(best, abs=1e-4)


def test_language_numbers_over_255():
    k = 300
    labeller = language_id.Labeller(language_id.Model([f"l{i:03d}" for i in range(k)], np.zeros((1, k), "f4"), np.ones((13, k), bool)), 1.0)
    labeller.scores = np.vstack([np.zeros((1, k), "f4"), np.eye(k, dtype="f4")[[299, 7]] * 9])
    labeller.place = {"x": 1, "y": 2}
    assert labeller.paths([["x", "x", "y"]])[0].tolist() == [299, 299, 7]


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    got = language_id.predict(odd_docs, model)
    assert got.count() == odd_docs.count() and {r.lang_pred for r in got.where("doc_id IN (2, 3, 4)").collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd_docs, language_id.fit(no_docs)).collect()} == {"und"}
    other = spark.createDataFrame([(1, "日本語の文章"), (2, "12 _ ²")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(other, model).orderBy("doc_id").collect()] == [model.languages[0], "und"]


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    held = labels.where(crc_mod(F.col("doc_id"), 3) == 1).select("doc_id", "quality").join(quality_model.score(docs, model), "doc_id")
    assert held.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality_model.fit(odd_docs, labels)
    got = quality_model.score(odd_docs, model, keep=("id", "text"))
    assert got.count() == odd_docs.count() and got.where("score < 0 OR score > 1").count() == 0 and "text" in got.columns
    assert quality_model.score(no_docs, model).count() == 0
    none = quality_model.fit(no_docs, labels.limit(0))
    assert {r.score for r in quality_model.score(odd_docs, none).collect()} == {0.5}


def test_trees_walk_like_rules():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality_model.grow(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def plain_statistics(text):
    """FEATURES one by one, by counting."""
    data = (text or "").encode()
    words = [w for w in data.split() if w]
    if not words:
        return [0.0] * len(quality_model.FEATURES)
    share = lambda chars: sum(bytes([b]) in chars for b in data) / len(data)
    one = lambda chars: share({c.encode() for c in chars})
    lines = [x for x in data.split(b"\n") if x.split()]
    return [
        np.log(1 + len(data)), np.log(1 + len(words)), np.log(1 + len(lines)), sum(len(w) for w in words) / len(words),
        one("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), one("abcdefghijklmnopqrstuvwxyz"), one("0123456789"), one(" \t"), one("\n"), share({bytes([b]) for b in range(128, 256)}),
        one(","), one("."), one("!"), one("?"), one(":;"), one("|"), one("#*$%&<>@^~=+_\\"), one("()[]{}"), one("\"'"),
        len(set(words)) / len(words), len(set(lines)) / len(lines), max(words.count(w) for w in words) / len(words),
        sum(65 <= w[0] <= 90 for w in words) / len(words), len(words) / len(lines), len({(a, b) for a, b in zip(words, words[1:])}) / max(1, len(words) - 1),
    ]


def plain_walk(model, x):
    """One row through all trees, node by node."""
    raw = model.base
    for f, t, leaves in zip(model.features, model.thresholds, model.leaves, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > t[node] else 1)
        raw += leaves[node - len(f)]
    return 1 / (1 + np.exp(-raw))


def test_quality_query_against_plain_python(spark):
    """op3's rows: scores by counting and by walking trees row by row."""
    from cadence.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    want = {r.doc_id: (zlib.crc32(str(r.doc_id).encode()) % 3 == 1, plain_walk(model, plain_statistics(r.text))) for r in docs.collect()}
    got = queries.op3_quality_model(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        held_out, score = want[r.doc_id]
        assert r.held_out == held_out and r.score == pytest.approx(score, abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_splits_against_plain_search():
    """The first tree's root and leaves, by trying every cut of every statistic on the rows themselves."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 9, 400), rng.integers(0, 5, 400), rng.normal(size=400)], axis=1).astype(float)
    y = ((x[:, 0] > 4) ^ (rng.random(400) < 0.1)).astype(float)
    model = quality_model.grow(x, y, trees=1, depth=1, bins=64, rate=0.5)
    p = y.mean()
    g, h = y - p, np.full(400, p * (1 - p))

    def gain(left):
        parts = [(g[s].sum(), h[s].sum()) for s in (left, ~left, np.ones(400, bool))]
        values = [a * a / (b + 1) for a, b in parts]
        return values[0] + values[1] - values[2] if min(parts[0][1], parts[1][1]) >= 1 else -1

    best = max(gain(x[:, j] <= c) for j in range(3) for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])))
    left = x[:, model.features[0, 0]] <= model.thresholds[0, 0]
    assert gain(left) == pytest.approx(best)
    assert model.leaves[0] == pytest.approx([0.5 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_masks_for_items_of_4_to_30_tokens():
    """Every allowed set of replaced tokens leaves a seed of the item whole at some place."""
    from itertools import combinations

    for n in range(decontaminate.LEAST_TOKENS, 31):
        masks = [*decontaminate.MASKS, *([tuple(range(n))] if n < decontaminate.SPAN else decontaminate.SHORT_MASKS.get(n, ()))]
        width, allowed = min(n, 13), 0 if n < 8 else n // 5 if n < 13 else 2
        for first in range(n - width + 1):  # a document may hold just these tokens of the item
            places = [{s + o for o in m} for m in masks for s in range(first, first + width - m[-1])]
            assert all(any(not p & set(c) for p in places) for c in combinations(range(first, first + width), allowed))


def windows_of(doc, item, width=13, most=2):
    """Whether some 13 tokens of the item lie in the document with at most 2 replaced, by trying all places."""
    w = min(width, len(item))
    allowed = 0 if len(item) < 8 else len(item) // 5 if len(item) < width else most
    return any(
        sum(a != b for a, b in zip(doc[i : i + w], item[j : j + w], strict=True)) <= allowed for i in range(len(doc) - w + 1) for j in range(len(item) - w + 1)
    )


@pytest.mark.parametrize("most", [1_000_000, 60])
def test_decontamination_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (13, 20, 40, 5, 25)]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items)
        a = rng.randint(0, max(0, len(item) - 13))
        part = item[a : a + rng.choice([8, 12, 13, 20])]
        for k in rng.sample(range(len(part)), min(len(part), rng.randint(0, 4))):
            part[k] = "other"
        at = rng.randint(0, len(words))
        docs.append((i, words[:at] + part + words[at:]))
    df = spark.createDataFrame([(i, " ".join(w).upper() + "!") for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, ", ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {i: [k for k, item in enumerate(items) if windows_of(w, item)] for i, w in docs}
    assert any(got.values()) and not all(got.values())


def test_decontamination_of_runs_against_brute_force(spark):
    """Texts of runs of one to six tokens in turn, with single tokens replaced."""
    rng = random.Random(21)

    def text(most):
        out = []
        while len(out) < most:
            turn = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))]
            out += (turn * 60)[: rng.randint(1, 50)]
            if rng.random() < 0.4:
                out[rng.randrange(len(out))] = rng.choice("xyz")
        return out

    items = [["a"] * 40, ["a", "b"] * 25, ["a"] * 6, *(text(n) for n in (13, 20, 30, 60, 90, 8, 10, 5))]
    docs = [["a"] * 7, ["a"] * 13, ["x", *["a"] * 300, "y"], ["b", "a"] * 100, *(text(rng.randint(0, 160)) for _ in range(150))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {i: [k for k, item in enumerate(items) if windows_of(w, item)] for i, w in enumerate(docs)}
    assert any(got.values()) and not all(got.values())


def test_seeds_of_a_run_do_not_grow_with_it(spark):
    """A run has seeds at its ends only, whatever its period up to PERIODS."""
    texts = [" ".join(["a b c d".split()[k % period] for k in range(n)]) for period in (1, 2, 3, 4) for n in (1_000, 4_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.transform(decontaminate.tokens_of(F.col("text")), lambda t: F.xxhash64(t)).alias("h"))
    sizes = [r.n for r in df.select(F.size(decontaminate._places(F.col("h"), 13)).alias("n")).collect()]
    assert sizes[0::2] == sizes[1::2] and max(sizes) <= 2 * 13 + decontaminate.PERIODS


def test_items_that_are_too_short_are_listed(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, "one two three four"), (None, "!")], "item_id long, text string")
    assert {(r.item, r.n_tokens) for r in decontaminate.too_short(bench).collect()} == {(1, 3), (2, 0), (None, 0)}


def test_masks_meet_every_pair_of_substitutions():
    from itertools import combinations

    places = [{s + o for o in m} for m in decontaminate.MASKS for s in range(13 - m[-1])]
    assert all(any(not p & set(c) for p in places) for c in combinations(range(13), 2))


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (None, "one two")], "item_id long, text string").withColumn("item", F.lit(0))
    got = decontaminate.decontaminate(odd_docs, bench, keep=("text", "id"))
    assert got.count() == odd_docs.count()
    assert sorted(str(r.doc_id) for r in got.where("NOT kept").collect()) == ["1", "1", "7", "None"]
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench.limit(0)).where("NOT kept").count() == 0


def test_short_items_with_every_substitution(spark):
    from itertools import combinations

    items = {n: [f"t{n}x{k}" for k in range(n)] for n in range(8, 13)}
    docs = [["before", *("other" if k in c else t for k, t in enumerate(item)), "after"] for n, item in items.items() for m in (n // 5, n // 5 + 1) for c in combinations(range(n), m)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {i: [n for n, item in items.items() if windows_of(w, item)] for i, w in enumerate(docs)}


def damaged_in_the_middle(member):
    return member[: len(member) // 2] + bytes(x ^ 0x5A for x in member[len(member) // 2 : len(member) // 2 + 40]) + member[len(member) // 2 + 40 :]


def test_warc_reads_on_after_damage(spark):
    """49 pages in one archive, one of them damaged at any of its places: 48 whole rows and one that isn't."""
    rng = random.Random(3)
    payloads = [" ".join(str(rng.random()) for _ in range(60)).encode() for _ in range(49)]
    members = [list(warc.page_records(i, "u", p, digest(p.decode()), None, "0", "2024-01-01T00:00:00Z", 1 << 20, 1 << 20))[0] for i, p in enumerate(payloads)]
    middle, head, none, cut = (list(members) for _ in range(4))
    middle[1] = damaged_in_the_middle(members[1])
    head[1] = members[1][:10] + b"\xff" * 60 + members[1][70:]
    none[1] = b"\x00" * 500
    cut[1] = members[1][:-200]
    for damaged in (middle, head, none, cut):
        rows = warc.read_warc(spark, [archive_of(spark, *damaged)]).collect()
        whole = {r.page_id for r in rows if r.complete}
        assert whole == set(range(49)) - {1} and len(rows) == 49, sorted((r.page_id or -1, r.complete) for r in rows)
    both = warc.read_warc(spark, [archive_of(spark, *head[:2], *middle[1:2], *members[2:40], members[40][:-200])]).collect()
    assert {r.page_id for r in both if r.complete} == {0, *range(2, 40)} and len([r for r in both if not r.complete]) == 3


def test_warc_records_of_one_member_after_a_wrong_length(spark):
    import gzip

    members = [gzip.decompress(list(warc.page_records(i, "u", b"x%d" % i * 50, digest(("x%d" % i) * 50), None, "0", "2024-01-01T00:00:00Z", 1 << 20, 1 << 20))[0]) for i in range(5)]
    for wrong in (b"7", b"300", b"9999999", b"no", b""):
        at = members[1].index(b"\r\nContent-Length: ") + len(b"\r\nContent-Length: ")
        bad = members[1][:at] + wrong + members[1][members[1].index(b"\r\n", at) :]
        rows = warc.read_warc(spark, [archive_of(spark, gzip.compress(b"".join([members[0], bad, *members[2:]])))]).collect()
        assert {r.page_id: r.complete for r in rows} == {0: True, 1: False, 2: True, 3: True, 4: True} and len(rows) == 5


def test_samples_far_under_a_millionth_of_the_rows(spark):
    """About as many rows as asked for are learned from, out of 40 million, and the models work."""
    from cadence.llm.common import hashed_share

    assert 5 <= spark.range(40_000_000).where(hashed_share(F.col("id"), 20 / 40_000_000)).count() <= 60
    text = F.when(F.col("id") % 2 == 0, F.lit("the cat sat on the mat and looked at us")).otherwise(F.lit("der Hund lief über die große Straße nach Haus"))
    docs = spark.range(40_000_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    model = language_id.fit(docs, sample_rows=20)
    assert model.languages == ["de", "en"]
    few = spark.createDataFrame([(1, "the mat and the cat"), (2, "die große Straße")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(few, model).collect()} == {1: "en", 2: "de"}
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    trees = quality_model.fit(docs, labels, sample_rows=200)
    scored = {r.doc_id: r.predicted for r in quality_model.score(docs.where("doc_id < 2"), trees).collect()}
    assert scored == {0: 0, 1: 1}
