"""Prefix trie, Merkle manifest and line dedup against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadence.llm import line_dedup, merkle, prefix_trie
from cadence.llm.common import crc_mod

SPACE = " \t\n\x0b\x0c\r"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), mark, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(int(c - math.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(cs) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += node not in children
    return sorted(
        (min(cs), len(n), -1 if not n else min(members[n[:-1]]), len(cs), len(children[n]), leaves[n], saved[n],
         sha(",".join(map(str, sorted(c for c in cs if len(built[c]) == len(n))))))
        for n, cs in members.items()
    )


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "block", "ka", "pos", "weight", "n", "first", "h"):
        df = df.withColumn(name, F.lit("x"))
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in prefix_trie.trie(df).collect())


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(95, 135), 200, 305, -7, -100, -250, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "é\U0001f600", "", None])))
    rows += [(7, None, "user", "first"), (7, None, "assistant", "first"), (7, 0, "user", "tie"), (None, 0, "user", "nobody"), (8, 0, "user", "hi"), (8, 0, "user", "hi")]
    return rows


def test_trie_against_a_plain_version(spark):
    rows = odd_conversations()
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_with_small_blocks_and_chunks(spark, monkeypatch):
    """Long conversations over many blocks, end lists over many chunks, parents of many children."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    monkeypatch.setattr(prefix_trie, "MANY", 20)
    rows = odd_conversations() + [(c, t, "user", f"t{t}") for c in (401, 402, 403, 404) for t in range(20 + c % 3)]
    rows += [(c, t, "u", "same") for c in range(600, 640) for t in range(2)] + [(c, 0, "u", str(c)) for c in range(700, 730)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_no_or_turnless_conversations(spark):
    assert trie_rows(spark, []) == []
    # crc32("1") % 6 and crc32("2") % 6: conversations with fewer turns than they would take from an absent base
    rows = [(c, 0, "u", "x") for c in range(1, 30)]
    got = trie_rows(spark, rows)
    assert got == plain_trie(rows) and any(len(r) and r[1] == 0 for r in got)


# --- Merkle manifest


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(text))

    def climb(level):
        """The root and, for each leaf, its (left, right) on the way up."""
        ways, place = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for way, p in zip(ways, place, strict=True):
                run = level[p // 3 * 3 : p // 3 * 3 + 3]
                way.append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
            level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
            place = [p // 3 for p in place]
        return level[0], ways

    by = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        other = r[1].replace("\n", "") if even and r[1] is not None else r[1]
        by[r[3]].append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), leaf(r, other)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: climb([x[1] for x in sorted(by[s])]) for s in order}
    root, over = climb([tops[s][0] for s in order])
    out = []
    for s, high in zip(order, over, strict=True):
        for (i, own, changed), way in zip(sorted(by[s]), tops[s][1], strict=True):
            h = changed
            for left, right in way + high:
                h = sha(left, h, right)
            out.append((i[1] if i[0] else -1, own, tops[s][0], root, sha(*(x + y for x, y in way + high)), h, h == root))
    return sorted(out)


def manifest_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("leaf", "tree", "node", "idx", "path", "position", "changed"):
        df = df.withColumn(name, F.lit("x"))
    leaves = merkle.leaves_of(df, crc_mod(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in merkle.manifest(leaves).collect())


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_against_a_plain_version(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    sizes = {"a": 1, "b": 3, None: 4, "": 9, "é": 10, "Z": 28, "z": 82}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 501, f"line {n}\nnext\n" if n % 3 else f"one line {n}", "en" if n % 4 else None, source, n))
    rows += [(None, None, None, "b", None), (5, "x\ny", "en", "b", 3), (5, "x\ny", "en", "b", 3), (5, "other", "en", "b", 3), (6, "", "de", "one", 0), (8, "w\n" * 100_000, "en", "a", 1)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_of_one_document_and_of_none(spark):
    rows = [(4, "a\nb", "en", "s", 3)]
    assert manifest_rows(spark, rows) == plain_manifest(rows) and manifest_rows(spark, rows)[0][4] == sha()
    assert manifest_rows(spark, []) == []


# --- line dedup


def plain_lines(rows, chars=20, docs=3):
    def key(line):
        line = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
        return line if len(line) >= chars else None

    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    last = {k: max(x, key=lambda i: (i is not None, i or 0)) for k, x in held.items() if k is not None and len(x) >= docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("frequent", [2, 1000])
def test_lines_against_a_plain_version(spark, monkeypatch, frequent):
    """With every repeated key taken as a frequent one, and with none."""
    monkeypatch.setattr(line_dedup, "FREQUENT_PART", 10_000)
    rng = random.Random(6)
    pool = [f"This is the shared line number {i}, long enough." for i in range(12)] + ["short", "", "  ", "ä" * 20, " " + "x" * 19, "y" * 19]
    shape = [str.upper, str.lower, lambda x: f" \t{x}\r", lambda x: x, lambda x: x + "\x0b"]
    rows = [(i, "\n".join(rng.choice(shape)(rng.choice(pool)) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(None, pool[0]), (None, pool[1] + "\n" + pool[0]), (70, None), (71, ""), (72, "\n"), (5, pool[2]), (5, pool[2]), (80, "\n".join([pool[3]] * 5)), (81, ("w " * 30_000 + "\n") * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("line", "lines", "pos", "h1", "keep", "n_lines", "text_key", "item", "count"):
        df = df.withColumn(name, F.lit("x"))
    maps = line_dedup.bitmaps(df, frequent_lines=frequent)
    got = line_dedup.apply(df, maps).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == plain_lines(rows)
    for r in maps.collect():
        assert sum(x.length for x in r.keep) == r.n_lines - r.n_dropped and "text" not in r


def test_lines_of_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.apply(df, line_dedup.bitmaps(df)).count() == 0


def test_lines_are_ranged_by_hash_without_a_second_shuffle(spark):
    rows = line_dedup.keys(spark.createDataFrame([(1, "x" * 30), (2, "x" * 30)], "doc_id long, text string"))
    text = line_dedup._of_ranges(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in text and "hashpartitioning" not in text and text.count("Exchange") == 1
