import random

import pytest

from cadence.llm import near_dup


def brute_force(rows, percent=75):
    """{row place: (n_shingles, component)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc) if doc is not None else None
    return sorted((str(doc), len(sets[i]), str(least[find(i)])) for i, (doc, _) in enumerate(rows))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def edited(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(5, 150))
        rows += [(rng.random(), edited(base, rng.randint(0, max(0, len(base) // 20)), rng)) for _ in range(rng.randint(1, 6))]
    # a star: copies that are linked with their base and hardly with one another, more than a small region holds
    base = rng.choices(vocabulary, k=200)
    rows += [(rng.random(), " ".join(base))] + [(rng.random(), edited(base, 5, rng)) for _ in range(120)]
    rows = [(i, text) for i, (_, text) in enumerate(sorted(rows))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_dup.near_duplicates(df)) == brute_force(rows)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    result = near_dup.near_duplicates(odd_docs)
    assert found(result) == brute_force(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in result.collect())


def test_empty(no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("finish", [0, 20_000])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(near_dup, "FINISH_EDGES", finish)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 300)]
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] == got[102] and got[200] == got[300]
    assert len(set(got.values())) == 3


def test_packing():
    s = near_dup.shingles("a b c d e f g h")
    assert len(s) == 4 and len(near_dup.unpack(near_dup.pack(s))) == 4
    assert near_dup.linked(s, s, 75) and not near_dup.linked(s, s[:2], 75) and near_dup.linked(s, s[:3], 75)


def test_families_in_one_region(spark):
    """Stars that share most of their text, with strays that only link to a few copies of their own family."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    common, rows = rng.choices(vocabulary, k=120), []
    for _ in range(3):
        base = common + rng.choices(vocabulary, k=60)
        rows += [" ".join(base)] + [edited(base, rng.randint(2, 7), rng) for _ in range(90)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert found(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def replaced(words, places, name):
    return [f"{name}x{k}" if k in places else w for k, w in enumerate(words)]


def star_with_strays(vocabulary, rng, name, members=90, strays=10):
    """Near copies of one text, and strays that link to one copy each, at 0.76, and neither to the text (0.71) nor to one another."""
    base, slots = rng.choices(vocabulary, k=200), range(8, 190, 8)
    copies = [(place := rng.choice(slots), replaced(base, [place], f"{name}c{i}")) for i in range(members)]
    far = [replaced(copy, [1, *rng.sample([s for s in slots if s != place], 5)], f"{name}s{i}") for i, (place, copy) in enumerate(copies[:strays])]
    return [" ".join(x) for x in (base, *(copy for _, copy in copies), *far)]


def numbered(spark, rows, rng):
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_strays_do_not_depend_on_their_count(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 0)
    monkeypatch.setattr(near_dup, "NEIGHBOURS", 1)
    rng = random.Random(23)
    rows, df = numbered(spark, star_with_strays([f"w{i}" for i in range(3000)], rng, "a"), rng)
    assert found(near_dup.near_duplicates(df)) == brute_force(rows)


def test_regions_of_any_size_are_whole(spark, monkeypatch):
    """Strays of a family meet all of it, also where a region is over the rows that one task holds."""
    monkeypatch.setattr(near_dup, "REGION_ROWS", 40)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "NEIGHBOURS", 1)
    rng = random.Random(29)
    rows, df = numbered(spark, star_with_strays([f"w{i}" for i in range(3000)], rng, "a", members=140, strays=25), rng)
    assert found(near_dup.near_duplicates(df)) == brute_force(rows)


def test_bridges_between_families(spark, monkeypatch):
    """Pairs of families whose texts are at 0.69, and each at most at 0.742 from the other's member of the one link, at 0.758."""
    monkeypatch.setattr(near_dup, "NEIGHBOURS", 1)
    monkeypatch.setattr(near_dup, "HUBS", 64)  # hubs of both families in the first round
    rng, rows, slots = random.Random(31), [], range(8, 190, 8)
    for f in range(3):
        one, spots = rng.choices([f"w{i}" for i in range(3000)], k=200), rng.sample(slots, 6)
        a, b, two = (replaced(one, part, f"t{f}") for part in ([198], [198, 1, *spots[:5]], [198, 1, *spots]))
        rows += [" ".join(x) for x in (one, a, b, two)]
        for base in (one, two):
            rows += [" ".join(replaced(base, [rng.choice(slots)], f"m{f}n{len(rows)}x{i}")) for i in range(45)]
    rows, df = numbered(spark, rows, rng)
    assert found(near_dup.near_duplicates(df)) == brute_force(rows)


def test_one_link_between_two_families(spark, monkeypatch):
    """Cores at 0.66, copies around each, and one pair at 0.753 whose ends are at 0.88 to their own core and under 0.73 to the other."""
    monkeypatch.setattr(near_dup, "NEIGHBOURS", 1)
    monkeypatch.setattr(near_dup, "HUB_PAIRS", 16)  # also deals a hub's pairs out
    rng = random.Random(1)
    one, slots = rng.choices([f"w{i}" for i in range(3000)], k=500), rng.sample(range(8, 490, 8), 29)
    apart = slots[:20]
    two = replaced(one, apart, "two")
    x = replaced([two[k] if k in apart[:5] else w for k, w in enumerate(one)], slots[20:21], "x")
    y = replaced([one[k] if k in apart[5:9] else w for k, w in enumerate(two)], slots[21:23], "y")
    rows = [" ".join(t) for t in (one, two, x, y)]
    for name, base in (("a", one), ("b", two)):
        rows += [" ".join(replaced(base, [rng.choice(slots[23:])], f"{name}{i}")) for i in range(100)]
    rows, df = numbered(spark, rows, rng)
    want = brute_force(rows)
    assert len({c for _, _, c in want}) == 1
    assert found(near_dup.near_duplicates(df)) == want


def test_texts_that_share_an_id(spark):
    """Two texts have the smallest id 5; only one of them has a near copy."""
    rng = random.Random(37)
    a, b = (rng.choices([f"w{i}" for i in range(500)], k=100) for _ in range(2))
    rows = [(5, " ".join(a)), (7, " ".join(a)), (5, " ".join(b)), (9, " ".join(b)), (2, edited(b, 1, rng)), (5, " ".join(a)), (None, " ".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_dup.near_duplicates(df)) == brute_force(rows)
    keyed = near_dup.near_duplicates(df, row_keys=True)
    assert sorted(r.doc_id for r in keyed.where("first AND doc_id IS NOT NULL").collect()) == [2, 5, 5]
    assert keyed.where("first").select("row_key").distinct().count() == 3
