"""Near-duplicates by shingle sets against all pairs."""

import random

import numpy as np

from docmill.llm import near_sets, pipeline, simhash
from docmill.llm.components import components


def plain_set(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_kept(rows, least=0.8):
    sets, root = [plain_set(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least_id = {}
    for i, (k, *_) in enumerate(rows):
        least_id[find(i)] = min(least_id.get(find(i), (True, 0)), (k is None, k or 0))
    return sorted(None if none else k for none, k in least_id.values() if not none) + [None for none, _ in least_id.values() if none]


def planted():
    """Texts, and copies of them with 0.75 to 0.97 of their shingles; phrases that many texts have; odd rows."""
    rng = random.Random(0)
    phrase = "as is without any warranty of any kind to the extent that the law permits".split()
    rows, near = [], []
    for i in range(60):
        words = ["w%d" % rng.randint(0, 3000) for _ in range(rng.randint(40, 400))]
        if i % 3 == 0:
            words[5:5] = phrase
        rows.append((i, " ".join(words)))
        for c in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(max(1, int(len(words) * rng.uniform(0.002, 0.028)))):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randint(0, 10**6)
            rows.append((100 * (c + 1) + i, " ".join(copy).upper() if c % 2 else " ".join(copy)))
            if 0.8 <= similarity(plain_set(rows[-1][1]), plain_set(rows[-2 - c][1])) < 0.95:
                near.append((rows[-2 - c][1], rows[-1][1]))
    base = ["g%d" % i for i in range(150)]
    rows += [(1000 + i, " ".join([*base[:i], "z%d" % i, *base[i + 1 :]])) for i in range(0, 150, 2)]  # a large group
    rows += [(2000, "a b c d e f g h"), (2001, "a b c d e f g h i"), (2002, "A b c"), (2003, "a b c"), (2004, "a b d"), (2005, " "), (2006, None), (None, "lone words here"), (2006, None)]
    return rows, near


def test_finds_all_pairs_of_the_threshold(spark):
    rows, near = planted()
    assert len(near) > 20
    far = [(a, b) for a, b in near if (int(simhash.fingerprints_of([a])[0]) ^ int(simhash.fingerprints_of([b])[0])).bit_count() > 3]
    assert len(far) > len(near) / 2  # three bits of a fingerprint don't tell them
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) + [None] * got.count(None) == plain_kept(rows)
    assert near_sets.one_of_each(docs.limit(0)).count() == 0


def test_common_shingles_and_bitmaps_change_nothing(spark):
    rows, _ = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = []
    for sample, most, bits in ((1, 5, 64), (1, 10_000, 1 << 20), (1000, 10, 1 << 12)):
        by = {}
        for r in near_sets.near_duplicates(near_sets.keyed(docs), sample=sample, most=most, bits=bits).collect():
            by.setdefault(r["root"], []).append(repr(r["doc_id"]))
        groups.append(sorted(map(sorted, by.values())))
    assert groups[0] == groups[1] == groups[2]


def test_columns_ids_and_repeated_rows(spark):
    big = 2**53 + 1
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(big + 1, text, 1.5, "x", {"k": 1}), (big, text, 2.5, "x", None), (None, text, 3.5, "x", None), (big, text, 2.5, "x", None), (7, None, None, None, None), (None, None, 1.0, "y", None), (None, "other words", 1.0, "y", {}), (None, "other words", 1.0, "y", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` double, kept string, `row` map<string, int>").withColumnRenamed("kept", "whole")
    kept = near_sets.one_of_each(docs, bits=1 << 10)
    assert kept.columns == docs.columns
    assert sorted((repr(r["doc_id"]), r["a.b"]) for r in kept.collect()) == sorted([(repr(big), 2.5), ("7", None), ("None", 1.0)])


def test_sketches_never_differ_in_more_than_the_sets_do():
    rng = np.random.default_rng(3)
    pool = rng.integers(-(2**63), 2**63, size=3000)
    sets = [np.unique(rng.choice(pool, size=n)) for n in [1, 5, 200, 200, 900, 2500]]
    flat = near_sets.sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
    assert flat.shape == (len(sets), near_sets.SKETCH // 64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = sum(int(x).bit_count() for x in (flat[i] ^ flat[j]).view(np.uint64))
            only = len(np.setxor1d(a, b))
            assert apart <= only and (only - apart) % 2 == 0
            assert i != j or apart == 0


def test_crowded_shingles_change_nothing(spark, monkeypatch):
    """Templates that many texts share, around the threshold: the same components with turns for all shingles and none."""
    rng = random.Random(4)
    base = ["t%d" % i for i in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = "y%d" % rng.randint(0, 10**6)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert 1 < len(want) < len(rows)
    for crowded, turns in ((0, 2), (10**9, 3)):
        monkeypatch.setattr(near_sets, "CROWDED", crowded)
        monkeypatch.setattr(near_sets, "TURNS", turns)
        assert sorted(r["doc_id"] for r in near_sets.one_of_each(docs).collect()) == want


def test_trie_pairs_join_what_is_within_the_budget(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))) for b in base] + base[:5]
    rows = [(k, 10 + k % 3, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(fps)]
    pairs = near_sets.trie_pairs(spark.createDataFrame(rows, "key long, size long, fp long")).collect()
    assert all(r["m"] == 10 + r["a"] % 3 and r["n"] == 10 + r["b"] % 3 for r in pairs)
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]

    def roots(links):
        of = list(range(len(fps)))
        for _ in fps:
            for a, b in links:
                of[a] = of[b] = min(of[a], of[b])
        return of

    assert roots([(r["a"], r["b"]) for r in pairs]) == roots(near)


def test_the_stage_goes_through_the_trie(spark, monkeypatch):
    seen, links = [], near_sets.simhash.fingerprint_links
    monkeypatch.setattr(near_sets.simhash, "fingerprint_links", lambda fps, *a: seen.append(fps.count()) or links(fps, *a))
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, text.upper() + " other words here")], "doc_id long, text string")
    assert near_sets.one_of_each(docs).count() == 1 and seen and seen[0] >= 2


def test_few_links_take_few_tasks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert components(links, "a", "b").rdd.getNumPartitions() == 1


def test_tables_of_nodes_have_one_row_a_node(spark, monkeypatch):
    """What is joined with components and kept between turns is a row for each set, not for each shingle of it; a later
    turn has no more shingles than the one before."""
    rng = random.Random(5)
    base = ["t%d" % i for i in range(120)]
    rows = []
    for i in range(50):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = "y%d" % rng.randint(0, 10**6)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, written = {}, near_sets.Tables.written
    monkeypatch.setattr(near_sets, "CROWDED", 0)

    def counted(self, df, name):
        out = written(self, df, name)
        of_nodes = {"key", "prefix"} <= {*out.columns} or {"key", "gram"} <= {*out.columns}
        made.update({name: (out.count(), sum(len(r["prefix"]) for r in out.collect() if "prefix" in out.columns))} if of_nodes else {})
        return out

    monkeypatch.setattr(near_sets.Tables, "written", counted)
    assert sorted(r["doc_id"] for r in near_sets.one_of_each(docs).collect()) == plain_kept(rows)
    assert made and all(n <= len(rows) for n, _ in made.values()), made
    turns = [made[k][1] for k in sorted(made) if k.startswith("near-live")]
    assert len(turns) == 2 and turns[1] <= turns[0]


def test_small_tables_have_few_files(spark, monkeypatch):
    """Many partitions of a small table don't become a file each."""
    rows, _ = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    files, written, kept = {}, near_sets.Tables.written, near_sets.checkpointed

    def counted(self, df, name):
        out = written(self, df, name)
        files[name] = len(out.inputFiles())
        return out

    def checkpointed(df):
        out = kept(df)
        files[str(out.columns)] = out.rdd.getNumPartitions()
        return out

    monkeypatch.setattr(near_sets.Tables, "written", counted)
    monkeypatch.setattr(near_sets, "checkpointed", checkpointed)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = near_sets.one_of_each(docs)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == sorted((k is None, k or 0) for k in plain_kept(rows))
        assert out.rdd.getNumPartitions() == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(files) > 8 and max(files.values()) <= 1, files
