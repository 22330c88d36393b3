"""Pieces and Myers' distance against dynamic programming, and leaks planted in texts."""

import random

from docmill.llm import decontamination as dec


def plain(pattern, text):
    """Least edits of ``pattern`` against any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row), row.index(min(row))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yé"])[:1]
    return "".join(out)


def test_myers_equals_dynamic_programming():
    rng = random.Random(0)
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 120)))
        best, end = plain(a, b)
        assert dec.myers(a, b) == ((best, end) if best < len(a) else (len(a), 0))


def test_finds_all_within_budget_and_nothing_else():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 30)))) for i in range(12)]
    finder = dec.Finder([*items, (98, None or ""), (99, "  ")])
    for _ in range(150):
        i, item = rng.choice(items)
        text = " ".join([*rng.choices(words, k=20), edited(rng, item, rng.randint(0, len(item) // 7)), *rng.choices(words, k=20)])
        text = text.replace(" ", rng.choice([" ", "\n ", "\t"])).upper()
        got = {k: e for k, _, _, e in finder.find(text)}
        want = {}
        for k, t in items:
            n, _ = plain(dec.normal(t), dec.normal(text))
            if n <= len(dec.normal(t)) // 10:
                want[k] = n
        assert got == want


def test_positions_are_of_the_text():
    finder = dec.Finder([(1, "the quick  brown fox jumps over the lazy dog")])
    text = "İntro:\n\n The  QUICK brown\tfox jumps ovr the lazy dog!"
    ((item, start, end, edits),) = finder.find(text)
    assert (item, edits, text[start:end]) == (1, 1, text[9:-1]) and dec.lowered("İA") == "İa"


def test_operators_on_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six", "x"), (None, "skipped words here", "x"), (2, None, "x"), (1, "one two three four five six", "x")], "item_id long, text string, doc_id string")
    rows = [(1, "a one two three four five six b", "x", 0), (1, "a one two three four five six b", "x", 0), (None, "one two three four fve six", "x", 0), (2, None, None, 0), (3, "", "x", 0), (4, "skipped words here", "x", 0), (5, "z " * 100_000 + "one two three four five six", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, edits int")
    got = [(r["doc_id"], r["item_id"], r["edits"]) for r in dec.contamination(docs, items).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 0), (1, 1, 0), (None, 1, 1), (5, 1, 0)], key=repr)
    kept = dec.without_items(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert dec.contamination(docs.limit(0), items).count() == dec.contamination(docs, items.limit(0)).count() == 0
    assert dec.without_items(docs, items.limit(0)).count() == 7


def test_short_items_count_as_whole_words_unchanged():
    finder = dec.Finder([(1, "what is 17 x 3?"), (2, "cat"), (3, "(a)")])
    assert [r[0] for r in finder.find("He asked: What  is 17 x 3? Then left.")] == [1]
    assert finder.find("what is 17 x 4? concatenate cats") == []
    text = "A Cat, concat (A)b"
    assert [(k, text[a:b], e) for k, a, b, e in finder.find(text)] == [(2, "Cat", 0), (3, "(A)", 0)]
    assert [r[0] for r in finder.find("cats cat")] == [2]
