"""Licence scans on small texts, against direct counting."""

import random
import re
from collections import Counter

from docmill.llm import licenses


def plain_dice(a, b):
    grams = lambda t: Counter(zip(w := re.findall("[a-z0-9]+", t.lower()), w[1:]))
    x, y = grams(a), grams(b)
    return 2 * (x & y).total() / (x.total() + y.total())


def plain_hits(texts, templates, least):
    """{(id, licence): (dice, units)} of rows (id, text), unit by unit: lines, paragraphs, whole texts, windows of words."""
    cut = lambda t: re.findall("[a-z0-9]+", t.lower())
    sizes = {tuple(cut(t)) for ts in templates.values() for t in ts}
    found = {}
    for i, text in texts:
        text = text or ""
        words = cut(text)
        units = {tuple(cut(u)) for u in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]}
        for t in sizes:
            windows = (tuple(words[a : a + len(t)]) for a in range(len(words) - len(t) + 1))
            units |= {w for w in windows if w[:2] == t[:2] or w[-2:] == t[-2:]}
        for u in (" ".join(u) for u in units if 1 < len(u) < 1000):
            for name, ts in templates.items():
                for d in (plain_dice(u, t) for t in ts):
                    if d >= least:
                        best, n = found.get((i, name), (0, 0))
                        found[i, name] = max(best, round(d, 9)), n + 1
    return found


def test_whole_operator(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    near = mit[2].replace("free of charge, ", "").upper()
    at = near.index(" ", 200)
    texts = [
        (1, "intro\nLICENSED under the Apache License -- version 2.0\nmore text here"),
        (2, f"{near[:at]}\n{near[at:]}\n\nother paragraph"),
        (3, apache[1]),
        (4, "no licence at all\nto be to be to be to be"),
        (5, None), (6, ""), (7, "\n \n"), (8, "x " * 50_000 + "\n" + mit[0]), (8, mit[0]), (None, mit[0]),
    ]
    docs = spark.createDataFrame([(i, t, "c", 0.0) for i, t in texts], "doc_id long, text string, license string, dice double")
    got = {(r["doc_id"], r["license"]): (round(r["dice"], 9), r["units"]) for r in licenses.license_hits(docs).collect()}
    assert got == plain_hits(texts, licenses.TEMPLATES, licenses.LEAST)
    assert set(got) == {(1, "Apache-2.0"), (2, "MIT"), (3, "Apache-2.0"), (8, "MIT"), (None, "MIT")}
    assert got[3, "Apache-2.0"][0] == got[8, "MIT"][0] == 1.0
    assert licenses.license_hits(docs.limit(0)).count() == 0


def test_notices_inside_longer_units(spark):
    """Every window of a template's size is compared by brute force, so a notice is found wherever it stands."""
    apache, mit = licenses.TEMPLATES["Apache-2.0"][1], licenses.TEMPLATES["MIT"][2]
    spread = apache.replace(" You may obtain", "\n\nYou may obtain").replace(" Unless", "\n\nUnless")
    texts = [
        (1, "See docs. Licensed under the Apache License, Version 2.0. All rights go on for many more words than that."),
        (2, "A title\n\n" + spread + "\n\n" + "something else " * 200),
        (3, "code " * 100 + "\n" + mit.replace(" ", "\n", 30) + "\nint main " * 100),
        (4, "licensed under nothing at all by any of the other people here"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): round(r["dice"], 9) for r in licenses.license_hits(docs).collect()}
    want = {}
    for i, text in texts:
        words = re.findall("[a-z0-9]+", text.lower())
        for name, ts in licenses.TEMPLATES.items():
            sizes = {len(re.findall("[a-z0-9]+", t.lower())): t for t in ts}
            best = max((plain_dice(" ".join(words[a : a + n]), t) for n, t in sizes.items() for a in range(max(1, len(words) - n + 1))), default=0)
            if best >= licenses.LEAST:
                want[i, name] = round(best, 9)
    assert got == want and set(got) == {(1, "Apache-2.0"), (2, "Apache-2.0"), (3, "MIT")}


def test_repeats_count(spark):
    wanted = {"T": ["a b a b a b c"]}
    docs = spark.createDataFrame([(1, "a b a b a b c"), (2, "a b a b a b a b a b"), (3, "a b b a c b")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (round(r["dice"], 9), r["units"]) for r in licenses.license_hits(docs, wanted, 0.5).collect()}
    assert got == plain_hits(docs.collect(), wanted, 0.5)
    assert got[1, "T"][0] == 1.0


def test_anchor_words_are_in_every_match():
    rng = random.Random(0)
    for template in [t for ts in licenses.TEMPLATES.values() for t in ts] * 30:
        words = template.split()
        for _ in range(rng.randint(1, max(1, len(words) // 4))):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], ["other"], [words[i], "more"]])
            words = words or ["x"]
        text = " ".join(words)
        if len(words) > 1 and plain_dice(text, template) >= licenses.LEAST:
            assert any(w in text.lower() for w in licenses.anchor_words(template, licenses.LEAST))
