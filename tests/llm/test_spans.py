"""Secret scans and personal data against plain regular expressions."""

import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import pii, secret_scan


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def plain_personal(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


PARTS = [
    "password=", "Token : '", "api_key\"=", "APIKEY:", "secret", "AKIA", "ABCDEFGH12345678", "deadbeef0123456789abcdef", "a@b.co", "@", ".", "-", " ",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (988) 555-2485", "+", "0", "1", "255", "256.1.2.3", "10.0.0.1", "1.2.3.4.5.6.7.8", "x", "é", "ſ", "K", "\n", "(", ")",
]
texts = st.lists(st.sampled_from(PARTS) | st.text(alphabet="ab1. -+@0=:é", max_size=6), max_size=14).map("".join)


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_base_secrets(text):
    found = secret_scan.find_secrets(text)
    assert [s for s in found if s[0] != "entropy"] == plain_secrets(text)
    assert found == sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


@settings(max_examples=3000, deadline=None)
@given(texts)
def test_base_personal(text):
    assert [s for s in pii.find_personal(text) if s[0] in pii.BASE] == plain_personal(text)


def test_windows_equal_direct_entropy():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abcdefXYZ0123456789/+"[: rng.randint(2, 21)]) for _ in range(rng.randint(15, 70)))
        bits, covered = secret_scan.LEAST_BITS[secret_scan.character_class(text)], set()
        for i in range(len(text) - secret_scan.WINDOW + 1):
            counts = Counter(text[i : i + secret_scan.WINDOW]).values()
            if -sum(c / 20 * math.log2(c / 20) for c in counts) >= bits - 1e-9:
                covered.update(range(i, i + secret_scan.WINDOW))
        assert {p for a, b in secret_scan.dense_windows(text) for p in range(a, b)} == covered


def test_entropy_finds_keys_and_spares_words():
    key = "q8Zr2LwX7pTn4VkB9sYd"
    assert ("entropy", 4, 24) in secret_scan.find_secrets(f"use {key} now")
    for found in ("/example/path/aB3dE5fG7hJ9kL1mN3pQ", "qZrLwXpTnVkBsYdGhJfM", "sha256-x/q8Zr2LwX7pTn4VkB9sYd=/k3Jd8Wn1Zb5Q"):
        assert [k for k, *_ in secret_scan.find_secrets(f"see {found} there")] == ["entropy"]
    for harmless in ("python3/site-packages/CamelCaseNamesOfClasses", "Donaudampfschifffahrtsgesellschaft", "123e4567-e89b-12d3-a456-426614174000", "-" * 60, "your_q8Zr2LwX7pTn4VkB9s"):
        assert secret_scan.find_secrets(f"see {harmless} there") == []
    assert secret_scan.redact(f"a {key}.", [("entropy", 2, 22), ("hex", 4, 9)]) == "a [SECRET]."


def test_added_personal_kinds():
    text = "see https://example.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no 12345678"
    found = {(k, text[a:b]) for k, a, b in pii.find_personal(text)}
    assert {("url", "https://example.org/a?b=1"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")} <= found
    assert not [k for k, *_ in pii.find_personal("IBAN: DE88 3704 0044 0532 0130 00") if k == "iban"]


def test_operators_on_odd_rows(spark):
    big = 2**53 + 1
    rows = [(big, "mail a@b.co", "x"), (big, "mail a@b.co", "x"), (None, None, None), (2, "", "y"), (3, "x" * 300_000 + " token=abcdef", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [tuple(r) for r in pii.personal_spans(docs).collect()]
    assert sorted((d or 0, len(s)) for d, s in got) == [(0, 0), (2, 0), (3, 0), (big, 1), (big, 1)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.secret_spans(docs).collect()}
    assert got[3] == [("assign", 300_001, 300_013)] and got[None] == []
    assert pii.personal_spans(docs.limit(0)).count() == secret_scan.secret_spans(docs.limit(0)).count() == 0


def test_queries_digest(spark, tmp_path):
    text = "token=abcdef and a@b.co, 10.0.0.1"
    spark.createDataFrame([(7, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = secret_scan.op6_secret_scan(spark, str(tmp_path)).first()
    assert row["n_assign"] == 1 and row["base_sha256"] == hashlib.sha256(b"assign:0:12").hexdigest()
    row = pii.op10_personal_data(spark, str(tmp_path)).first()
    assert (row["n_email"], row["n_ip"], row["spans"]) == (1, 1, "email:17:23,ip:25:33")
