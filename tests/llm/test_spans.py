"""Secrets and personal data against the plain patterns, applied as stated."""

import random
import time
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from copse.llm import pii, queries, secrets

SECRET_BITS = ["password", "PassWd", "token", "secret", "api_key", "apikey", "API_KEY", "'", '"', " ", "  ", ":", "=", "AKIA", "AKIA" + "Z9" * 9, "a", "abcdef0123456789", "0123456789abcdef", "F", "xyz.=-/", "\n", "é", "ſecret", "key", "https://h.io/", "K"]
PII_BITS = ["a@b.co", "@", ".", "x", "a.b-c", "1.2.3.4", "255.255.255.256", "0001.2.3.4", "9" * 30, "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "+1 (555) 010-9999", "-", " ", "5", "12", "é", "\n", "DE89 3704 0044 0532 0130 00", "call", "555-010-9999", "078-05-1120", "(", ")", "٣"]


def base_secrets(text):
    out = []
    for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def base_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


@given(st.lists(st.sampled_from(SECRET_BITS), max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_secrets(text):
    assert secrets.base_spans(text) == base_secrets(text)


@given(st.lists(st.sampled_from(PII_BITS), max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_pii(text):
    assert pii.base_spans(text) == base_pii(text)


ID, KEY = "AZIA" + "B7" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY1"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (f"{ID} then {KEY}", ["key_id", "secret"]),
        (f"{KEY} alone", []),
        (f"{ID} alone", []),
        (f"{ID}{' ' * 400}{KEY}", []),
        (f"see https://store.example/ with {KEY}", ["secret"]),
        (f"see https://store.example/ with {KEY} for {ID}", ["endpoint", "key_id", "secret"]),
        ("see https://store.example/ only", []),
        (f"{'AKIA' + 'B7' * 8} and {KEY}", ["secret"]),
    ],
)
def test_weak_parts_report_together(text, kinds):
    assert sorted(s[0] for s in secrets.linked_spans(text, secrets.base_spans(text))) == kinds


def test_linking_is_a_plain_interval_join():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice([ID, KEY, "https://a.example", " " * rng.randint(1, 120), "password=abcdef1"]) + " " for _ in range(12))
        base = secrets.base_spans(text)
        got = secrets.linked_spans(text, base, 60)
        inside = lambda m: any(m.start() < b and a < m.end() for _, a, b in base)  # noqa: B023, E731
        parts = [("key_id", *m.span()) for m in secrets._KEY_ID.finditer(text) if not inside(m)] + [("endpoint", *m.span()) for m in secrets._URL.finditer(text) if not inside(m)]
        parts += [("secret", *m.span()) for m in secrets._SECRET.finditer(text) if not inside(m) and secrets._mixed(m[0])]
        role = {"access": "key_id", "assign": "secret", "hex": "secret"}
        every = parts + [(role[k], a, b) for k, a, b in base]
        near = lambda s, kind: any(k == kind and (a, b) != s[1:] and a <= s[2] + 60 and b >= s[1] - 60 for k, a, b in every)  # noqa: B023, E731
        want = [s for s in parts if {"key_id": near(s, "secret"), "secret": near(s, "key_id") or near(s, "endpoint"), "endpoint": near(s, "key_id") and near(s, "secret")}[s[0]]]
        assert sorted(got) == sorted(want)


def test_checks_and_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("call 555-010-9999") == ["local_phone"] and kinds("part 555-010-9999") == []
    assert kinds("my ssn 078-05-1120") == ["ssn"] and kinds("078-05-1120") == []
    assert pii.find_spans("mail a@b.co")[0][3] > pii.find_spans("x a@b.co")[0][3]
    assert pii.redact("mail a@b.co now", pii.find_spans("mail a@b.co now")) == "mail [EMAIL] now"


def test_endpoints_and_lengths():
    assert ["b.s3.amazonaws.com"] == [t[a:b] for t in ["see .b.s3.amazonaws.com."] for a, b in secrets.endpoints(t)]
    assert [t[a:b] for t in ["https://x.amazonaws.com:443/y z-1.amazonaws.com:80, .amazonaws.com Zq.amazonaws.com"] for a, b in secrets.endpoints(t)] == ["https://x.amazonaws.com:443", "z-1.amazonaws.com:80"]
    short, long = "aB3dE5gH7jK9mN1pQ3rS5tU7", "Zx9" * 10 + "qW3rT5yU7iO9pA1sD3fG5hJ7kL9zX1cV3bN5mQ" * 5
    kinds = lambda t: sorted(s[0] for s in secrets.linked_spans(t, secrets.base_spans(t)))
    assert kinds(f"client_id: my-client-7 {short}") == ["key_id", "secret"] and kinds(f"https://a.example {short}") == []
    assert len(long) > 129 and kinds(f"https://a.example {long}") == ["secret"]


def test_account_numbers_before_capital_words():
    for text in ("BE68 5390 0754 7034 EUR", "ES91 2100 0418 4502 0005 1332 EUR", "BE68 5390 0754 7034 BANK", "BE68 5390 0754 7034 BE68 5390 0754 7034"):
        found = [s for s in pii.find_spans("iban " + text) if s[0] == "iban"]
        assert ("iban " + text)[found[0][1] : found[0][2]].replace(" ", "") in ("BE68539007547034", "ES9121000418450200051332")
        assert len(found) == text.count("BE68") + text.count("ES91")


@pytest.mark.parametrize(
    "text", ["http://x " + "-" * 1_000_000, "http://x " + "a." * 500_000, "x.amazonaws.com " + "a-." * 300_000 + ".amazonaws.com" * 9, "key_id=abcdef12 " + "aB3" * 300_000, ".amazonaws.com" * 70_000, "AAIA" * 200_000]
)
def test_long_runs_take_linear_time(text):
    began = time.perf_counter()
    secrets.linked_spans(text, secrets.base_spans(text))
    assert time.perf_counter() - began < 2


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "token " * 50_000, "AKIA" * 50_000, "0 " * 150_000):
        pii.find_spans(text)
        base = secrets.base_spans(text)
        secrets.linked_spans(text, base)


def test_parts_with_very_many_zeros():
    assert pii.base_spans("1.2.3." + "0" * 6000 + "4") == [("ip", 0, 6007)]
    assert pii.base_spans("1.2.3." + "9" * 6000) == []


def test_documents(spark):
    texts = ["", None, "a@b.co 1.2.3.4", "password=abcdef1 " * 2, "é a@b.co"]
    df = spark.createDataFrame([(None if i == 0 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    for find, base, module in ((pii.find_pii, base_pii, pii), (secrets.find_secrets, base_secrets, secrets)):
        found = find(df)
        rows = {r.doc_id: r for r in queries._found(found, {f"n_{k}": k for k in module.BASE}, module.BASE, module.KINDS).collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(texts):
            want = sorted(base(t or ""), key=lambda s: (s[1], module.KINDS.index(s[0])))
            assert rows[None if i == 0 else i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert find(df.limit(0)).count() == 0
    kept = pii.redacted(df)
    assert kept.columns == df.columns and {r.text for r in kept.collect()} == {"", None, "[EMAIL] [IP]", "password=abcdef1 " * 2, "é [EMAIL]"}
