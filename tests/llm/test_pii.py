import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from thermalake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def base_of(text):
    return [s for s in pii.find_spans(text, pii._automaton()) if s[0] in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+ 0123459()é/:", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert base_of(text) == brute(text)


def test_known_values():
    text = "é mail a.b+c@x-1.example.com, 10.0.0.255 x 4111 1111 1111 1111, +49 (30) 123456-7 https://a.b/c. IBAN DE89370400440532013000"
    found = pii.find_spans(text, pii._automaton())
    assert [k for k, _, _ in found] == ["email", "ip", "card", "phone", "url", "account"]
    assert [s for s in found if s[0] in pii.BASE] == brute(text)
    assert ("account", text.index("DE89"), len(text)) in found


def test_secrets_and_addresses():
    machine = pii._automaton()
    spans = lambda text: [(k, text[s:e]) for k, s, e in pii.find_spans(text, machine)]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert spans(f'token = "{key}" the') == [("secret", key)]
    assert spans("password: hunter2x. API_KEY=abcd1234efgh") == [("secret", "hunter2x"), ("secret", "abcd1234efgh")]
    assert spans(f"Bearer {key}, next") == [("secret", key)]
    assert spans("the token of our secret meeting = nothing; a password is needed") == []
    assert spans("12 Baker Street and Hauptstraße 5") == [("address", "12 Baker Street"), ("address", "Hauptstraße 5")]


def test_query_matches_patterns_on_nulls_and_long_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.cd " * 20000, "x"), (3, "a@b.cd " * 20000, "x"), (None, "1.2.3.4", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.base_sha256) for r in pii.digest(pii.find_personal_data(docs)).collect())
    want = []
    for doc, text, _ in rows:
        spans = brute(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((str(doc), sum(s[0] == "email" for s in spans), sum(s[0] == "ip" for s in spans), hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_added_kinds_respect_boundaries():
    machine = pii._automaton()
    kinds = lambda text: [(k, text[s:e]) for k, s, e in pii.find_spans(text, machine) if k not in pii.BASE]
    assert kinds("at 12 Old Mill Road now") == [("address", "12 Old Mill Road")]
    assert kinds("Hauptstraße 7b, true 5") == [("address", "Hauptstraße 7b")]
    assert kinds("account no") == [] and kinds("account: 12345678 x") == [("account", "12345678")]
    assert kinds("IBAN DE89370400440532013001") == []
    assert kinds("see ftp://h.example/a. b") == [("url", "ftp://h.example/a")]


def test_secrets_of_any_length_and_cues_of_any_case():
    machine = pii._automaton()
    value = "aB3" * 400
    for text in (f'token = "{value}"', f"Bearer {value}", f"Bearer {value}==", f"apiKey: {value}", f"Api_Key={value}", f"accessKey = {value}", f"PRIVATE-KEY={value}"):
        found = [(k, text[s:e]) for k, s, e in pii.find_spans(text, machine) if k == "secret"]
        assert [f[1].rstrip("=") for f in found] == [value], text[:20]
    assert pii.lowered("İAß\u2028Z") == "İaß\u2028z"
    assert [k for k, *_ in pii.find_spans("at 12 BAKER STREET, HAUPTSTRAßE 7", machine)] == ["address"] * 2
    long = "token=" + "x" * 2_000_000 + " token=" + "y" * 2_000_000
    assert pii.find_spans(long, machine) == []
