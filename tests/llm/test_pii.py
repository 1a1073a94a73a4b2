"""Against a plain version with Python's re."""

import hashlib
import re

from granary.llm import pii, queries

P = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return True


def plain(text):
    return [(k, m.start(), m.end()) for k in P for m in re.finditer(P[k], text or "") if ok(k, m[0])]


HARD = [
    None, "", "x", "a@b.c+d@e.f", "a@b.c@d.e", "é@a.b 😀 me@x-y.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111",
    "4111-1111-1111-1111 4111111111111112", "+1 (555) 123-4567 +12 +1234567890123456", "iban GB82 WEST 1234 5698 7654 32 x GB83WEST12345698765432",
    "ssn 123-45-6789 and 123-45-6789", "9 " * 30000, "a" * 60000, "a@b.c " * 3000, "1.2.3.4 " * 3000 + "4111111111111111", "@" * 50, "+" * 50 + "123456789012",
]


def test_hard_texts(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(HARD)], "doc_id long, text string, _email string, gap string")
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.pii if x.kind in pii.BASE] for r in pii.find_pii(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(HARD)}
    more = {r.doc_id: [(x.kind, x.score) for x in r.pii if x.kind not in pii.BASE] for r in pii.find_pii(df).collect()}
    assert [k for k, _ in more[10]] == ["iban"] and [k for k, _ in more[11]] == ["ssn", "ssn"]
    assert pii.find_pii(df.filter("false")).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(1, "mail a@b.co, ip 1.2.3.4!"), (2, None), (3, "ü +1 555 123 4567")], "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["mail <EMAIL>, ip <IP>!", None, "ü <PHONE>"]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op10_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in P)


IBANS = [
    "IBAN {ES91 2100 0418 4502 0005 1332} BIC CAIXESBB", "{BE71 0961 2345 6769} AND", "{AT61 1904 3002 3457 3201} BANK", "ES91 2100 0418 4502 0005 1333 X", "{ES9121000418450200051332} 12",
    "ref AB12 {BE71 0961 2345 6769}", "ES12 {ES91 2100 0418 4502 0005 1332} {GB82 WEST 1234 5698 7654 32} A", "{MT84 MALT 0110 0001 2345 MTLC AST0 01S} X {NO93 8601 1117 947} {DE89 3704 0044 0532 0130 00} EUR",
    "ssn {123-45-6789}, {223-45-6789}, {323-45-6789}" + " none" * 12 + " 523-45-6789", "SSN " + " ".join(["{123-45-6789}"] * 3), "{BE71 0961 2345 6769} " * 700,
]


def test_what_follows_or_precedes_hides_nothing(spark):
    plainly = [t.replace("{", "").replace("}", "") for t in IBANS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(plainly)], "doc_id long, text string")
    spans = {r.doc_id: [(x.start, x.end) for x in r.pii if x.kind in ("iban", "ssn")] for r in pii.find_pii(df).collect()}
    want = {i: [(m.start() - 2 * k, m.end() - 2 * k - 2) for k, m in enumerate(re.finditer(r"\{[^}]*\}", t))] for i, t in enumerate(IBANS)}
    assert spans == want
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[0] == "IBAN <IBAN> BIC CAIXESBB" and out[1] == "<IBAN> AND" and out[9] == "SSN <SSN> <SSN> <SSN>"


def test_context_goes_on_over_blocks(spark):
    far = "523-45-6789 " * (pii.BLOCK - 2)
    df = spark.createDataFrame([(1, far + "ssn 123-45-6789 " + "123-45-6789 " * 5)], "doc_id long, text string")
    # The word is within 40 characters of four before it (the first ends 37 ahead of it) and the first four behind, of which two are in the next block.
    assert [x.start - len(far) for x in pii.find_pii(df).first().pii] == [-48, -36, -24, -12, 4, 16, 28, 40]


def test_whole_words_on_both_sides(spark):
    cases = {
        "123-45-6789 is my social security number": 1, "syntax 123-45-6789": 0, "123-45-6789 syntax": 0, "taxi 123-45-6789": 0, "tax 123-45-6789": 1, "Taxes? TAX: 123-45-6789": 1, "x" * 9 + " syntax" + "-" * 37 + " 123-45-6789": 0,
        "tax" + "." * 37 + "123-45-6789": 1, "tax" + "." * 38 + "123-45-6789": 0, "123-45-6789" + "." * 37 + "taxi": 0, "123-45-6789" + "." * 37 + "tax": 1, "123-45-6789" + "." * 38 + "tax": 0, "no words at all 123-45-6789": 0, "ssn123-45-6789": 1,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: sum(x.kind == "ssn" for x in r.pii) for r in pii.find_pii(df).collect()}
    assert got == dict(enumerate(cases.values()))
    mail = pii.find_pii(spark.createDataFrame([(1, "a@b.co"), (2, "my email a@b.co"), (3, "a@b.co, mail me"), (4, "blackmail a@b.co")], "doc_id long, text string"))
    assert [round(r.pii[0].score, 3) for r in mail.orderBy("doc_id").collect()] == [0.8, 1.0, 1.0, 0.8]


def test_redact_many_spans(spark):
    text = "".join(f"a{i}@b.co é 1.2.3.{i % 300} " for i in range(1500)) + "end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = sorted((x.start, x.end, x.kind) for x in pii.find_pii(df).first().pii)
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    assert len(spans) > 2000 and pii.redact(df).first().text == out + text[at:]
