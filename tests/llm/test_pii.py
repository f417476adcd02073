import hashlib
import random
import re

from kinspan.llm.pii import find_pii, op9_pii_spans, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return sorted(found)


FIXED = [
    None, "", "a@b.c a@b.co,x@y.z", "a@b.c%x@d.e", "@@a@b..c a@b.c@d.e a+b%c@x-y.z-1.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "é 4111 1111 1111 1111 é 4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (988) 555-2485 +12345 +1-2 ++1 234 567 8901",
    "日本 call +49 30 901820 now 192.168.0.1", "1" * 5000, "1 " * 4000, "a" * 20000 + "@", "a.b@" * 500, "+1" + "(" * 3000, "GB82 WEST 1234 5698 7654 32 iban DE89370400440532013000 DE89370400440532013001", "x" * 100 + " a@b.cd" * 50,
]


def texts(n=400):
    r = random.Random(9)
    parts = ["a", "b.c", "@", ".", "1", "12", "255", "300", " ", "-", "+", "(", ")", "4111111111111111", "é", "%", "x@y.zz", "1.2.3.4", "\n", "+1 234 567 8901"]
    return FIXED + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_plain_patterns(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in op9_pii_spans(spark, str(tmp_path)).collect()}
    for i, text in rows:
        spans = brute(text)
        told = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        row = found[i]
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (text, told, row.spans)
        for kind in BASE:
            assert row[f"n_{kind}"] == sum(s[3] == kind for s in spans)
        assert set(told.split(",")) - {""} <= set(row.spans.split(","))


def test_account_numbers_and_context(spark):
    docs = spark.createDataFrame([("my iban is DE89370400440532013000 ok",), ("DE89370400440532013001",), ("card 4111111111111111",), ("4111111111111111",)], "text string").selectExpr("*", "1 as doc_id", "'x' as pii_email")
    spans = [r.pii_spans for r in find_pii(docs).collect()]
    assert [(s.kind, s.start, s.stop) for s in spans[0] if s.kind == "iban"] == [("iban", 11, 33)] and not [s for s in spans[1] if s.kind == "iban"]
    assert spans[2][0].score > spans[3][0].score


def test_context_decides(spark):
    texts = ["my social security number 212-09-9999 here", "order 212-09-9999 shipped", "212-09-9999 (SSN)", "ssn 000-12-3456", "ssn 912-12-3456 ssn 212-00-1234 ssn 212-09-0000", "ssn 1212-09-9999", "x" * 60 + " ssn" + " y" * 40 + " 212-09-9999"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.stop) for s in r.pii_spans if s.kind == "ssn"] for r in find_pii(docs).collect()}
    assert found == {0: [(26, 37)], 1: [], 2: [(0, 11)], 3: [], 4: [], 5: [], 6: []}
    behind = find_pii(spark.createDataFrame([("4111111111111111 on my visa card",)], "text string")).first().pii_spans[0]
    assert behind.score == 0.9


def test_clashing_names_pass_unchanged(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd"), (1, "mail a@b.cd"), (None, "")], "doc_id long, text string").selectExpr("*", *[f"'kept' as {c}" for c in ("pii_email", "PII_spans", "pii_spans_", "pii_iban", "kind", "score")])
    out = redact(docs)
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    assert sorted(rows, key=str) == sorted([(1, "mail [EMAIL]", *["kept"] * 6)] * 2 + [(None, "", *["kept"] * 6)], key=str)


def test_query_on_an_empty_table_and_a_very_long_text(spark, tmp_path):
    rows = [(1, "word " * 300_000 + "a@b.cd")]
    for name, table in (("full", spark.createDataFrame(rows, "doc_id long, text string")), ("empty", spark.createDataFrame([], "doc_id long, text string"))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
    assert op9_pii_spans(spark, str(tmp_path / "full")).first().spans == "email:1500000:1500006"
    assert op9_pii_spans(spark, str(tmp_path / "empty")).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.cd or 1.2.3.4!"), (2, None), (3, "+1 234 567 8901 end"), (4, "clean")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in redact(docs).collect()}
    assert out == {1: "é mail [EMAIL] or [IP]!", 2: None, 3: "[PHONE] end", 4: "clean"}
    assert redact(docs.limit(0)).count() == 0


def brute_accounts(text):
    """Every start and every end at a border; a number of its country's length first, else the longest."""
    found, free = [], 0
    for m in re.finditer(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})", text):
        ends = []
        for stop in range(m.start() + 15, min(len(text), m.start() + 67) + 1):
            match = text[m.start() : stop]
            plain = match.replace(" ", "")
            if re.fullmatch(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", match) and not re.match("[A-Za-z0-9]", text[stop:]) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                ends.append((len(plain) != {"DE": 22, "GB": 22, "NO": 15}.get(plain[:2]), -stop))
        if ends and m.start() >= free:
            free = -min(ends)[1]
            found.append((m.start(), free))
    return found


def test_account_numbers_before_other_words(spark):
    known = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "NO93 8601 1117 947", "XX50" + "A1" * 15]
    after = [" Thanks", " OK", " 2024-01-01", " 7", "", ".", "x", "X", " GB82WEST12345698765432", " DE89370400440532013000 Thanks", " NO9386011117947 NO9386011117947", " A B C D E F G H I J K L", "\nA"]
    r = random.Random(4)
    texts = [b + n + a for n in known for a in after for b in ("", "é AB12 ", "To DE12 ", "x")]
    texts += ["".join(r.choice([*known, " ", "A", "12", "é", "DE89", "a"]) for _ in range(r.randint(1, 12))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: [(s.start, s.stop) for s in x.pii_spans if s.kind == "iban"] for x in find_pii(rows).collect()}
    for i, text in enumerate(texts):
        assert found[i] == brute_accounts(text), (text, found[i], brute_accounts(text))
    assert found[texts.index("DE89370400440532013000 OK")] == [(0, 22)] and found[texts.index("DE89370400440532013000 Thanks")] == [(0, 22)]
    assert found[texts.index("DE89370400440532013000 GB82WEST12345698765432")] == [(0, 22), (23, 45)]
    clean = redact(rows.where("text in ('DE89370400440532013000 Thanks', 'NO9386011117947 NO9386011117947 NO9386011117947')")).collect()
    assert all("01" not in x.text for x in clean)
