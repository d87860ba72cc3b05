import hashlib
import re

from pyspark.sql import functions as F

from llm_helpers import SMALL, rows_of
from rollbook.llm import pii, queries

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base(text):
    """kind:start:end of every base span, by plain regular expressions."""
    out = []
    for n, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x[-9:]) > 255 or len(x.lstrip("0")) > 3 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def check(found, texts):
    digest = pii.digest(F.concat(*pii.PATTERNS)).alias("d")
    assert sorted(r.d for r in found.select(digest).collect()) == sorted(",".join(base(t)) for t in texts)


def test_query_against_plain_expressions(spark):
    texts = dict(rows_of(SMALL, columns="doc_id, text"))
    rows = queries.op1_pii(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        counts = [sum(s.startswith(k + ":") for s in spans) for k in KINDS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == spans


TRICKY = [
    "a@b.c_d@e.f", "a@b.c@d.e", "@a.b x@y x@y. x@y.z.", "..%+-@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.04 000001.2.3.4 1.2.3.4.", "4111 1111-1111 1111", "4111  1111 1111 1111",
    "41111111111111111111111111", "4111111111111111 4111111111111111", "+1 (555) 010-9999", "+1", "+12345678901234567", "++1 2345678901 +", "+1(((((((2345678901)", "5 a@b.co 4111111111111111",
    "é你😀 a@b.co 10.0.0.1", "9" * 3000, "a." * 3000 + "@b.c", "x@" + "a." * 3000, "+1" + "(" * 3000, "1.1.1.1" * 500, "\x00a@b.co\x00"]


def test_tricky_texts(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    check(pii.find(frame), TRICKY)


def test_odd_rows(odd, empty):
    check(pii.find(odd), [r.text for r in odd.select("text").collect()])
    assert pii.find(empty).count() == 0
    found = pii.find(odd)
    clean = pii.sanitise(odd, found)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert "<email>" in clean.where("doc_id = 9").first().text


def test_terms_that_give_an_entity_away(spark):
    """"zorblax" stands with one address only, in two surroundings; "common"
    is everywhere; "copied" only in copies of one passage."""
    texts = ["the zorblax person is bob@x.org common word", "write to zorblax at bob@x.org common thing", *["common filler words number %d" % i for i in range(60)],
             *["copied passage eve@x.org and common"] * 5, "eve@x.org again, common"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(frame)
    spans = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.term] for r in found.collect()}
    assert {t for ts in spans.values() for t in ts} == {"zorblax"}
    assert spans[0] == ["zorblax"] and spans[1] == ["zorblax"]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame, found).collect()}
    assert clean[0] == "the <term> person is <email> common word"
    assert clean[2] == texts[2]


def test_terms_are_found_in_every_document(spark):
    """Also in documents without the entity, and far from it in those with it."""
    texts = ["the zorblax person is bob@x.org common word", "write to zorblax at bob@x.org common thing\n" + "much more text " * 20 + "(Zorblax)",
             *["common filler words number %d" % i for i in range(60)], "é😀 yes,  it was Zorblax, not zorblaxes", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(frame)
    spans = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.term] for r in found.collect() if r.term}
    assert spans == {0: ["zorblax"], 1: ["zorblax", "Zorblax"], 62: ["Zorblax"]}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame, found).collect()}
    assert clean[62] == "é😀 yes,  it was <word>, not zorblaxes"
    assert clean[1].endswith("text (<word>)")
