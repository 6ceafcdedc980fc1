"""Personal data against a plain version with Python's regular expressions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex

from samples import make_docs, odd_rows, texts
from voltrail.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(t - 9 if t > 9 else t for t in twice) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def expected(text):
    found = base(text)
    spans = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    return tuple(sum(f[0] == k for f in found) for k in KINDS) + (hashlib.sha256(spans.encode()).hexdigest(), spans)


HARD = [
    "a@b.c_d@e.f x@y.z.@q.r", "mail me@at.example.com, or me@at.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 5--1234 4111111111111111x378282246310005",
    "+49 (30) 123.456-78 +1 2 +12345678901234567 ++49 30 1234567-", "größer: ü@x.de é1.2.3.4 😀 a@b.cd 😀 +49 30 1234567",
    "a" * 30_000 + " " + "1" * 30_000 + "." * 20 + "@x.y", "x@y" + ".z" * 20_000, "1 " * 20_000, "+1" + " " * 5_000 + "+2",
    "me@x.y " * 3_000, "@@@..", "1.1.1.1" * 50,
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(HARD + texts(5))] + odd_rows(100)
    got = pii.personal_data_digests(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    have = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got)
    assert have == sorted((str(i), *expected(t)[:5]) for i, t in rows)
    plain = {str(i): expected(t)[5] for i, t in rows}
    for r in got:
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("term")) == plain[str(r["doc_id"])]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = {r["doc_id"]: expected(r["text"]) for r in docs.collect()}
    for r in pii.personal_data_digests(docs).collect():
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == plain[r["doc_id"]][:5]


def test_terms_that_disclose(spark):
    """A word that stands only by one address discloses it; one that stands everywhere does not."""
    rows = [(i, f"the Zanzibar office of anna@corp.example answers the mail {t}") for i, t in enumerate(texts(4))]
    rows += [(10 + i, f"the office answers the mail {t}") for i, t in enumerate(texts(40, 9))]
    docs = make_docs(spark, rows)
    found = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_data_digests(docs).collect()}
    text = rows[0][1]
    at = text.index("Zanzibar")
    assert f"term:{at}:{at + 8}" in found[0] and f"email:{text.index('anna')}:{text.index(' answers')}" in found[0]
    assert not any(s.startswith(f"term:{text.index('answers')}:") for s in found[0])
    assert found[10] == [""]
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs).collect()}
    assert clean[0].startswith("the  office of [EMAIL] answers the mail") and clean[10] == rows[4][1]
    softer = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs, remove=2.0).collect()}
    assert softer[0].startswith("the [TERM] office of [EMAIL]")


def test_main_path_has_no_python(spark):
    plan = pii.base_spans(make_docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert pii.personal_data_digests(make_docs(spark, [])).count() == 0


def test_terms_far_away_and_elsewhere(spark):
    """A telling word is taken out at any distance, wherever it stands, quoted, hyphenated or with a digit."""
    far = "the mail " * 60
    rows = [(i, f'"Zanzibar" {far} (north-west) {far} anna@corp.example {far} Zanzibar R2D2 {t}') for i, t in enumerate(texts(4))]
    rows += [(5, f"Zanzibar {far}")] + [(10 + i, f"{far} {t}") for i, t in enumerate(texts(60, 9))]
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(make_docs(spark, rows)).collect()}
    assert not any(w in clean[i] for i in range(4) for w in ("Zanzibar", "north-west", "R2D2", "anna"))
    assert "Zanzibar" not in clean[5] and clean[5].strip() == far.strip()
    assert clean[10].startswith(far)


def mask(text):
    for kind, pattern in KINDS.items():
        text = re.sub(pattern, lambda m: pii.MASK * len(m.group()) if valid(kind, m.group()) else m.group(), text)
    return text


def plain_terms(rows, min_docs, generalise):
    """The term spans of each row: every text against every entity."""
    texts_ = [t or "" for _, t in rows]
    words = [[(m.group().lower(), m.start(), m.end()) for m in regex.finditer(pii.TERM, mask(t))] for t in texts_]
    entities = []
    for t in texts_:
        own = [(k, t[s:e]) for k, s, e in base(t)]
        entities.append({f"{k}:{m.lower() if k == 'email' else m if k == 'ip' else re.sub('[^0-9]', '', m)}" for k, m in own})
    n, holds = len(rows), Counter(w for own in words for w in {x[0] for x in own})
    with_entity, together = Counter(e for own in entities for e in own), defaultdict(int)
    for own, terms in zip(entities, words):
        for e in own:
            for w in {x[0] for x in terms}:
                together[e, w] += 1
    telling = set()
    for (e, w), both in together.items():
        if both >= min_docs and min_docs <= with_entity[e] < n:
            if math.log2(n * both / (with_entity[e] * holds[w])) / math.log2(n / with_entity[e]) >= generalise - 1e-12:
                telling.add(w)
    return [",".join(f"term:{s}:{e}" for w, s, e in own if w in telling) for own in words], telling


def test_terms_equal_a_plain_search(spark):
    """Entities of every kind in some texts, terms that touch spans, repeated texts, and odd rows."""
    names = ["anna@corp.example", "10.0.0.7", "4111 1111 1111 1111", "+49 30 1234567"]
    rows = [(i, f"{t} {names[i % 4]} Codeword{i % 4}, (x{names[i % 4]}y) 1234567890123x {names[(i + 1) % 4] if i % 8 == 0 else ''}")
            for i, t in enumerate(texts(24, 2))]
    rows += [(40 + i, t) for i, t in enumerate(texts(60, 9))] + [(200 + i, rows[3][1]) for i in range(3)]
    rows += [(300, "Codeword1 alone"), (301, "codeword2.codeword3 Codeword2!")] + odd_rows(400)
    for least, share in ((3, 0.5), (2, 0.2)):
        want, telling = plain_terms(rows, least, share)
        got = pii.find_personal_data(make_docs(spark, rows), least, share).collect()
        have = sorted((str(r["doc_id"]), ",".join(x for x in r["spans"].split(",") if x.startswith("term"))) for r in got)
        assert telling and have == sorted((str(i), w) for (i, _), w in zip(rows, want))


def test_nothing_more_is_run_without_frequent_entities(spark, monkeypatch):
    monkeypatch.setattr(pii, "masked", None)
    docs = make_docs(spark, [(1, "anna@corp.example wrote"), (2, "bob@corp.example wrote"), (3, "nothing")])
    assert {r["spans"] for r in pii.personal_data_digests(docs).collect()} == {"email:0:17", "email:0:16", ""}
