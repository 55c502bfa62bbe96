import hashlib
import re

from stratacat.llm import pii

from .cases import ROWS, documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def keep(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if keep(k, m[0])] for k, p in PLAIN.items()}


HARD = [
    "a@b.com_x@d.org", "x" * 2000 + " a@b", "@.@a.b@c.d.e@f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 5", "4111-1111-1111-1111,4111111111111111 0",
    "+1 (202) 555-0143+44 20 7946 0958 +12 +1((((", "9" * 5000, "\U0001f389 a@b.co \U0001f389 8.8.8.8", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "é.x@y.z-é", "a%+-@-.-",
]


def spans_of(rows):
    return [(r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in rows]


def run(spark, tmp_path, frame):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return pii.query(spark, str(tmp_path))


def test_base_spans_match_the_plain_patterns(spark, tmp_path):
    rows = ROWS + [(100 + i, t, "en", "x", 0) for i, t in enumerate(HARD)]
    got = sorted(map(repr, spans_of(run(spark, tmp_path, documents(spark, rows)).collect())))
    want = []
    for doc, text, *_ in rows:
        found = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in found[k])
        want.append(repr((doc, [len(found[k]) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest())))
    assert got == sorted(want)


def test_contexts_of_seeds_find_other_identifiers(spark, tmp_path):
    rows = [(i, f"please dial tel no +1 202 555 01{i:02d} today", "en", "x", 0) for i in range(12)] + [(50, "we dial tel no 202-555-0199 today", "en", "x", 0), (51, "see 202-555-0199", "en", "x", 0)]
    got = {r.doc_id: r.spans for r in run(spark, tmp_path, documents(spark, rows)).collect()}
    assert got[50] == "phone:15:27" and got[51] == ""


def test_secrets_come_from_their_contexts(spark, tmp_path):
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'word {i} token = "{secret(i)}" end', "en", "x", 0) for i in range(12)]
    rows += [(50, "then token = 'Zx9-kk27_Qp4413ab'!! end", "en", "x", 0), (51, "so Zx9-kk27_Qp4413ab over", "en", "x", 0), (52, f"digest {secret(99)} alone", "en", "x", 0)]
    got = {r.doc_id: r for r in run(spark, tmp_path, documents(spark, rows)).collect()}
    assert got[3].spans == "secret:16:56" and got[3].n_secret == 1 and got[3].personal and got[3].n_email == 0
    assert got[50].spans == "secret:14:31" and rows[12][1][14:31] == "Zx9-kk27_Qp4413ab"
    assert got[51].spans == got[52].spans == "" and not got[51].personal


def test_found_tokens_bring_new_patterns(spark):
    """Seeds speak for the first context only; numbers found there also stand in the second, which finds one more in a later round."""
    number = lambda i: f"202-555-01{i:02d}"
    rows = [(i, f"please dial +1 202 555 {i:04d}", "en", "x", 0) for i in range(400)]
    rows += [(1100 + i, f"please dial {number(i)}", "en", "x", 0) for i in range(12)] + [(1200 + i, f"reach me under {number(i)}", "en", "x", 0) for i in range(12)] + [(1300, "reach me under 202-555-0777", "en", "x", 0)]
    found = lambda rounds: {r.doc_id: [s.kind for s in r.pii_all] for r in pii.detect(documents(spark, rows), rounds=rounds).collect()}
    late, early = found(3), found(1)
    assert late[1105] == early[1105] == ["phone"]
    assert early[1300] == [] and late[1300] == ["phone"]


def test_right_contexts_and_runs_of_numbers(spark):
    rows = [(i, f"{c} +1 202 555 01{i:02d} (mobile) x", "en", "x", 0) for i, c in enumerate("abcdefghijklmnop")] + [(50, "zz 202 555 0199 (mobile) x", "en", "x", 0)]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.pii_all] for r in pii.detect(documents(spark, rows)).collect()}
    assert got[50] == [(3, 15, "phone")]


def test_many_tokens_and_seeds_in_one_text(spark):
    text = " ".join(f"u{i}@x.example.org 10.0.{i % 200}.{i % 7} tel 0{i:07d}" for i in range(4000))
    found = pii.detect(documents(spark, [(1, text, "en", "x", 0)])).collect()[0]
    assert (len(found.pii_email), len(found.pii_ip)) == (4000, 4000)


def test_overlapping_spans_are_replaced_together(spark):
    docs = documents(spark, [(1, "call +49 170 1234567.joe@x.com now", "en", "x", 1)])
    assert pii.redact(docs).first().text == "call <PHONE> now"


def test_redaction_and_empty_table(spark):
    docs = documents(spark, [(1, "mail a@b.example.com or 8.8.8.8!", "en", "x", 1), (2, None, "en", "x", None)])
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "mail <EMAIL> or <IP>!" and out[1].n_chars == len(out[1].text) and out[2].text is None
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.limit(0)).count() == 0
