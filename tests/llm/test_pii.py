"""Personal data against a plain Python version of the base rules, and contexts that reveal unseen identifiers."""

import hashlib
import re

from helixloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _ok(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    if kind == "phone":
        return 10 <= len(d) <= 15
    return True


def plain_spans(text):
    out = []
    for k, (kind, expression) in enumerate(PLAIN.items()):
        out += [(m.start(), k, m.end()) for m in re.finditer(expression, text or "") if _ok(kind, m[0])]
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(out))


TEXTS = [
    None, "", "a@b.c@d.e a@b.co_x@d.e x@y @a.b", "1.2.3.4.5 001.2.3.255 1.2.3.256 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (348) 555-9642 +1", "\U0001f600 é me@x.org \U0001f600 10.0.0.1", "9" * 3000, "a" * 50000, "a." * 5000 + "@b.c", "+" * 2000 + "1 2",
    "1.1.1.1\n2.2.2.2", "x" * 30 + "@" + "a." * 3000 + "b", "+1 4111111111111111",
]


def test_base_spans_equal_plain_rules(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.base_spans(df).select("doc_id", pii.written("base").alias("s")).collect()}
    assert got == {k: plain_spans(t) for k, t in enumerate(TEXTS)}


def test_query_equals_plain_rules_on_the_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op8_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in PLAIN]


def test_contexts_reveal_unseen_identifiers(spark):
    rows = [(k, f"word reach-me-at user{k}@host{k}.org now") for k in range(20)]
    rows += [(100, "then reach-me-at jo_at_host9 now"), (101, "later jo_at_host9 was 7 here"), (102, "nothing but version 3 here"), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.detect(df).select("_row.doc_id", pii.written("spans")).collect()}
    assert got[100] == "email:17:28"
    assert got[101] == "email:6:17"  # the value is known now, whatever stands around it
    assert got[102] == got[103] == ""


def test_redacted_keeps_columns_and_overlaps_merge(spark):
    df = spark.createDataFrame([(1, "card 4111111111111111 or a@1.2.3.4 and b", 5), (1, None, 6), (None, "plain", 7)], "doc_id long, text string, spans int")
    got = sorted((r.spans, r.doc_id, r.text) for r in pii.redacted(df).collect())
    assert got == [(5, 1, "card [CARD] or [EMAIL] and b"), (6, 1, None), (7, None, "plain")]


def test_empty_table(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text_and_clashing_names(spark):
    text = "7 and " * 40_000 + "me@x.org 10.0.0.1 " * 3_000
    rows = [(1, text, 5, "a", "b"), (2, None, None, None, None), (3, "me@x.org", 1, "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int, runs string, k1 string")
    got = {r[0]: r[1] for r in pii.detect(df, ("doc_id", "base", "runs", "k1")).select("_row.doc_id", pii.written("spans")).collect()}
    assert got[1] == plain_spans(text) and got[2] == "" and got[3] == "email:0:8"
    clean = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert clean[1].text == "7 and " * 40_000 + "[EMAIL] [IP] " * 3_000 and (clean[1].base, clean[1].runs, clean[1].k1) == (5, "a", "b")


def test_secrets_by_context_but_no_chance_or_refuted_values(spark):
    secret = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'word{k} token = "{secret(k)}" word{k + 1} now') for k in range(30)]
    rows += [(50, f'ANY TOKEN = "{secret(50).upper()}"!! now'), (51, "the digest 0123456789abcdef0123 stays"), (52, "token of 2024 stays"), (53, 'commit "0123456789abcdef0124"')]
    rows += [(100 + k, f"pay with card number 41111111111111{k:02d} today") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.detect(df).select("_row.doc_id", pii.written("spans")).collect()}
    assert all(got[k] == f"secret:{14 + len(str(k))}:{54 + len(str(k))}" for k in range(30)) and got[50] == "secret:13:53"
    assert got[51] == got[52] == got[53] == ""
    # numbers that fail the test stay out, though their context is that of cards
    assert all(got[d] == plain_spans(t) for d, t in rows if d >= 100) and sum(got[d] != "" for d, _ in rows if d >= 100) == 6


def test_held_out_seeds_are_found_again(spark, sf):
    rows = [(k, f"write to user{k}@host{k}.org soon") for k in range(200)] + [(300 + k, f"call +1 (212) 555-{1000 + k} please") for k in range(200)]
    got = {r.kind: r for r in pii.held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["email"].hidden > 9 and got["email"].found == got["email"].hidden and got["phone"].found == got["phone"].hidden > 9
    assert got["email"].wrong == got["phone"].wrong == 0
    pii.held_out(spark.read.parquet(f"{sf}/documents.parquet")).collect()
