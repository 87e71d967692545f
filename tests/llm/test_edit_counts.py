"""Edited trees against encoding the edited text as a whole."""

import random

import public_tokenizers
from helixloom.llm import edit_counts as X
from helixloom.llm.token_files import VOCABULARY
from test_pii import plain_spans
from tokenizers import Tokenizer

PATH = public_tokenizers.path(VOCABULARY)
WHOLE = Tokenizer.from_file(PATH)


def n_whole(text):
    return len(WHOLE.encode(text, add_special_tokens=False).ids)


def plain_edit(text, edits):
    out, at = [], 0
    for start, stop, new in sorted(edits, key=lambda e: (e[0], e[1])):
        start, stop = max(at, min(start, len(text))), min(max(start, stop), len(text))
        if stop < start or (start == stop and not new):
            continue
        out += [text[at:start], new]
        at = stop
    return "".join(out) + text[at:]


def test_trees_after_random_edits():
    rng, count = random.Random(4), X._counter(PATH)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "c'", "s ", "\n", " ", "é1", "<|", "x y z "]) for _ in range(rng.randrange(60)))
        leaves = X.cut(text, rng.choice([1, 4, 16]))
        assert "".join(leaves) == text
        tree = X.TokenTree([len(x) for x in leaves], [count(x) for x in leaves])
        assert tree.total == n_whole(text)
        edits = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(len(text) + 2)
            edits.append((a, a + rng.choice([0, 1, 2, 9]), rng.choice(["", "x", " ", "new words", "'s"])))
        tree.edit(text, edits, count)
        want = plain_edit(text, edits)
        assert (tree.total, tree.chars[1]) == (n_whole(want), len(want))


def test_little_is_encoded_again():
    text, count = "some words " * 5000, X._counter(PATH)
    leaves = X.cut(text)
    tree = X.TokenTree([len(x) for x in leaves], [count(x) for x in leaves])
    assert tree.edit(text, [(30000, 30004, "others")], count)[2] < 3 * X.LEAF
    assert tree.total == n_whole(text[:30000] + "others" + text[30004:])


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = X.op9_edit_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        spans = [s.split(":") for s in plain_spans(text).split(",") if s]
        want = plain_edit(text, [(int(a), int(b), f"[{k.upper()}]") for k, a, b in spans])
        assert (r.n_tokens, r.n_tokens_after) == (n_whole(text), n_whole(want))
        assert (r.n_edits > 0) == bool(spans) == (r.chars_encoded > 0)


def test_edges(spark):
    df = X.named(spark.createDataFrame([(1, None, 0), (1, "", 1), (None, "a b", 2), (2, "x a@b.cd y", 3), (2, "x a@b.cd y", 3)], "doc_id long, text string, edits long"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_edits) for r in X.recount(X.trees(df, PATH), X.redaction_edits(df), PATH).collect())
    assert [g[::2] for g in got] == [(0, 0), (1, 0), (1, 0), (2, 1), (2, 1)]
    assert X.recount(X.trees(df.limit(0), PATH), X.redaction_edits(df.limit(0)), PATH).count() == 0
