"""Token files: whole-text encoding by the library, layout, zero-copy access and the round trip."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from helixloom.llm import token_files as X
from helixloom.llm.common import new_path
from tokenizers import Tokenizer

PATH = public_tokenizers.path(X.VOCABULARY)


def whole(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    texts = ["", None, " ", "It's we'll ' s x's", "Á é é ́x ﬁ Σας ΣΑΣ a b　c", "<|endoftext|> a<|startoftext|>b <|end oftext|>", "tab\tnl\r\n\x0b\x0c\x1c\x85z", "１２ 12½ 한국어 힤 日本 🙂👍🏽", "a" * 5000, "İ ͅ ǅ", "e\u0301x n\u0303 don't I'll x'y a.b,c!! é1é Äß's z\u00b5 \u00aa"]
    encoder = X.Encoder(PATH)
    for limit, longest in ((10**6, 64), (3, 2)):
        monkeypatch.setattr(X, "REMEMBERED", limit)
        monkeypatch.setattr(X, "LONGEST", longest)
        for t, ids in zip(texts, whole(texts), strict=True):
            assert np.frombuffer(encoder.encode(t), encoder.dtype).tolist() == ids
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode_all(texts)] == whole(texts)
    for size in (1 << 20, 40):
        monkeypatch.setattr(X, "AT_ONCE", size)
        ids = [i for _, flat, _ in encoder.slices(pa.array(texts), 7) for i in flat.tolist()]
        assert ids == [i for t in whole(texts) for i in (*t, 7)]
        assert encoder.counts(pa.array(texts)[2:]).tolist() == [len(t) for t in whole(texts)][2:]


def test_other_vocabularies_get_whole_texts():
    path, text = public_tokenizers.path("byte_bpe_50k.json"), "Some  text\nwith  Spaces "
    coder = X.Encoder(path)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert not coder.by_word and np.frombuffer(coder.encode(text), coder.dtype).tolist() == want


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want, at = {}, 0
    for (d, _), ids in zip(docs, whole([t for _, t in docs]), strict=True):
        ids = [*ids, 1]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in X.op7_token_files(spark, sf).collect()} == want


def test_files_and_edges(spark):
    rows = [(4, "d " * 700, 1), (4, "e", 2), (4, "e", 3), (None, "first", 4), (9, None, 5), (8, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    folder = new_path(spark, "test-files")
    files = X.write_tokens(df, folder, PATH, length=16, rows=4)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in X.read_tokens(files, folder).collect())
    assert [g[1] for g in got] == [None, 4, 4, 4, 8, 9] and [g[2] for g in got][-2:] == [1, 1]
    assert got[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))
    ids = np.concatenate([np.array([*e, 1]) for e in whole(["first", *[t for _, t in sorted(((sum(map(ord, r[1])), r[1]) for r in rows[:3]))]])])
    held = 0
    for name in {r.file for r in files.collect()}:
        f = X.SequenceFile(f"{folder}/{name}")
        for i in range(len(f)):
            tokens, mask = f[i]
            assert len(tokens) == 8 * len(mask) == 16 and not tokens.flags.owndata and not mask.flags.owndata
            held += int(np.unpackbits(mask).sum())
    assert held == sum(g[2] for g in got) and len(ids) < held
    small = new_path(spark, "test-small-files")
    files = X.write_tokens(df, small, PATH, length=16, rows=4, most=1)
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in X.read_tokens(files, small).collect()) == got
    assert X.read_tokens(X.write_tokens(df.limit(0), folder, PATH), folder).count() == 0
