"""Edit-aware token counts: segment trees over pre-token segments; edits re-encode what they touch.

A document is cut into leaves at white space, every ``LEAF`` characters or at the first white space after, so that no token
reaches over a cut. A tree over the leaves holds sums of characters, to find the leaf of a position, and of tokens. Trees are kept
as a table of their leaves. An edit replaces a stretch of text: the leaves that it touches are encoded anew, together with the
leaf before where the edit took away the white space that parted them, and the sums above are updated; the rest is not read.

Defined results: null and empty text have one empty leaf; positions are code points and are held to the text; edits apply in order
of their start, and what an earlier one has replaced is not replaced again; documents without edits keep their counts; repeated
rows are counted one by one; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, table, where_once
from helixloom.llm.pii import KINDS, base_spans
from helixloom.llm.token_files import VOCABULARY, encoder

LEAF = 512
EDITS = "array<struct<start:int,stop:int,text:string>>"
_CUT = re.compile("[ \n]")


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of a text; all but the first start with white space."""
    out, at = [], 0
    while m := _CUT.search(text, at + max(leaf, 1)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class TokenTree:
    """Sums of characters and tokens over leaves, in two implicit binary trees."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n, self.size = len(chars), 1 << max(0, len(chars) - 1).bit_length()
        pad = [0] * (self.size - self.n)
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, position: int) -> tuple[int, int]:
        """(leaf, start of the leaf) that holds a position; the last leaf for the end of the text."""
        if position >= self.chars[1]:
            return self.n - 1, self.chars[1] - self.chars[self.size + self.n - 1]
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if position >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def update(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.size + leaf
        self.chars[k], self.tokens[k] = chars, tokens
        while k := k // 2:
            self._sum(k)

    def edit(self, text: str, edits: list[tuple[int, int, str]], count) -> tuple[int, int, int]:
        """Apply edits (start, stop, new text) to the tree of ``text``: (edits applied, leaves encoded, characters encoded)."""
        applied, regions = self.touched(text, edits)
        return applied, *self.settle(regions, [count(new) for _, _, new in regions])

    def settle(self, regions: list[tuple[int, int, str]], tokens: list[int]) -> tuple[int, int]:
        """Put the new texts of regions, with their numbers of tokens, in place of their leaves; the sums above follow."""
        for (low, high, new), n in zip(regions, tokens, strict=True):
            self.update(low, len(new), n)
            for k in range(low + 1, high + 1):
                self.update(k, 0, 0)
        return sum(h - low + 1 for low, h, _ in regions), sum(len(new) for _, _, new in regions)

    def touched(self, text: str, edits: list[tuple[int, int, str]]) -> tuple[int, list[tuple[int, int, str]]]:
        """(edits applied, regions): first leaf, last leaf and new text of what edits touch, boundary context with it."""
        done: list[list] = []  # regions: first leaf, last leaf, new text
        at, applied, end = 0, 0, len(text)
        for start, stop, new in sorted(edits, key=lambda e: (e[0], e[1])):
            start, stop = max(at, min(start, end)), min(max(start, stop), end)
            if stop < start or (start == stop and not new):
                continue
            (low, low_at), (high, high_at) = self.find(start), self.find(max(start, stop - 1))
            tail = text[stop : high_at + self.chars[self.size + high]]
            if done and done[-1][1] >= low:  # the last region's tail holds this edit
                region = done[-1]
                gone = region[3] - start
                region[2] = (region[2][:-gone] if gone else region[2]) + new + tail
                region[1], region[3] = max(region[1], high), high_at + self.chars[self.size + high]
            else:
                done.append([low, high, text[low_at:start] + new + tail, high_at + self.chars[self.size + high], low_at])
            at, applied = stop, applied + 1
        regions: list[list] = []
        for low, high, new, _, low_at in done:
            while low and new and new[0] not in " \n":  # boundary context to the left
                if regions and regions[-1][1] == low - 1:
                    before = regions.pop()
                    low, new, low_at = before[0], before[2] + new, before[3]
                else:
                    low -= 1
                    size = self.chars[self.size + low]
                    new, low_at = text[low_at - size : low_at] + new, low_at - size
            regions.append([low, high, new, low_at])
        return applied, [(low, high, new) for low, high, new, _ in regions]


def _counter(path: str):
    coder = encoder(path)
    return lambda text: len(coder.encode(text)) // coder.dtype.itemsize


def _grow(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = encoder(path)
            leaves = [cut(t.as_py() or "", leaf) for t in batch.column("text")]
            flat = [x for doc in leaves for x in doc]
            ends = pa.array(np.r_[0, np.cumsum([len(doc) for doc in leaves])], pa.int32())
            counts = (np.fromiter(map(len, flat), np.int64, len(flat)), coder.counts(pa.array(flat, pa.string())))
            chars, tokens = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), chars, tokens], ["doc_id", "k1", "k2", "leaf_chars", "leaf_tokens"])

    return run


def _edit(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder, work = encoder(path), []
            for text, edits, chars, tokens in zip(*(batch.column(c) for c in ("text", "edits", "leaf_chars", "leaf_tokens")), strict=True):
                tree = TokenTree(chars.as_py(), tokens.as_py())
                work.append((tree, *tree.touched(text.as_py() or "", [(e["start"], e["stop"], e["text"] or "") for e in edits.as_py()])))
            counts = iter(coder.counts(pa.array([new for _, _, regions in work for _, _, new in regions], pa.string())).tolist())
            out = []
            for tree, applied, regions in work:
                done = tree.settle(regions, [next(counts) for _ in regions])
                out.append((tree.total, applied, *done))
            columns = [pa.array([row[k] for row in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *columns], ["k1", "k2", "after", "edits", "leaves", "chars"])

    return run


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): texts are named by two hashes, so that trees and edits meet by content; equal texts share both."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"))


def trees(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, k1, k2, leaf_chars, leaf_tokens) of every row of ``docs`` (``named``), written."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, k1 long, k2 long, leaf_chars array<int>, leaf_tokens array<int>"
    return materialize(docs.mapInArrow(_grow(tokenizer, leaf), schema), "token-trees")[0]


def recount(grown: DataFrame, edited: DataFrame, tokenizer: str) -> DataFrame:
    """Counts before and after edits for every tree; ``edited``: (k1, k2, text, edits) of the texts that have edits.

    Only those texts and their trees meet, once for equal texts; the others' counts come from their trees alone."""
    one = grown.groupBy("k1", "k2").agg(F.any_value("leaf_chars").alias("leaf_chars"), F.any_value("leaf_tokens").alias("leaf_tokens"))
    touched = edited.dropDuplicates(["k1", "k2"]).join(one, ["k1", "k2"]).select("k1", "k2", "text", "edits", "leaf_chars", "leaf_tokens")
    after, _ = materialize(touched.mapInArrow(_edit(tokenizer), "k1 long, k2 long, after long, edits long, leaves long, chars long"), "token-edits")
    total = F.aggregate("leaf_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    zero = F.lit(0).cast("long")
    counted = grown.select("doc_id", "k1", "k2", total.alias("n_tokens"), F.size("leaf_tokens").cast("long").alias("n_leaves"))
    return counted.join(after, ["k1", "k2"], "left").select(
        "doc_id", "n_tokens", F.coalesce("after", "n_tokens").alias("n_tokens_after"), F.coalesce("edits", zero).alias("n_edits"), "n_leaves",
        F.coalesce("leaves", zero).alias("leaves_encoded"), F.coalesce("chars", zero).alias("chars_encoded"),
    )


def redaction_edits(docs: DataFrame) -> DataFrame:
    """(k1, k2, text, edits) of the documents with base spans of personal data: each span becomes its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    edits = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), F.get(names, s.kind).alias("text"))).cast(EDITS)
    return where_once(base_spans(docs.select("k1", "k2", "text")), F.size("base") > 0).select("k1", "k2", "text", edits.alias("edits"))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after the redaction of personal data."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    docs = named(table(spark, sf_dir, "documents", "doc_id", "text"))
    return recount(trees(docs, path), redaction_edits(docs), path)
