"""Token ids as Arrow stream files of equal-length sequences.

Documents in ascending id order are one long row of ids, each closed by an end id, cut into sequences of fixed length. A file
holds a range of documents: an Arrow IPC stream whose record batches have two fixed-size-list columns, ``ids`` (uint16 where the
vocabulary fits, else uint32) and ``mask`` (bits, lowest first, eight to a byte: 1 where a token stands, 0 where the last sequence is padded). All batches but the
last have the same number of rows, nothing is compressed and lists have no offsets, so a memory map gives sequence i of a file
without copying. A second stream beside it (``.docs.arrows``) names the documents: id, first token in the file, number of tokens.

Texts are encoded by the tokenizers library. White space parts them for good (the normalizer and the splitter of the vocabulary
see no further than a word), so each distinct word of a task is encoded once and texts are put together from words.

Texts are dealt out by ranges of (id, hash of the text), so one id with many rows is no single task. Files are of bounded size and
have names of their own attempt; what counts is the list of files that successful tasks return.

Defined results: null and empty texts are the end id alone; a null id stands first; repeated rows follow each other; an empty
table gives no file and an empty result; further columns are left alone.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, new_path, spread, table

LENGTH, ROWS, END_ID = 1024, 64, 1
#: Strings whose ids a worker remembers, the most characters of one, and bytes of text that it splits into words at once.
REMEMBERED, LONGEST, AT_ONCE = 400_000, 64, 1 << 23
#: Ids after which a part goes on in a new file.
FILE_IDS = 1 << 26
VOCABULARY = "word_bpe_49k.json"


#: A word's letters up to its first other character. Nothing in the vocabulary's rules reaches over that place if ASCII follows.
_PARTS = "(?s)^(?P<head>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)(?P<tail>.*)$"


class Pieces:
    """Ids of remembered strings in one flat array: string to number, and where its ids start and how many they are.

    When there are more than ``REMEMBERED`` strings, all are forgotten before the next are learned; long ones last for a call."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.empty(0, self.dtype), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def take(self, words: list[str], learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, sizes) of the ids of distinct words; ``learn`` gives (ids one after another, sizes) of the unknown ones."""
        if len(self.number) > REMEMBERED:
            self.forget()
        known = self.number
        at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        flat, starts, sizes = self.flat, self.starts, self.sizes
        if len(new):
            missing = [words[i] for i in new.tolist()]
            ids, n = learn(missing)
            begin = np.cumsum(n) - n
            at[new] = len(starts) + np.arange(len(new))
            flat, starts, sizes = np.concatenate([flat, ids]), np.concatenate([starts, len(flat) + begin]), np.concatenate([sizes, n])
            short = [i for i, w in enumerate(missing) if len(w) <= LONGEST]
            if len(short) == len(missing):
                self.flat, self.starts, self.sizes = flat, starts, sizes
                known.update(zip(missing, at[new].tolist(), strict=True))
            else:
                k = np.array(short, np.int64)
                first = len(self.starts)
                known.update((missing[i], first + j) for j, i in enumerate(short))
                kept = gather(ids, begin[k], n[k])
                self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n[k]) - n[k]])
                self.flat, self.sizes = np.concatenate([self.flat, kept]), np.concatenate([self.sizes, n[k]])
        return flat, starts[at], sizes[at]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of an array, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts, word by word: each distinct word of a call is encoded once, and ids are put together by position."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        rules = json.loads(self.tokenizer.to_str())
        #: Whether white space parts words for good and case does not count; other vocabularies get whole texts.
        self.by_word = rules["model"].get("end_of_word_suffix") == "</w>" and '"Lowercase"' in json.dumps(rules["normalizer"])
        self.heads, self.tails = Pieces(self.dtype), Pieces(self.dtype)
        #: A special token parts any words within one call; for runs of letters, the vocabulary's own word ends do.
        self.mark, self.mark_id = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special), (None, None))
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.dtype), *each]), np.array([len(x) for x in each], np.int64)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, the special token between them; words that hold that token themselves go alone."""
        if self.mark is None or any(self.mark in w for w in words):
            return self._whole(words)
        flat, sizes = [np.empty(0, self.dtype)], []
        for k in range(0, len(words), 256):
            ids = np.array(self.tokenizer.encode(self.mark.join(words[k : k + 256]), add_special_tokens=False).ids, self.dtype)
            marks = np.flatnonzero(ids == self.mark_id)
            flat.append(np.delete(ids, marks))
            sizes.append(np.diff(np.r_[-1, marks, len(ids)]) - 1)
        return np.concatenate(flat), np.concatenate(sizes) if sizes else np.empty(0, np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters, which are one word each to the vocabulary."""
        flat, sizes = [np.empty(0, self.dtype)], []
        for k in range(0, len(words), 1024):
            ids = np.array(self.tokenizer.encode(" ".join(words[k : k + 1024]), add_special_tokens=False).ids, self.dtype)
            flat.append(ids)
            sizes.append(np.diff(np.r_[0, np.flatnonzero(self.ends_word[ids]) + 1]))
        return np.concatenate(flat), np.concatenate(sizes) if sizes else np.empty(0, np.int64)

    def arrays(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each), ``end_id`` after each text if given."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        end = np.array([] if end_id is None else [end_id], self.dtype)
        if not self.by_word:
            flat, sizes = self._whole(texts.to_pylist())
            at = np.cumsum(sizes)
            return (np.insert(flat, at, end[0]) if len(end) else flat), sizes + len(end)
        listed = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = listed.offsets.to_numpy()
        coded = listed.flatten().dictionary_encode()
        flat, starts, sizes = self._word_ids(coded.dictionary)
        word = coded.indices.to_numpy()
        if len(end):  # one more word that every text ends with
            word = np.insert(word, offsets[1:] - offsets[0], len(starts))
            flat, starts, sizes = np.concatenate([flat, end]), np.append(starts, len(flat)), np.append(sizes, 1)
            offsets = offsets + np.arange(len(offsets))
        n = sizes[word]
        total = np.r_[0, np.cumsum(n)]
        at = offsets - offsets[0]
        return gather(flat, starts[word], n), total[at[1:]] - total[at[:-1]]

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, sizes) of distinct words: letters up to the first other character, and the rest.

        ASCII letters go in lower case, which the vocabulary reads them in; where a character beyond ASCII follows the letters,
        the word is not parted."""
        parts = pc.extract_regex(words, _PARTS)
        head, tail = parts.field("head"), parts.field("tail")
        whole = pc.match_substring_regex(tail, r"^[^\x00-\x7f]")
        if pc.any(whole).as_py():
            head, tail = pc.if_else(whole, "", head), pc.if_else(whole, words, tail)
        h, t = pc.ascii_lower(head).dictionary_encode(), tail.dictionary_encode()
        sides = [(side.indices.to_numpy(), pieces.take(side.dictionary.to_pylist(), learn)) for side, pieces, learn in ((h, self.heads, self._letters), (t, self.tails, self._marked))]
        (hi, (hf, hs, hn)), (ti, (tf, ts, tn)) = sides
        starts, sizes = np.empty(2 * len(words), np.int64), np.empty(2 * len(words), np.int64)
        starts[::2], starts[1::2], sizes[::2], sizes[1::2] = hs[hi], ts[ti] + len(hf), hn[hi], tn[ti]
        flat, n = gather(np.concatenate([hf, tf]), starts, sizes), sizes[::2] + sizes[1::2]
        return flat, np.cumsum(n) - n, n

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, without end ids."""
        flat, n = self.arrays(pa.array(texts, pa.string()))
        data, at = flat.tobytes(), (np.r_[0, np.cumsum(n)] * self.dtype.itemsize).tolist()
        return [data[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def slices(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, number of ids of each) of some texts after others, so many bytes at a time."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + AT_ONCE, "right")))
            yield low, *self.arrays(texts[low:high], end_id)
            low = high

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        return np.concatenate([np.empty(0, np.int64), *[n for _, _, n in self.slices(texts)]])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for a worker process, whatever tasks it runs."""
    return Encoder(path)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """One file: ids in, sequences of ``length`` out; and the stream of its documents beside it.

    Every attempt of a task has names of its own, so a repeated task overwrites nothing."""

    def __init__(self, folder: str, name: str, dtype, length: int, rows: int, id_type: pa.DataType):
        if length % 8:
            raise ValueError("the length is a multiple of 8")
        self.fs, path = _filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.file = f"{name}-{uuid.uuid4().hex[:8]}.arrows"
        self.dtype, self.length, self.rows = np.dtype(dtype), length, rows
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.docs_schema = pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{path}/{f}") for f in (self.file, documents_of(self.file))]
        self.stream, self.docs = (ipc.new_stream(sink, schema) for sink, schema in zip(self.sinks, (self.schema, self.docs_schema), strict=True))
        self.rest, self.n_docs, self.n_tokens = np.empty(0, self.dtype), 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents, their ids one after another and their numbers of ids."""
        first = self.n_tokens + np.cumsum(counts) - counts
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(first, pa.int64()), pa.array(counts, pa.int64())], schema=self.docs_schema))
        self.n_docs, self.n_tokens = self.n_docs + len(counts), self.n_tokens + len(ids)
        joined, whole = np.concatenate([self.rest, ids]), self.rows * self.length
        end = len(joined) - len(joined) % whole
        for k in range(0, end, whole):
            self._batch(joined[k : k + whole], whole)
        self.rest = joined[end:].copy()

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.packbits(np.arange(len(ids)) < n, bitorder="little")
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), size) for x, size in ((ids, self.length), (mask, self.length // 8))]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            full = np.zeros(-(-len(self.rest) // self.length) * self.length, self.dtype)
            full[: len(self.rest)] = self.rest
            self._batch(full, len(self.rest))
        for x in (self.stream, self.docs, *self.sinks):
            x.close()


def documents_of(file: str) -> str:
    """The name of the stream that names the documents of a file."""
    return file.removesuffix(".arrows") + ".docs.arrows"


class SequenceFile:
    """Random access to the sequences of one file, a batch at a time.

    All batches but the last have one size and nothing is compressed, so the place of a batch follows from its number. Local files
    are mapped and nothing is copied; of others, one batch is held."""

    def __init__(self, uri: str):
        system, path = _filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.schema = ipc.read_schema(self.source)
        self.length = self.schema.field("ids").type.list_size
        self.begin, self.end = self.source.tell(), self.source.size()
        self.held: tuple[int, pa.RecordBatch | None] = (-1, None)
        first = self._read(self.begin)
        self.rows, self.stride = (0, 1) if first is None else (len(first), self.source.tell() - self.begin)
        self.n_batches = 0 if first is None else -(-(self.end - 8 - self.begin) // self.stride)

    def _read(self, at: int) -> pa.RecordBatch | None:
        self.source.seek(at)
        try:
            message = ipc.read_message(self.source)
        except EOFError:
            return None
        return ipc.read_record_batch(message, self.schema)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.held[0] != k:
            self.held = k, self._read(self.begin + k * self.stride)
        return self.held[1]

    def __len__(self) -> int:
        return (self.n_batches - 1) * self.rows + len(self.batch(self.n_batches - 1)) if self.n_batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, packed mask) of sequence i, views of the file."""
        batch, row = self.batch(i // self.rows), i % self.rows
        return tuple(batch.column(c).values.to_numpy(zero_copy_only=True)[row * n : (row + 1) * n] for c, n in ((0, self.length), (1, self.length // 8)))

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the file's documents."""
        per, parts = self.rows * self.length, []
        while n > 0:
            flat = self.batch(start // per).column(0).values.to_numpy(zero_copy_only=True)
            part = flat[start % per : start % per + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _writer(folder: str, path: str, length: int, rows: int, end_id: int, most: int):
    """mapInArrow over rows (part, doc_id, text), sorted within each part; returns a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, seq, done = None, None, 0, []

        def closed() -> None:
            writer.close()
            done.append((part, seq, writer.file, writer.n_docs, writer.n_tokens))

        for batch in batches:
            coder, docs = encoder(path), batch.column("doc_id")
            parts = batch.column("part").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(parts)].tolist() if len(parts) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                for first, ids, counts in coder.slices(batch.column("text")[lo:hi], end_id):
                    if writer and (parts[lo] != part or writer.n_tokens >= most):
                        closed()
                        writer, seq = None, seq + 1 if parts[lo] == part else 0
                    if not writer:
                        part = int(parts[lo])
                        writer = Writer(folder, f"part-{part:06d}-{seq:04d}", coder.dtype, length, rows, docs.type)
                    writer.add(docs[lo + first : lo + first + len(counts)], ids, counts)
        if writer:
            closed()
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "file", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, length: int = LENGTH, rows: int = ROWS, end_id: int = END_ID, most: int = FILE_IDS) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder`` and return its files (part, seq, file, n_docs, n_tokens), a table of its own."""
    spark = docs.sparkSession
    key = F.xxhash64("text")
    ranged = docs.select("doc_id", "text", key.alias("_h")).repartitionByRange(spread(spark), "doc_id", "_h").withColumn("part", F.spark_partition_id())
    ordered = ranged.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "_h", "text").select("part", "doc_id", "text")
    files, _ = materialize(ordered.mapInArrow(_writer(folder, tokenizer, length, rows, end_id, most), "part int, seq int, file string, n_docs long, n_tokens long"), "token-files")
    return files


def _reader(folder: str):
    """mapInArrow over files with their offsets: their documents, all read from the files, a batch of documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                tokens = SequenceFile(f"{folder}/{file}")
                system, path = _filesystem(f"{folder}/{documents_of(file)}")
                with system.open_input_stream(path) as source:
                    for docs in ipc.open_stream(source):
                        first, n = docs.column("first").to_pylist(), docs.column("n_tokens").to_pylist()
                        sums = [zlib.crc32(tokens.ids(at, size).astype("<u4").tobytes()) for at, size in zip(first, n, strict=True)]
                        start = pa.array(np.array(first, np.int64) + offset)
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(files: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): ``start`` counts the ids of all documents before, over all files."""
    # a row a file, which has up to FILE_IDS ids: their sums are one small window
    before = F.sum("n_tokens").over(W.orderBy("part", "seq")) - F.col("n_tokens")
    placed = files.select("part", "seq", "file", before.alias("offset")).repartition(spread(files.sparkSession), "file")
    return placed.mapInArrow(_reader(folder), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-files")
    files = write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path(VOCABULARY))
    return read_tokens(files, folder)
