"""Token ids as Arrow files of equal-length sequences and masks.

``write_sequences`` range-partitions the documents by doc_id, encodes them, and lets every task stream its ids
into one Arrow file whose batches hold ``BATCH_ROWS`` rows of fixed-size lists:

* ``input_ids``: ``length`` ids, 16 bits each if the vocabulary allows, else 32;
* ``attention_mask``: bit set for ids, clear for the padding after a file's last id;
* ``document_end``: bit set for the last id of each document.

All batches but a file's last hold the same number of rows, so row ``i`` is found by division, and as nothing is
compressed a memory-mapped file gives its ids and bits without a copy (:class:`TokenFile`). Beside each file lies an index of
its documents (doc_id, start, n_tokens). The written rows of the returned manifest name the files; those of lost attempts are
in no manifest. Texts move once, by range; memory is one batch of rows whatever a partition holds.

Ids are those of the tokenizers library. A word, as the tokenizer splits texts, is encoded once and then looked up; a text with
characters outside a set for which the split is known to be the same goes through the library as a whole. That rule is
for tokenizers of the kind of ``word_bpe_49k.json`` (:class:`WordIds` checks it); others always take the library.

Defined cases: null is the empty text, the end id alone; null doc_ids come first; equal doc_ids are ordered by a hash of
the text, equal rows are written each; very long texts span batches; an empty table gives no files and an empty manifest; extra
columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusmap.llm.warc import _uri
from corpusmap.llm.words import buffer_of, row_slices
from corpusmap.sources.scratch import materialize, scratch_folder

LENGTH = 1024
BATCH_ROWS = 256
END_ID = 2
#: Words kept at hand by a worker, and those encoded as one text.
KNOWN_WORDS = 1_000_000
_JOINED = 500
#: Parts that are summed together.
_GROUP = 4096

# The split and the normalizers of the word tokenizer, and the characters for which it is followed here.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SIMPLE = [(0x09, 0x0D), (0x20, 0x7E), (0xA0, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E)]


def _class(kind: str) -> str:
    """Characters of a Unicode kind among the simple ones in lower case, for a regular expression."""
    chars = {c for a, b in _SIMPLE for c in "".join(map(chr, range(a, b + 1))).lower()}
    return "".join(re.escape(c) for c in sorted(chars) if unicodedata.category(c)[0] == kind)


_coders: dict = {}


class WordIds:
    """Ids of texts by a tokenizer file, as little-endian bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        top = max(told["model"]["vocab"].values(), default=0)
        self.kind = np.dtype("<u2" if max(top, END_ID) < 1 << 16 else "<u4")
        names = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_words = (
            names == _NORMALIZERS
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": _SPLIT}
            and not told.get("post_processor")
        )
        self.special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        simple = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _SIMPLE)
        self.other = re.compile(f"[^{simple}]")
        letters, numbers = _class("L"), _class("N")
        # The same choices as in the pattern: only an apostrophe can begin two of them.
        self.words = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \xa0{letters}{numbers}]+|[{numbers}]")
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, self.kind).tobytes() for e in self.coder.encode_batch(texts, add_special_tokens=False)
        ]

    def _learn(self, words: list[str]) -> None:
        """Encode words, which the tokenizer does not cut further, side by side."""
        found = self.coder.encode(" ".join(words), add_special_tokens=False)
        size = self.kind.itemsize
        raw, at = np.array(found.ids, self.kind).tobytes(), 0
        for word, end in zip(words, np.cumsum(np.bincount(found.word_ids, minlength=len(words))).tolist(), strict=True):
            self.known[word] = raw[at * size : end * size]
            at = end

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without an end id."""
        if not self.by_words:
            return self._encode(texts)
        out: list = [None if self._is_other(t) else self.words.findall(t.lower()) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            now = set().union(*(words for words in out if words))
            self.known = {w: self.known[w] for w in now.intersection(self.known)}
        get, gaps, new = self.known.get, {}, set()
        for i, words in enumerate(out):
            if words:
                out[i] = found = [*map(get, words)]
                if None in found:
                    gaps[i] = [(at, words[at]) for at, f in enumerate(found) if f is None]
                    new.update(w for _, w in gaps[i])
        words = list(new)
        for i in range(0, len(words), _JOINED):
            self._learn(words[i : i + _JOINED])
        for i, missing in gaps.items():
            for at, w in missing:
                out[i][at] = self.known[w]
        whole = iter(self._encode([t for t, found in zip(texts, out, strict=True) if found is None]))
        return [next(whole) if found is None else b"".join(found) for found in out]

    def _is_other(self, text: str) -> bool:
        return bool(self.other.search(text)) or any(s in text for s in self.special)


def coder(path: str) -> WordIds:
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path]


def tokenizer_path() -> str:
    """Vocabulary file of the public tokenizer that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _bits(values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.bool_(), len(values), [None, pa.py_buffer(np.packbits(values, bitorder="little"))])


class SequenceWriter:
    """One Arrow file of sequences, filled document by document, and its index."""

    def __init__(self, files: fs.FileSystem, name: str, kind: np.dtype, length: int):
        self.files, self.name, self.kind, self.length = files, name, kind, length
        self.schema = pa.schema(
            [
                pa.field("input_ids", pa.list_(pa.from_numpy_dtype(kind), length)),
                pa.field("attention_mask", pa.list_(pa.bool_(), length)),
                pa.field("document_end", pa.list_(pa.bool_(), length)),
            ]
        )
        self.sink = files.open_output_stream(f"{name}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.buffer, self.ends = bytearray(), []
        self.written = self.tokens = self.sequences = 0
        self.rows: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id: int | None, raw: bytes) -> None:
        n = len(raw) // self.kind.itemsize
        for column, v in zip(self.rows, (doc_id, self.tokens, n), strict=True):
            column.append(v)
        self.tokens += n
        self.buffer += raw
        self.ends.append(self.tokens - 1)
        full = BATCH_ROWS * self.length
        while self.tokens - self.written >= full:
            self._flush(full)

    def _flush(self, n: int) -> None:
        size = self.kind.itemsize
        rows = -(-n // self.length)
        ids = np.zeros(rows * self.length, self.kind)
        ids[:n] = np.frombuffer(self.buffer, self.kind, n)
        self.buffer = self.buffer[n * size :]
        mask, end = np.zeros(rows * self.length, bool), np.zeros(rows * self.length, bool)
        mask[:n] = True
        split = int(np.searchsorted(self.ends, self.written + n))
        end[np.array(self.ends[:split], np.int64) - self.written] = True
        self.ends = self.ends[split:]
        columns = [pa.array(ids), _bits(mask), _bits(end)]
        self.out.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns], schema=self.schema
            )
        )
        self.written += n
        self.sequences += rows

    def close(self) -> None:
        if self.tokens > self.written:
            self._flush(self.tokens - self.written)
        self.out.close()
        self.sink.close()
        index = pa.table(dict(zip(("doc_id", "start", "n_tokens"), (pa.array(c, pa.int64()) for c in self.rows), strict=True)))
        with self.files.open_output_stream(f"{self.name}.index") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index, 65_536)


class TokenFile:
    """Random access to the sequences of one file; of a local file without a copy."""

    def __init__(self, path: str):
        files, name = fs.FileSystem.from_uri(_uri(path))
        local = isinstance(files, fs.LocalFileSystem)
        self.source = pa.memory_map(f"{name}.arrow") if local else files.open_input_file(f"{name}.arrow")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self._files, self._name = files, name

    def ids(self, row: int) -> np.ndarray:
        """Ids of a sequence, a view of the file; ids after the mask's end are padding."""
        batch, at = divmod(row, BATCH_ROWS)
        values = self.reader.get_batch(batch).column(0).values
        return values.to_numpy(zero_copy_only=True)[at * self.length : (at + 1) * self.length]

    def mask(self, row: int, name: str = "attention_mask") -> pa.BooleanArray:
        """Bits of a sequence, a view of the file."""
        batch, at = divmod(row, BATCH_ROWS)
        column = self.reader.get_batch(batch).column(self.reader.schema.get_field_index(name))
        return column.values.slice(at * self.length, self.length)

    def index(self) -> Iterator[pa.RecordBatch]:
        with self._files.open_input_file(f"{self._name}.index") as source:
            reader = pa.ipc.open_file(source)
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)

    def flat(self) -> Iterator[np.ndarray]:
        """All ids in order, batch by batch, padding included."""
        for i in range(self.reader.num_record_batches):
            yield self.reader.get_batch(i).column(0).values.to_numpy()


def write_sequences(
    docs: DataFrame, path: str, folder: str | None = None, length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """Write the ids of (doc_id, text) in ascending doc_id order; the manifest, a row per file:
    part, path, documents, tokens, sequences, first_document, first_token, first_sequence."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, out = coder(path), None
        end = np.array([end_id], code.kind).tobytes()
        for batch in batches:
            if batch.num_rows and out is None:
                files, base = fs.FileSystem.from_uri(_uri(folder))
                files.create_dir(base, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                out = SequenceWriter(files, f"{base}/{name}", code.kind, length)
            for a, b in row_slices(buffer_of(batch.column("text"))[1]):
                piece = batch.slice(a, b - a)
                ids = code.ids(piece.column("text").to_pylist())
                for doc_id, raw in zip(piece.column("doc_id").to_pylist(), ids, strict=True):
                    out.add(doc_id, raw + end)
        if out is not None:
            out.close()
            row = {"part": part, "path": f"{folder}/{name}", "documents": len(out.rows[0])}
            row |= {"tokens": out.tokens, "sequences": out.sequences}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("path", pa.string()), *((c, pa.int64()) for c in ("documents", "tokens", "sequences"))]))

    text = F.coalesce("text", F.lit("")).alias("text")
    # Equal rows are told apart by their place, so that many of them do not fill one partition.
    rows = docs.select(F.col("doc_id").cast("long"), text, F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = materialize(
        ranged.mapInArrow(write, "part long, path string, documents long, tokens long, sequences long"), "manifest"
    )
    return _with_firsts(written)


def _with_firsts(files: DataFrame) -> DataFrame:
    """Running totals over the parts: within groups of parts, then over the groups."""
    counts = ("documents", "tokens", "sequences")
    grouped = files.withColumn("group", F.floor(F.col("part") / _GROUP))
    sums = grouped.groupBy("group").agg(*[F.sum(c).alias(f"group_{c}") for c in counts])
    # One row for every 4,096 files.
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("group", *[F.coalesce(F.sum(f"group_{c}").over(before), F.lit(0)).alias(f"base_{c}") for c in counts])
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    names = dict(zip(counts, ("first_document", "first_token", "first_sequence"), strict=True))
    return grouped.join(bases, "group").select(
        *files.columns,
        *[(F.col(f"base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(names[c]) for c in counts],
    )


def read_documents(manifest: DataFrame) -> DataFrame:
    """Each document as the files hold it: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                file = TokenFile(path)
                ids, held, at = file.flat(), np.zeros(0, np.uint16), 0
                for index in file.index():
                    sums = []
                    for n in index.column("n_tokens").to_pylist():
                        total = 0
                        while n:
                            if at == len(held):
                                held, at = next(ids), 0
                            take = min(n, len(held) - at)
                            total = zlib.crc32(held[at : at + take].astype("<u4"), total)
                            at, n = at + take, n - take
                        sums.append(total)
                    starts = pa.array(index.column("start").to_numpy() + first, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [index.column("doc_id"), starts, index.column("n_tokens"), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    files = manifest.select("path", "first_token")
    return files.repartition(min(n, 100_000), "path").mapInArrow(read, schema)
