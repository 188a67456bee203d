"""Token ids of a corpus in Simple-8b files, in the order of document ids.

Documents are range-partitioned by id; each task encodes its texts and streams the ids into one
file of the shared folder. The manifest, one row for each file, says which files count: a file
that a lost or repeated task left behind is in no manifest. Files are read back task by task.
"""

from __future__ import annotations

import itertools
import json
import os
import string
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import in_worker, new_folder, portions, qualified, save, shuffle_partitions, small_batches
from lamina.llm.simple8b import Reader, Writer

#: Bytes of text that are encoded at once, and different chunks that a worker remembers.
TEXT_BYTES, CHUNKS = 2 << 20, 500_000
MANIFEST = "part int, path string, bytes long, n_docs long, n_ids long, n_null long"
#: What stands for a null id inside a file; the manifest counts them, and they come first.
NO_ID = -(2**63)


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer in this file ignores white space and never joins what it parts, so
    that a text's ids are those of its chunks in turn."""
    spec = json.load(open(path))
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    cut = steps[0]
    words = (cut.get("pattern") or {}).get("Regex", "")
    alternatives = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
    kinds = {x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])}
    plain = not any(x["lstrip"] or x["rstrip"] or x["normalized"] or any(c.isspace() for c in x["content"]) for x in spec.get("added_tokens", []))
    return plain and kinds <= {"NFC", "Replace", "Lowercase"} and cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") is True and set(words.split("|")) <= alternatives and not spec.get("post_processor")


class _Numbers(dict):
    """Numbers things in the order they are first met; ``new`` lists those met lately."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n


class _ByteLevel(dict):
    """Characters as the tokenizers library writes their bytes."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        s = self[code] = "".join(x for x, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code)))
        return s


class Encoder:
    """Ids of texts. Where the tokenizer allows it, texts are cut at white space and each
    different chunk is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.by_chunk = splits_at_space(path)
        self.model, self.marks, self.spell = self.tokenizer.model, {}, _ByteLevel()
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.pool, self.begins, self.lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.size = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(n.sum())), n

    def _word(self, chunk: bytes) -> list[int] | None:
        """The ids of a chunk that is one word of letters and then marks of ASCII, straight from
        the tokenizer's model; None for other chunks, and where its normal form needs more than
        each letter's lower case."""
        text = chunk.decode()
        word = text.rstrip(string.punctuation)
        if not word.isalpha():
            return None
        lower = word.lower()
        if not word.isascii():
            if "\u03a3" in word or not lower.isalpha() or not unicodedata.is_normalized("NFC", word):
                return None
            lower = lower.translate(self.spell)
        ids = [t.id for t in self.model.tokenize(lower)]
        if len(word) < len(text):
            marks = text[len(word) :]
            if marks not in self.marks:
                self.marks[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
            ids += self.marks[marks]
        return ids

    def _learn(self, chunks: list[bytes]) -> None:
        found = list(map(self._word, chunks))
        rest = [k for k, x in enumerate(found) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k].decode() for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.pool.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(n.sum())))
        self.begins.append(self.size + np.cumsum(n) - n)
        self.lengths.append(n)
        self.size += int(n.sum())

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not self.by_chunk:
            return self._encode([t.decode() for t in texts])
        if len(self.known) > CHUNKS:
            self._forget()
        chunks = [t.split() for t in texts]
        every = list(itertools.chain.from_iterable(chunks))
        which = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        pool, begins, lengths = (x[0] if len(x) == 1 else np.concatenate(x) for x in (self.pool, self.begins, self.lengths))
        self.pool, self.begins, self.lengths = [pool], [begins], [lengths]
        size = lengths[which]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        out = pool[np.repeat(begins[which] - (end - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in chunks])]).astype(np.int64)
        upto = np.concatenate([[0], end])
        return out, upto[bounds[1:]] - upto[bounds[:-1]]


def _writer(tokenizer: str, end_id: int | None, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        part, nulls = -1, 0
        for b in portions(batches, "text", TEXT_BYTES):
            if out is None:
                part = b["part"][0].as_py()
                fs, at = pyarrow.fs.FileSystem.from_uri(folder)
                fs.create_dir(at)
                path = f"{at}/part-{part:06d}-{uuid.uuid4().hex}.s8b"
                sink = fs.open_output_stream(path)
                out, encoder = Writer(sink), in_worker(("encoder", tokenizer), lambda: Encoder(tokenizer))
            ids, counts = encoder.ids([t or b"" for t in b["text"].to_pylist()])
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            nulls += b["id"].null_count
            out.add(b["id"].fill_null(NO_ID).to_numpy(zero_copy_only=False), counts, ids)
        if out is not None:
            out.close()
            sink.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "path": [path], "bytes": [fs.get_file_info(path).size], "n_docs": [sum(map(len, out.docs))], "n_ids": [out.values], "n_null": [nulls]})

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Encode every text and write the ids in ascending order of id_col; returns the manifest
    (part, path, bytes, n_docs, n_ids, n_null) and the folder. ``tokenizer`` is the path of a file
    of the tokenizers library, on every machine; ``end_id`` is appended to each document.
    ``folder`` is one that driver and executors share; without a scheme it lies on the cluster's
    default file system.

    A null or empty text has no ids but ``end_id``. Rows with a null id come first; files hold
    NO_ID for them, and n_null says how many of a file's first documents they are. Rows with equal
    ids stay side by side, ordered by their text's hash.
    Empty table: no files. Texts of any length are encoded whole. No other column is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder or new_folder(spark, "token-files"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return save(rows.mapInArrow(_writer(tokenizer, end_id, folder), MANIFEST), "token-manifest"), folder


def _documents(folder: str, digest):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, bytes_, start, nulls in zip(*(b[c].to_pylist() for c in ("path", "bytes", "start", "n_null")), strict=True):
                with fs.open_input_file(path) as source:
                    reader = Reader(source, bytes_)
                    ends = np.cumsum(reader.counts)
                    results, doc, state, at = [], 0, None, 0
                    for values in reader.runs():
                        values, lo = values.astype("<u4"), 0
                        while doc < len(ends) and (ends[doc] <= at + len(values) or lo < len(values)):
                            hi = int(min(ends[doc] - at, len(values)))
                            state = digest(values[lo:hi], state)
                            lo = hi
                            if ends[doc] > at + len(values):
                                break
                            results.append(state)
                            state, doc = None, doc + 1
                        at += len(values)
                    results += [digest(np.zeros(0, "<u4"), None)] * (len(ends) - doc)
                yield pa.record_batch({"doc_id": pa.array(reader.docs, mask=np.arange(len(ends)) < nulls), "start": pa.array(start + ends - reader.counts), "n_tokens": pa.array(reader.counts), "ids_crc32": pa.array(results, pa.int64())})

    return read


def _crc(ids: np.ndarray, state: int | None) -> int:
    import zlib

    return zlib.crc32(ids.tobytes(), state or 0)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """What the files hold, per document: doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit integers). The manifest
    has one row for each shuffle partition; only that comes to the driver."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((r["path"], r["bytes"], start, r["n_null"]))
        start += r["n_ids"]
    files = spark.createDataFrame(rows, "path string, bytes long, start long, n_null long")
    return files.repartition(max(1, len(rows)), "path").mapInArrow(_documents(folder, _crc), "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_file(path: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document ids and each document's token ids, from one local file."""
    with pyarrow.OSFile(path) as source:
        reader = Reader(source, source.size())
        values = np.concatenate([np.zeros(0, np.uint64), *reader.runs()])
    return reader.docs, np.split(values, np.cumsum(reader.counts)[:-1]) if len(reader.docs) else []
