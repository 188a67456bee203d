"""Toxicity scores: boosted trees over dense features of a text, calibrated to probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lamina.llm.boosting import Calibrated
from lamina.llm.common import forget, free, in_worker, portions, save, small_batches

#: Labelled rows that training uses at most, words of the learned lexicon at most, and labelled
#: documents that must hold such a word.
TRAIN_ROWS, LEARNED_WORDS, LEAST_DOCS = 20_000, 400, 4
TEXT_BYTES, NEAR, SPAN = 4 << 20, 5, 50

# Insults, and words that address the reader.
INSULTS = "idiot idiots moron morons stupid dumb fool fools loser losers clown clowns trash garbage scum pathetic worthless disgusting ugly hate hateful kill die shut crap damn hell jerk freak creep filthy vile vermin pig pigs rat rats imbecile cretin dimwit bastard lunatic psycho coward liar slob sucker twit brainless useless vicious".split()
SECOND_PERSON = "you your yours yourself yourselves u ur youre du dich dir dein deine tu toi ton ta tes vous votre vos te ti tus usted ustedes vosotros".split()
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasii")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_INNER = re.compile(rb"[a-z][^a-z\x80-\xff]+[a-z]")
_INSULTS, _SECOND = ({w.encode() for w in ws} for ws in (INSULTS, SECOND_PERSON))

#: Columns of a word's row: insult, insult under obfuscation, second person, learned weight,
#: learned word, all capitals, digit inside, mark inside, single letter.
_WORD_COLUMNS = 9
FEATURES = 21


def spelled(word: bytes) -> tuple[bytes, bytes]:
    """A word in lower case without the marks around it, and with look-alike characters and
    inner marks undone."""
    plain = word.lower().strip(_MARKS)
    undone = word.lower().translate(_LEET)
    return plain, bytes(c for c in undone if 97 <= c <= 122 or c >= 128)


class Words(dict):
    """Word -> row of a table of what words are."""

    limit = 300_000

    def __init__(self, learned: dict[bytes, float]):
        self.learned = learned
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.table, self.used = np.zeros((4096, _WORD_COLUMNS), np.float32), 0

    def __missing__(self, word: bytes) -> int:
        plain, undone = spelled(word)
        row = np.zeros(_WORD_COLUMNS, np.float32)
        row[0] = plain in _INSULTS
        row[1] = not row[0] and undone in _INSULTS and undone != plain
        row[2] = plain in _SECOND
        w = self.learned.get(plain)
        if w is None and undone != plain:
            w = self.learned.get(undone)
        row[3], row[4] = (w, 1) if w is not None else (0, 0)
        row[5] = len(plain) > 1 and plain.isalpha() and word.isupper()
        row[6] = any(48 <= c <= 57 for c in plain) and any(97 <= c <= 122 for c in plain)
        row[7] = _INNER.search(word.lower()) is not None
        row[8] = len(plain) == 1
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = row
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self._reset()
        return self.table[at] if len(at := np.fromiter(map(self.__getitem__, words), np.int64, len(words))) else np.zeros((0, _WORD_COLUMNS), np.float32)


def features(text: bytes, words: Words) -> np.ndarray:
    """The features of one text: counts and rates of what its words and characters are, how many
    insults stand within NEAR words of an address, and the most of them in SPAN words."""
    out = np.zeros(FEATURES)
    r = words.rows(text.split())
    n = len(r)
    if not n:
        return out
    total = r.sum(axis=0, dtype=np.float64)
    bad = np.flatnonzero((r[:, 0] > 0) | (r[:, 1] > 0) | (r[:, 3] > 0))
    out[0] = np.log1p(n)
    out[1:10] = 100 * total / n
    out[10:13] = np.log1p([total[0] + total[1], total[4], total[2]])
    out[13] = r[:, 3].max()
    if len(bad):
        you = np.flatnonzero(r[:, 2] > 0)
        near = np.searchsorted(you, bad + NEAR, side="right") > np.searchsorted(you, bad - NEAR)
        out[14], out[15] = np.log1p(near.sum()), 100 * near.sum() / n
        out[16] = (np.searchsorted(bad, bad + SPAN) - np.arange(len(bad))).max()
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[17] = 100 * chars[65:91].sum() / max(1, chars[65:91].sum() + chars[97:123].sum())
    out[18], out[19] = 1000 * chars[33] / len(text), 1000 * chars[63] / len(text)
    out[20] = 100 * (chars[34:48].sum() + chars[58:63].sum() + chars[91:97].sum()) / len(text)
    return out


def _held_out(id_col) -> Column:
    """crc32 of the id's text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches, "text", TEXT_BYTES):
        word, toxic, half = [], [], []
        for text, label, h in zip(*(b[c].to_pylist() for c in ("text", "toxic", "half")), strict=True):
            mine = {p for w in set((text or b"").split()) for p in spelled(w)[:1] if 1 < len(p) <= 40}
            word += mine
            toxic += [label] * len(mine)
            half += [h] * len(mine)
        yield pa.record_batch({"word": pa.array(word, pa.binary()), "toxic": pa.array(toxic, pa.int32()), "half": pa.array(half, pa.int32())})


class Model:
    """A lexicon with weights and calibrated trees."""

    def __init__(self, learned: dict[bytes, float], x: np.ndarray, y: np.ndarray):
        self.learned, self.predict = learned, Calibrated(x, y)


def _lexicon(held: DataFrame, half: int, pos: int, neg: int) -> dict[bytes, float]:
    """The words that toxic documents of a half (2: of both) hold clearly more often, with their
    log odds."""
    bad, n = F.col(f"bad{half}"), F.col(f"n{half}")
    odds = F.log((bad + 0.5) / (pos + 1.0)) - F.log((n - bad + 0.5) / (neg + 1.0))
    error = F.sqrt(1 / (bad + 0.5) + 1 / (n - bad + 0.5))
    best = held.select("word", odds.alias("odds"), (odds / error).alias("z")).where("odds > 1 AND z > 2.5").orderBy(F.desc("z"), "word").limit(LEARNED_WORDS)
    return {bytes(r["word"]): float(r["odds"]) for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled documents that aren't held out: at most ``rows`` of them, those with
    the smallest hashes of their ids; of several texts of an id, the one of the smallest hash. The
    lexicon takes words that toxic documents hold more often than others; training judges a
    document by the lexicon of the half that it isn't in, scoring by that of all. The chosen texts
    and their words are written once and read for all lexicons and features."""
    label = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~_held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = label.orderBy(F.xxhash64("id"), "id").limit(rows).withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(sample), "id")  # `rows` ids at most
    texts = texts.groupBy("id", "toxic", "half").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    texts = save(texts.select("id", "toxic", "half", "one.text"), "toxic-texts")
    size = {(r["half"], r["toxic"]): r["n"] for r in texts.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    held = texts.mapInArrow(_distinct_words, "word binary, toxic int, half int").groupBy("word").agg(*[F.sum(F.when(F.col("half") == h, x).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c, x in (("bad", F.col("toxic")), ("n", F.lit(1)))])
    held = held.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).withColumns({"bad2": F.col("bad0") + F.col("bad1"), "n2": F.col("n0") + F.col("n1")})
    held = save(held, "toxic-words")
    learned = [_lexicon(held, h, *(sum(size.get((k, t), 0) for k in ((h,) if h < 2 else (0, 1))) for t in (1, 0))) for h in (0, 1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(learned[1]), Words(learned[0])]  # a row's words are judged by the other half's lexicon
        for b in portions(batches, "text", TEXT_BYTES):
            x = [features(t or b"", words[h]) for t, h in zip(b["text"].to_pylist(), b["half"].to_pylist(), strict=True)]
            yield pa.record_batch({"id": b["id"], "toxic": b["toxic"], "x": pa.array(x, pa.list_(pa.float64()))})

    found = texts.mapInArrow(run, "id long, toxic int, x array<double>").toArrow().sort_by([("id", "ascending")])
    forget(texts, held)
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, FEATURES)
    return Model(learned[2], x, found["toxic"].to_numpy().astype(np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", train_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` with columns held_out, score (0 to 1) and predicted (1 from a score of 0.5).

    Labels come from ``labels`` (id_col, toxic); only rows whose crc32 of the id as text isn't
    divisible by 5 are learned from. ``train_docs`` holds their texts, ``docs`` unless given.
    Scores depend on the text alone.

    Null or empty texts get the score of a text without words. Null ids: held out. Null labels, or
    other than 0 and 1, are left out; of several labels of an id the largest counts. Without
    labels of both kinds the score is the share of label 1 (0 without any). Equal texts have equal
    scores. Empty table: no rows. Other columns pass through; a new column whose name is taken
    gets an underscore.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs if train_docs is None else train_docs, labels, train_rows, id_col, text_col))
    names = {c: free(docs, c) for c in ("held_out", "score", "predicted")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = in_worker(("toxicity", tuple(sorted(model.value.learned.items()))), lambda: Words(model.value.learned))
        for b in portions(batches, text_col, TEXT_BYTES):
            x = np.stack([features(t or b"", words) for t in b[text_col].cast(pa.binary()).to_pylist()])
            yield b.append_column(names["score"], pa.array(model.value.predict(x)))

    out = docs.mapInArrow(run, _schema(docs, names["score"]))
    return out.withColumns({names["held_out"]: _held_out(F.col(id_col)), names["predicted"]: (F.col(names["score"]) >= 0.5).cast("int")})


def _schema(docs: DataFrame, score: str) -> StructType:
    return StructType([*docs.schema.fields, StructField(score, DoubleType())])


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, as they are, that are not predicted to be toxic."""
    scored = score_toxicity(docs, labels, **options)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)
