"""Language identification by bit-sliced Bloom filters of character n-grams.

Learning counts the trigrams of letters (other characters are one blank) per language over all training texts.
A language contains a trigram if its relative frequency there is at least ``share`` of the highest of all
languages. The filters of all languages lie in one array: entry i holds bit l if language l has set place i, so
the AND of the entries at a trigram's places is the set of all languages that contain it. A text's popcount per
language, corrected for the filter's false positives, decides; the score is the winner's part of all corrected
counts. The array has ``slots`` entries, doubled until the language that contains the most trigrams has a rate of
false positives of at most ``RATE``.

An array of up to ``HELD`` bytes is broadcast. A larger one stays a table in the shared folder: the distinct trigrams of
each text are joined with it by place, a place dealt over ``SALT`` parts since some trigrams are in nearly every text,
and the AND, the popcounts and the decision are the same.

NULL texts, texts without a letter and an untrained model give ``und`` and score 0; NULL languages are not
learned. A text too short for a trigram that is known takes the first language in order with score 0. Ties go to
the language first in order. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import doc_crc, mix, stage, table
from barflow.llm.registry import query

#: Entries at least, and the rate of false positives that the fullest language may have.
SLOTS = 1 << 19
RATE = 0.05
HASHES = 3
SHARE = 0.25
#: Bytes of an array that is brought to the driver and broadcast at most, and the parts of a place of a larger one.
HELD = 64 << 20
SALT = 16

_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text as 63-bit numbers (three code points), blanks at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    blank = points < len(_LETTER)
    blank[blank] = ~_LETTER[points[blank]]
    far = np.flatnonzero(points >= len(_LETTER))
    blank[far] = [not chr(c).isalpha() for c in points[far]]
    kept = np.where(blank, np.uint32(32), points)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    p = kept[keep].astype(np.int64)
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def places(grams: np.ndarray, slots: int = SLOTS, hashes: int = HASHES) -> np.ndarray:
    """The filter places of each trigram, one row per hash."""
    h = mix(grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(hashes)])


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed within a batch."""
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(trigrams(text or ""))
        for lang, parts in by.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))],
                                             names=["lang", "gram", "n"])


class Stored(NamedTuple):
    """An array too large to broadcast: its entries that are not 0 (at, plane, bits), their number with those that are, set places by language."""

    rows: DataFrame
    slots: int
    filled: np.ndarray


def learn(train: DataFrame, slots: int = SLOTS, hashes: int = HASHES, share: float = SHARE) -> tuple[list[str], np.ndarray | Stored]:
    """The languages in order and the bit-sliced array (one column of 64 bits for every 64 languages), above ``HELD`` bytes as a table."""
    counts = stage(train.filter(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long")
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]  # one row per language
    planes = max(1, -(-len(langs) // 64))
    if not langs:
        return langs, np.zeros((slots, planes), np.uint64)
    ids = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    freq = counts.join(totals, "lang").select("gram", ids.alias("id"), (F.col("n") / F.col("total")).alias("p"))
    highest = freq.groupBy("gram").agg(F.max("p").alias("top"))
    held = stage(freq.join(highest, "gram").filter(F.col("p") >= share * F.col("top")).select("gram", "id"))
    most = held.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    while (1 - np.exp(-hashes * most / slots)) ** hashes > RATE:
        slots *= 2

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False), slots, hashes).ravel()
            ids = np.tile(batch.column(1).to_numpy(zero_copy_only=False), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids // 64), pa.array((np.uint64(1) << (ids % 64).astype(np.uint64)).view(np.int64))],
                                             names=["at", "plane", "bits"])

    rows = held.mapInArrow(lay, "at long, plane int, bits long").groupBy("at", "plane").agg(F.bit_or("bits").alias("bits"))
    if slots * planes * 8 > HELD:
        rows = stage(rows)
        filled = rows.agg(*[F.sum(F.when((F.col("plane") == i // 64) & (F.col("bits").bitwiseAND(F.lit(_bit(i))) != 0), 1).otherwise(0)) for i in range(len(langs))]).first()
        return langs, Stored(rows, slots, np.array([n or 0 for n in filled]))
    found = rows.toArrow()
    bits = np.zeros((slots, planes), np.uint64)
    bits[found["at"].to_numpy(), found["plane"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return langs, bits


def _bit(language: int) -> int:
    """The bit of a language in its plane, as a signed number."""
    bit = 1 << (language % 64)
    return bit - (1 << 64) if bit >> 63 else bit


def choose(counts: np.ndarray, n: int, langs: list[str], wrong: np.ndarray) -> tuple[str, float]:
    """The language by popcounts over ``n`` trigrams, and its score."""
    true = np.maximum(0.0, (counts / max(1, n) - wrong) / np.maximum(1e-9, 1 - wrong))
    best = int(np.argmax(true))
    return langs[best], float(true[best] / true.sum()) if true[best] > 0 else 0.0


def decide(text: str | None, langs: list[str], bits: np.ndarray, wrong: np.ndarray, hashes: int = HASHES) -> tuple[str, float]:
    """wrong: each language's rate of false positives."""
    if text is None or not langs or not has_letter(text):
        return "und", 0.0
    grams = trigrams(text)
    at = places(grams, len(bits), hashes)
    counts = np.zeros(len(langs))
    for plane in range(bits.shape[1]):
        column = bits[:, plane]
        found = column[at[0]]
        for row in at[1:]:
            found &= column[row]
        for i in range(plane * 64, min(len(langs), plane * 64 + 64)):
            counts[i] = np.count_nonzero(found & np.uint64(1 << (i % 64)))
    return choose(counts, len(grams), langs, wrong)


def identify_stored(docs: DataFrame, langs: list[str], stored: Stored, hashes: int = HASHES) -> DataFrame:
    """As ``identify``, with the array as a table."""
    slots, wrong = stored.slots, (stored.filled / stored.slots) ** hashes

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, doc_id, text) to one line per distinct trigram, and one per row (gram NULL) with the number of all, NULL for und."""
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                grams = trigrams(text) if text is not None and has_letter(text) else None
                found, n = np.unique(grams if grams is not None else np.zeros(0, np.int64), return_counts=True)
                at = places(found, slots, hashes).T.ravel()
                offsets = np.arange(len(found) + 1, dtype=np.int32) * hashes
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(found) + 1, row)), pa.array([doc_id] * (len(found) + 1), pa.int64()), pa.array([None, *found], pa.int64()),
                    pa.array([None if grams is None else len(grams), *n], pa.int64()),
                    pa.concat_arrays([pa.array([None], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at))])],
                    names=["row", "doc_id", "gram", "n", "ats"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [("und", 0.0) if n is None else choose(np.array(counts, float), n, langs, wrong) for n, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = rows.mapInArrow(spread, "row long, doc_id long, gram long, n long, ats array<long>")
    asked = lines.select("row", "doc_id", "gram", "n", F.explode_outer("ats").alias("at"), F.pmod("row", F.lit(SALT)).cast("int").alias("part"))
    dealt = stored.rows.select("at", "plane", "bits", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    held = asked.join(dealt, ["at", "part"], "left").groupBy("row", "gram", "plane").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.when(F.count("bits") == hashes, F.bit_and("bits")).alias("bits"))
    counts = F.array(*[F.sum(F.when((F.col("plane") == i // 64) & (F.col("bits").bitwiseAND(F.lit(_bit(i))) != 0), F.col("n")).otherwise(0)) for i in range(len(langs))])
    one = held.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("gram").isNull(), F.col("n"))).alias("n"), counts.alias("counts"))
    return one.select("doc_id", "n", "counts").mapInArrow(judged, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, langs: list[str], bits: np.ndarray | Stored, hashes: int = HASHES) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``."""
    if isinstance(bits, Stored):
        return identify_stored(docs, langs, bits, hashes)
    fill = np.array([np.count_nonzero(bits[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(langs))]) / len(bits)
    sent = docs.sparkSession.sparkContext.broadcast((langs, bits, fill**hashes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            got = [decide(text, *model, hashes) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from two thirds of the documents, predicted for all."""
    docs = table(spark, sf_dir)
    held_out = doc_crc(F.col("doc_id")) % 3 == 1
    langs, bits = learn(docs.filter(~held_out))
    return identify(docs, langs, bits).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
