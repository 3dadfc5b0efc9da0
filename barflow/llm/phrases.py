"""Phrase collocations by counting in tries with hash containers, one length of phrase after the other.

Texts (A-Z in lower case) are cut into pieces at stops and line ends, pieces into words. Per lang (NULL: ``und``), n counts all words and f(phrase) all its
occurrences within pieces. Phrases of 2 to 5 words with f of ``LEAST`` or more are candidates. A cut after the first words gives a score of
floor(1000 a n / (l r)); the lowest counts, the shortest first part if equal. A candidate inside a longer one that occurs as
often is dropped; between the two lies a phrase one word longer that occurs as often as well, so only those are looked at.

Counting. A task numbers words as they come and keeps a trie over word numbers for each lang. It begins as one hash container
from phrases to counts; a container that grows beyond ``BURST`` bursts into a trie node with a container for each next word, so the trie
stays shallow. When a task holds ``HELD`` counts, the largest subtrees are spilled whole, until half is left: their phrases
form a sorted run for each of ``BUCKETS`` prefixes (a hash of the first two words, so that a very frequent first word does
not meet in one place). Runs go to the partition of their prefix, where Spark's aggregation merges them.

A phrase can only reach ``LEAST`` if the two phrases one word shorter in it do. So lengths are counted in turn, and a
Bloom filter of the shorter ones decides what enters a trie. The filter has ``FILTER`` bits whatever the input (16 MB,
broadcast); where it is full, more is counted and dropped afterwards, never less.

The first ``MOST`` of a lang are found in salted parts, then among the best of each. Products are decimals of 38 digits.

NULL and empty texts have no words. Texts are taken whole and rows count as often as they come; doc_id is not read, so
NULL or repeated ids change nothing. An empty table has no phrases. Only text and lang are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import mix, rolling, slices, stage, strings, table, word_hashes, words
from barflow.llm.registry import query

LEAST = 100
WORDS = 5
MOST = 2000
NONE = "und"
BURST = 4096
HELD = 1_000_000
BUCKETS = 1024
FILTER = 1 << 27
SALTS = 64

# The bytes that end a piece, and those that part words.
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _STOP.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Trie:
    """A node that has burst. A child holds the rest of its phrases (word numbers, four bytes each), in a container or a node."""

    def __init__(self, burst: int):
        self.burst, self.size = burst, 0
        self.children: dict[bytes, dict[bytes, int] | Trie] = {}

    def add(self, phrase: bytes, count: int) -> int:
        head = phrase[:4]
        self.children[head], grown = put(self.children.get(head), phrase[4:], count, self.burst)
        self.size += grown
        return grown


def put(child: dict | Trie | None, phrase: bytes, count: int, burst: int) -> tuple[dict | Trie, int]:
    """Count a phrase under ``child``: the child, as a node if it has burst, and by how many phrases it has grown."""
    if type(child) is Trie:
        return child, child.add(phrase, count)
    child = {} if child is None else child
    before = len(child)
    child[phrase] = child.get(phrase, 0) + count
    grown = len(child) - before
    if grown and before >= burst and len(phrase) > 4:
        node = Trie(burst)
        for key, value in child.items():
            node.add(key, value)
        return node, grown
    return child, grown


def size_of(child: dict | Trie) -> int:
    return len(child) if type(child) is dict else child.size


def listed(child: dict | Trie, prefix: bytes = b"") -> Iterator[tuple[bytes, int]]:
    if type(child) is dict:
        for rest, count in child.items():
            yield prefix + rest, count
    else:
        for head, below in child.children.items():
            yield from listed(below, prefix + head)


class Words:
    """The words of a chunk of texts: hashes, the piece and the text each is in, and their bytes."""

    def __init__(self, column: pa.Array):
        data, offsets = strings(column)
        data = _LOWER[data]
        gap = _GAP[data]
        blank = np.where(gap, np.uint8(0x20), data)  # what parts words here is one of the blanks there
        self.starts, self.ends, first = words(blank, offsets)
        self.text = np.repeat(np.arange(len(column)), np.diff(first))
        self.hashes = word_hashes(blank, self.starts, self.ends)
        stops = np.cumsum(_STOP[data])
        piece = stops[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        # Texts count as stops, so words of two texts never share a piece.
        self.piece = piece + self.text
        self.data = data

    def __len__(self) -> int:
        return len(self.starts)

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at the given places."""
        sizes = self.ends[at] - self.starts[at]
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        places = np.repeat(self.starts[at] - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[places])))


def _salt(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode())], np.uint64))[0]


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    return hashes & np.uint64(FILTER - 1), (hashes >> np.uint64(32)) & np.uint64(FILTER - 1)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for probe in _probes(hashes):
        ok &= (bits[(probe >> np.uint64(6)).astype(np.int64)] >> (probe & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row, in order of the rows, and how often it comes."""
    rank = columns[0].astype(np.int64)
    for i, column in enumerate(columns[1:], 2):
        values = rank << 32 | column
        if i < len(columns):
            rank = np.unique(values, return_inverse=True)[1]
    if len(columns) == 1:
        values = rank
    _, place, counts = np.unique(values, return_index=True, return_counts=True)
    return place, counts


class _Counter:
    """Tries of a task, one per lang, for phrases of one length over words numbered as they come."""

    def __init__(self, held: int, burst: int):
        self.held, self.burst = held, burst
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.tries: dict[str, dict | Trie] = {}

    def numbered(self, found: pa.Array) -> np.ndarray:
        coded = found.dictionary_encode()
        numbers = [self.numbers.setdefault(name, len(self.numbers)) for name in coded.dictionary.to_pylist()]
        return np.array(numbers, np.int64)[coded.indices.to_numpy()] if numbers else np.zeros(0, np.int64)

    def add(self, lang: str, columns: list[np.ndarray]) -> None:
        """Rows of word numbers, a phrase each."""
        if not len(columns[0]):
            return
        place, counts = _distinct(columns)
        rows = np.stack([c[place] for c in columns], axis=1).astype(">u4")
        keys, width, trie = rows.tobytes(), 4 * len(columns), self.tries.get(lang)
        for i, count in enumerate(counts.tolist()):
            trie, _ = put(trie, keys[i * width : (i + 1) * width], count, self.burst)
        self.tries[lang] = trie

    def spill(self, everything: bool = False) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees, until half of what may be held is left; of all at the end, or when numbers take too much."""
        size = sum(map(size_of, self.tries.values()))
        everything = everything or len(self.numbers) > 2 * self.held
        if not everything and size <= self.held:
            return
        names = pa.array(list(self.numbers), pa.string())
        marks = mix(np.array([zlib.crc32(x.encode()) for x in self.numbers], np.uint64))
        for lang, trie in self.tries.items():
            if everything:
                taken = [(trie, b"")]
                self.tries[lang] = {}
            elif type(trie) is dict:
                taken = [(trie, b"")] if len(trie) > self.held // 2 else []
                self.tries[lang] = {} if taken else trie
            else:
                taken, most = [], self.held * trie.size // (2 * size)
                for head in sorted(trie.children, key=lambda h: (-size_of(trie.children[h]), h)):
                    if trie.size <= most:
                        break
                    child = trie.children.pop(head)
                    trie.size -= size_of(child)
                    taken.append((child, head))
            phrases = [x for child, head in taken for x in listed(child, head)]
            if phrases:
                yield _runs(lang, phrases, names, marks)
        if everything:
            self._clear()


RUNS = "lang string, bucket int, phrases array<string>, counts array<long>"


def _runs(lang: str, phrases: list[tuple[bytes, int]], names: pa.Array, marks: np.ndarray) -> pa.RecordBatch:
    """A sorted run for each prefix."""
    keys, counts = zip(*phrases)
    numbers = np.frombuffer(b"".join(keys), ">u4").reshape(len(keys), -1).astype(np.int64)
    bucket = marks[numbers[:, 0]]
    if numbers.shape[1] > 1:
        bucket = mix(bucket + marks[numbers[:, 1]] * np.uint64(3))
    bucket = (bucket % np.uint64(BUCKETS)).astype(np.int32)
    text = names.take(pa.array(numbers[:, 0]))
    for column in numbers.T[1:]:
        text = pc.binary_join_element_wise(text, names.take(pa.array(column)), " ")
    rows = pa.table({"bucket": bucket, "phrase": text, "count": pa.array(counts, pa.int64())}).sort_by([("bucket", "ascending"), ("phrase", "ascending")]).combine_chunks()
    bucket = rows.column("bucket").to_numpy()
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    offsets = pa.array(np.r_[first, len(bucket)].astype(np.int32))
    phrase, count = (rows.column(c).combine_chunks() for c in ("phrase", "count"))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(first), pa.string()), pa.array(bucket[first], pa.int32()), pa.ListArray.from_arrays(offsets, phrase), pa.ListArray.from_arrays(offsets, count)],
        names=["lang", "bucket", "phrases", "counts"])


def runs_of(docs: DataFrame, length: int, bits=None, held: int = HELD, burst: int = BURST) -> DataFrame:
    """Sorted runs of the phrases of a length; above one word only those whose two shorter ones the filter holds.

    With the words goes a run in bucket -1: the empty phrase, counted once for each word of the lang.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, totals = _Counter(held, burst), {}
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                chunk = Words(batch.column(1)[lo:hi])
                at = np.arange(max(0, len(chunk) - length + 1))
                at = at[chunk.piece[at] == chunk.piece[at + length - 1]]
                langs, number = np.unique(np.array(batch.column(0)[lo:hi].to_pylist(), object), return_inverse=True)
                number = number[chunk.text]
                if length > 1:
                    salts = np.array([_salt(x) for x in langs], np.uint64)
                    shorter, same = rolling(chunk.hashes, length - 1), salts[number]
                    n = len(shorter)
                    held_here = _held(bits.value, mix(shorter ^ same[:n]))
                    at = at[held_here[at] & held_here[at + 1]]
                if not len(at):
                    continue
                rows = counter.numbered(chunk.strings((at[:, None] + np.arange(length)).ravel())).reshape(-1, length)
                for i, lang in enumerate(langs):
                    mine = rows[number[at] == i]
                    if length == 1:
                        totals[lang] = totals.get(lang, 0) + len(mine)
                    counter.add(lang, list(mine.T))
                yield from counter.spill()
        yield from counter.spill(True)
        if totals:
            yield pa.RecordBatch.from_pylist([{"lang": x, "bucket": -1, "phrases": [""], "counts": [n]} for x, n in totals.items()], schema=_schema())

    texts = docs.select(F.coalesce("lang", F.lit(NONE)).alias("lang"), "text")
    return texts.mapInArrow(run, RUNS)


def _schema() -> pa.Schema:
    return pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("phrases", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def merged(runs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all runs, merged in the partition of their prefix."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(parts, "lang", "bucket")
    rows = dealt.select("lang", "bucket", F.explode(F.arrays_zip("phrases", "counts")).alias("x"))
    return rows.groupBy("lang", "bucket", F.col("x.phrases").alias("phrase")).agg(F.sum("x.counts").alias("f")).drop("bucket")


def filter_of(phrases: DataFrame, length: int) -> np.ndarray:
    """The Bloom filter of (lang, phrase): FILTER bits, of which only words with a bit set come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = Words(batch.column(1))
            langs = batch.column(0).to_pylist()
            salts = {x: _salt(x) for x in set(langs)}
            hashes = mix(rolling(chunk.hashes, length)[::length] ^ np.array([salts[x] for x in langs], np.uint64))
            for probe in _probes(hashes):
                yield pa.RecordBatch.from_arrays([pa.array((probe >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (probe & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER // 64, np.uint64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def counts(docs: DataFrame, least: int = LEAST, longest: int = WORDS, held: int = HELD, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) for all phrases of ``longest`` words at most with f >= ``least``, and (lang, n)."""
    spark = docs.sparkSession
    found = stage(merged(runs_of(docs, 1, None, held, burst)).filter((F.col("f") >= least) | (F.col("phrase") == "")))
    totals = found.filter(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    every = last = found.filter(F.col("phrase") != "").withColumn("words", F.lit(1))
    for length in range(2, longest + 1):
        bits = spark.sparkContext.broadcast(filter_of(last, length - 1))
        last = stage(merged(runs_of(docs, length, bits, held, burst)).filter(F.col("f") >= least).withColumn("words", F.lit(length)))
        every = every.unionByName(last)
        if last.isEmpty():
            break
    return every, totals


#: Exact: the numerator and the denominator have 38 digits at most, the quotient is below 1000 n.
SCORE = """CAST(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(17,0))
           div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT)"""


def collocations(docs: DataFrame, least: int = LEAST, longest: int = WORDS, most: int = MOST, held: int = HELD, burst: int = BURST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's ``most`` best candidates."""
    every, totals = counts(docs, least, longest, held, burst)
    parts = F.split("phrase", " ", -1)
    candidates = every.filter(F.col("words") > 1).select("lang", "phrase", F.col("f").alias("a"), parts.alias("parts"))

    def joined(first: Column, size: Column) -> Column:
        return F.array_join(F.slice("parts", first, size), " ")

    k, size = F.col("k"), F.size("parts")
    inside = candidates.filter(size > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(joined(F.lit(1), size - 1), joined(F.lit(2), size - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stay = candidates.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).drop("longer")
    cuts = stay.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "a", "k", joined(F.lit(1), k).alias("left"), joined(k + 1, size - k).alias("right"))
    known = every.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.withColumnRenamed("f", name), (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part", side)
    cuts = cuts.join(totals, "lang")
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # A lang may hold any number of candidates: the best of each salted part, then of these.
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 100),
inner_ones AS (
  SELECT DISTINCT lang, f, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, f, w, k, m, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM often WHERE k > 2))),
stay AS (
  SELECT * FROM often o WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_ones x WHERE x.lang = o.lang AND x.phrase = o.phrase AND 100 * x.f >= 100 * o.f)),
cuts AS (
  SELECT lang, phrase, f AS a, c, array_to_string(list_slice(w, 1, c), ' ') AS first_part, array_to_string(list_slice(w, c + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM stay)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.c, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.first_part JOIN often y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM placed WHERE rank <= 2000
"""


@query("op11_phrases", SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each lang."""
    return collocations(table(spark, sf_dir))
