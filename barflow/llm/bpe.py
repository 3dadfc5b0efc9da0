"""Byte-level BPE as a monoid: encodings of neighbours are joined by re-encoding a window at their boundary.

A piece of text is halved down to leaves of a few bytes; two encoded halves are joined by re-encoding the last token of
the left and the first of the right, and growing that window until both its outer tokens form a stable pair with
the token beyond. A pair is stable if encoding the bytes of both gives the pair again, and a sequence all of whose
neighbouring pairs are stable is the encoding of its bytes (every token here encodes to itself, which the tests
check for the vocabulary in use), so nothing outside the window can change. Pieces of one text meet without a
window, since the split pattern separates them. Decoding concatenates the bytes up the tree.

A NULL or empty text has no tokens and decodes to no bytes. Texts are split and encoded whole whatever their
length. Repeated rows give repeated rows; only doc_id and text are read. The vocabulary file is a parameter; the
driver reads it, and the ranks, of a size fixed by the vocabulary, are sent to the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import slices, table
from barflow.llm.registry import query

#: Entries that a task remembers for pieces, halves and boundary windows; beyond it they are forgotten and made anew.
REMEMBERED = 500_000
#: Bytes, or tokens in decoding, of a leaf of the tree.
LEAF = 4


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encoding and decoding of pieces by tree reduction."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._halves: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """A leaf or a window by definition: merge the leftmost neighbours of lowest rank until none is left."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return tuple([self.ranks[p] for p in parts])

    def pair(self, left: int, right: int) -> tuple[int, ...]:
        """What the bytes of two neighbours encode to."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            found = self._pairs[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right])
        return found

    def stable(self, left: int, right: int) -> bool:
        return self.pair(left, right) == (left, right)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        a = b = 1
        window = self.pair(left[-1], right[0])
        while True:
            left_holds = a == len(left) or self.stable(left[-a - 1], window[0])
            right_holds = b == len(right) or self.stable(window[-1], right[b])
            if left_holds and right_holds:
                return left[:-a] + window + right[b:]
            a = a if left_holds else min(len(left), 2 * a)
            b = b if right_holds else min(len(right), 2 * b)
            window = self.merge(b"".join([self.bytes_of[t] for t in left[-a:] + right[:b]]))

    def encode(self, data: bytes) -> tuple[int, ...]:
        found = self._halves.get(data)
        if found is None:
            if len(data) <= LEAF:
                found = self.merge(data)
            else:
                half = len(data) // 2
                found = self.join(self.encode(data[:half]), self.encode(data[half:]))
            if len(data) <= 64:  # longer ones hardly come again
                if len(self._halves) >= REMEMBERED:
                    self._halves.clear()
                self._halves[data] = found
        return found

    def decode(self, ids: tuple[int, ...]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join([self.bytes_of[t] for t in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: What the split pattern of the given vocabularies is on texts without other characters.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class Texts:
    """Whole texts: (ids joined by commas, bytes of the decoded ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder, self.any_text = Encoder(ranks), regex.compile(pattern).findall
        # Over ASCII the same split, by the faster library.
        self.ascii_text = re.compile(ASCII_PATTERN).findall if pattern == public_tokenizers.PATTERN else self.any_text
        self._pieces: dict[str, tuple[str, bytes]] = {}

    def piece(self, piece: str) -> tuple[str, bytes]:
        ids = self.encoder.encode(piece.encode())
        if len(self._pieces) >= REMEMBERED:
            self._pieces.clear()
        found = self._pieces[piece] = (",".join(map(str, ids)), self.encoder.decode(ids))
        return found

    def encode(self, text: str) -> tuple[str, bytes]:
        known, make = self._pieces.get, self.piece
        parts = [known(p) or make(p) for p in (self.ascii_text if text.isascii() else self.any_text)(text)]
        return ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with ``ids`` the tokens."""
    ranks = ranks_of(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern or public_tokenizers.PATTERN))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(*sent.value)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):  # what a task holds at a time follows bytes, not rows
                n_tokens, ids_sha, data_sha, tokens = [], [], [], []
                for text in batch.column(1)[lo:hi]:
                    joined, data = texts.encode(text.as_py() or "")
                    n_tokens.append(joined.count(",") + 1 if joined else 0)
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    data_sha.append(hashlib.sha256(data).hexdigest())
                    if ids:
                        tokens.append(np.fromstring(joined, np.int32, sep=","))
                arrays = [batch.column(0)[lo:hi], pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(n_tokens)].astype(np.int32), np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every text and of what they decode to."""
    return encode(table(spark, sf_dir), ids=False)
