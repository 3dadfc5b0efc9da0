"""Secret scan: known shapes, and windows of high entropy in candidate strings.

Base spans come from three patterns (kinds assign, access, hex; fixed values). The scan adds spans of kind
``entropy``: candidates are runs of token characters of at least ``window`` characters. A window of that
length slides over a run; the counts of its characters, kept per class (hex digits, base 64), change by one
character in and one out, and with them the sum of c log2 c, so each step costs the same. A window counts if
its characters all belong to a class, it has two digits or more (so a token of letters only is never found), at least
two of digits, lower and upper letters occur, and its entropy reaches the class's threshold. Touching windows unite to
one span. A span is suppressed if a match of an allow-list pattern (identifiers, checksums named as such, addresses) covers it,
wherever in the text the match begins, or if its run holds a word of an example. Patterns are matched over the whole text, once, and
only where a window was found; they must be linear. Base spans are never suppressed.

NULL and empty texts have no spans. Texts are scanned whole. Spans count code points, end exclusive, and are
listed by start, then kind in the order of KINDS. Repeated rows give repeated rows; only doc_id and text are
read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import table
from barflow.llm.registry import query

# The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

WINDOW = 20
#: Bits per character that a window must reach, by class of characters.
THRESHOLDS = {"hex": 3.0, "base64": 3.8}
CLASSES = {"hex": frozenset("0123456789abcdefABCDEF"), "base64": frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")}
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % WINDOW)
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:sha-?(?:1|256|512)|md5)[:=-][0-9a-zA-Z+/=]+",
    r"(?:https?://|www\.)[^\s\"'<>]+",
)
#: Words, in either case, that make the whole run of token characters around them an example.
EXAMPLES = ("example", "placeholder", "changeme", "dummy")

#: Keywords start with one of these letters; assign needs : or = somewhere.
_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's number, end) of the three known shapes."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # Runs are maximal, so asking for the least length at once finds the same runs.
    found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
    return found


_LOG = [0.0] + [c * math.log2(c) for c in range(1, 1025)]


def entropy_windows(run: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Spans of the run covered by windows that reach the threshold of a class."""
    spans: list[tuple[int, int]] = []
    bits = math.log2(window)
    for name, members in CLASSES.items():
        need = thresholds[name]
        counts: dict[str, int] = {}
        total, outside, digits, lower, upper = 0.0, 0, 0, 0, 0
        for i, ch in enumerate(run):
            for c, step in ((ch, 1), (run[i - window] if i >= window else "", -1)):
                if not c:
                    continue
                n = counts.get(c, 0)
                total += _LOG[n + step] - _LOG[n]
                counts[c] = n + step
                outside += step * (c not in members)
                digits += step * c.isdigit()
                lower += step * c.islower()
                upper += step * c.isupper()
            if i + 1 >= window and not outside and bits - total / window >= need - 1e-9 and (digits > 0) + (lower > 0) + (upper > 0) >= 2 and digits >= 2:
                start = i + 1 - window
                if spans and spans[-1][1] >= start and spans[-1][0] <= start:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and merged[-1][1] >= start:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


class Allowed:
    """Whether a match of one of the patterns covers a span of the text."""

    def __init__(self, text: str, allow: tuple[re.Pattern, ...]):
        spans = sorted(m.span() for p in allow for m in p.finditer(text))
        self.starts = [s for s, _ in spans]
        self.reach = list(accumulate((e for _, e in spans), max))  # how far matches up to here go

    def covers(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.reach[i - 1] >= end


def scan(text: str, allow: tuple[re.Pattern, ...]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, each sorted by start, then kind."""
    base = sorted(base_spans(text))
    added, allowed = [], None
    for run in CANDIDATE.finditer(text):
        windows = entropy_windows(run.group())
        if windows and not any(word in run.group().lower() for word in EXAMPLES):
            allowed = allowed or Allowed(text, allow)
            spans = [(run.start() + start, run.start() + end) for start, end in windows]
            added += [(start, 3, end) for start, end in spans if not allowed.covers(start, end)]
    return base, sorted(base + added)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by the name of its (first) kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, redacted: bool = False) -> DataFrame:
    """Per row: doc_id, the counts of base spans, base and all spans as text, and with ``redacted`` the cleaned text (NULL stays NULL)."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base string, spans string" + ", redacted string" * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tuple(map(re.compile, allow))
        for batch in batches:
            rows = []
            for value in batch.column(1):
                given = value.as_py()
                base, spans = scan(given or "", patterns)
                counts = [sum(s[1] == k for s in spans) for k in range(len(KINDS))]
                rows.append((*counts, listed(base), listed(spans), None if given is None else redact(given, spans) if redacted and spans else given))
            columns = list(zip(*rows)) if rows else [()] * 7
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4 : 6 + redacted]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base", "spans", *["redacted"] * redacted])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact_rows(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The rows of ``docs``, columns as they are, with every span of ``text`` replaced; n_chars, if there, follows."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tuple(map(re.compile, allow))
        for batch in batches:
            texts = [None if t is None else redact(t, spans) if (spans := scan(t, patterns)[1]) else t for t in batch.column(at).to_pylist()]
            columns = batch.columns
            changed = [a != b for a, b in zip(texts, batch.column(at).to_pylist())]
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                counts = [len(t) if c else n for t, c, n in zip(texts, changed, columns[chars].to_pylist())]
                columns[chars] = pa.array(counts, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    found = find_secrets(table(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")
