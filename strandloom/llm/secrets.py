"""Secret scan: fixed patterns, and windows of high Shannon entropy.

Candidate strings are unbroken runs of one character class (hexadecimal, or
letters and digits with the signs of base 64). Over each a window slides; the
entropy of its characters is kept by incremental counts: one character enters,
one leaves, and the sum of n log n changes by those two terms alone. Windows
above the class's threshold are merged to spans. Candidates that look like
known harmless strings are suppressed; the fixed patterns never are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_columns, table, texts

# The fixed patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: For each class: its runs, the bits a character that a window must exceed.
CLASSES = (
    (re.compile(r"[0-9a-fA-F]{20,}"), 3.0),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9),
)
#: Runs that hold one of these are harmless, and so are runs within them.
ALLOWED = re.compile(r"(?i)example|sample|placeholder|changeme|xxxx|0123456789|abcdefgh|lorem|localhost")
#: Of the second class, a run without a digit, or of words joined by signs, is prose or a path.
WORDY = re.compile(r"[A-Za-z]+(?:[-_/+=.][A-Za-z]+)*|(?:[A-Za-z]{2,}|[0-9]{1,4})(?:[-_/](?:[A-Za-z]{2,}|[0-9]{1,4}))+")

_TERM = [0.0] + [n * log2(n) for n in range(1, WINDOW + 2)]


def dense_spans(run: str, limit: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` whose entropy exceeds ``limit`` bits."""
    counts: dict[str, int] = {}
    total, out = 0.0, []  # total: the sum of n log n over the counts
    whole = log2(window)
    for k, c in enumerate(run):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if k >= window:
            gone = run[k - window]
            n = counts[gone]
            total += _TERM[n - 1] - _TERM[n]
            counts[gone] = n - 1
        if k >= window - 1 and whole - total / window > limit + 1e-9:
            start = k - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((start, k + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if max(map(len, text.split()), default=0) >= WINDOW:  # else no run is so long
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]  # the runs of HEX that are long enough
    return sorted(found)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    if max(map(len, text.split()), default=0) < WINDOW:
        return []
    (hexes, hex_limit), (wide, wide_limit) = CLASSES
    spans, harmless = [], []
    for m in wide.finditer(text):
        run = m.group()
        if ALLOWED.search(run):
            harmless.append(m.span())
        elif any(c.isdigit() for c in run) and not WORDY.fullmatch(run):
            spans += [(m.start() + b, m.start() + e) for b, e in dense_spans(run, wide_limit)]
    begins = [b for b, _ in harmless]
    for m in hexes.finditer(text):
        at = bisect_right(begins, m.start()) - 1  # runs are apart, so only the last that begins before can hold it
        if at < 0 or m.end() > harmless[at][1]:
            spans += [(m.start() + b, m.start() + e) for b, e in dense_spans(m.group(), hex_limit)]
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with ``base_secrets`` and ``secrets``: kind, start, end.

    Offsets count code points, the end is exclusive; both lists are ordered by
    start, then by kind as in ``KINDS``. ``secrets`` holds the base spans and those of
    high entropy. A null or empty text has none; repeated rows each get their
    own; texts are scanned whole. Narrow: no shuffle.
    """

    def make():
        def work(part: pa.RecordBatch) -> list:
            base, every = [], []
            for t in texts(part, text):
                own = base_spans(t)
                both = sorted([*own, *((b, 3, e) for b, e in entropy_spans(t))])
                base.append([{"kind": KINDS[k], "start": b, "end": e} for b, k, e in own])
                every.append([{"kind": KINDS[k], "start": b, "end": e} for b, k, e in both])
            return [base, every]

        return work

    fields = [T.StructField("base_secrets", SPANS), T.StructField("secrets", SPANS)]
    return append_columns(docs, text, fields, make, list(docs.columns if keep is None else keep))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    from pyspark.sql import functions as F

    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(kind: str):
        return F.size(F.filter("base_secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def told(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told("base_secrets"), 256).alias("base_sha256"), told("secrets").alias("spans"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """What base_sha256 is of some spans; for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans).encode()).hexdigest()
