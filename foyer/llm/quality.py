"""Quality rules as a short-circuit cascade.

Each rule looks at features of one text that are made when first asked for.  On a
sample of documents every rule is timed and counted; rules then run in the order
of rejections per second of cost, and a document stops at the first that rejects
it.  The order changes only the time: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.llm.common import bound_batches, utf8

#: Documents of the sample on which costs and selectivities are estimated, at most.
SAMPLE = 1500
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = True
_INSIDE = np.zeros(256, bool)
_INSIDE[0x80:0xC0] = True  # bytes that continue a code point


class Features:
    """Of one text as UTF-8 bytes; each is computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text
        self.done: dict[str, object] = {}

    def __getattr__(self, name: str):
        done = self.__dict__["done"]
        if name not in done:
            done[name] = getattr(type(self), f"get_{name}")(self)
        return done[name]

    def get_words(self) -> list[bytes]:
        return self.text.split()

    def get_n_words(self) -> int:
        return len(self.words)

    def get_histogram(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.text, "u1"), minlength=256)

    def get_word_chars(self) -> int:
        return int(self.histogram[~(_SPACE | _INSIDE)].sum())

    def get_n_symbols(self) -> int:
        return int(self.histogram[_SYMBOLS].sum())

    def get_n_marks(self) -> int:
        return int(self.histogram[ord("!")])

    def get_lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    def get_n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def get_n_repeat_words(self) -> int:
        """Words in 3-word windows that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        own = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), "int64", n)
        if (v := len(ids)) < 2_000_000:
            key = (own[:-2] * v + own[1:-1]) * v + own[2:]
        else:  # too many words for one integer: name the pairs first
            pair = np.unique(own[:-1] * v + own[1:], return_inverse=True)[1]
            key = pair[:-1] * v + own[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """rejects(features) is true for a document that must go."""

    name: str
    rejects: Callable[[Features], bool]


#: The rules of the base: too few words, or more than half of them in repeated windows.
BASE = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: Wide limits: prose stays far inside them.
MORE = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("marks", lambda f: 2 * f.n_marks > f.n_words),
    Rule("repeated_lines", lambda f: len(f.lines) >= 4 and 100 * f.n_dup_lines > 45 * len(f.lines)),
    Rule("word_length", lambda f: not 1.5 * f.n_words <= f.word_chars <= 25 * f.n_words),
)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) on a sample of docs(text), the best first.

    Each rule is timed on features of its own.  The sample is drawn by a hash of the
    text; only one row per rule comes to the driver.
    """

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rule in rules:
                began = time.perf_counter()
                out.append((rule.name, sum(bool(rule.rejects(Features(t))) for t in pdf["text"]), time.perf_counter() - began, len(pdf)))
            yield pd.DataFrame(out, columns=["rule", "rejected", "seconds", "n"])

    drawn = docs.select(utf8("text").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).limit(sample)
    rows = drawn.mapInPandas(measured, "rule string, rejected long, seconds double, n long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("rejected", "seconds", "n"))).collect()
    found = {r["rule"]: (r["seconds"] / max(r["n"], 1), r["rejected"] / max(r["n"], 1)) for r in rows}
    known = [(rule.name, *found.get(rule.name, (0.0, 0.0))) for rule in rules]
    return sorted(known, key=lambda x: -(x[2] / max(x[1], 1e-9)))


def cascade(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, report: Sequence[str] = (), sample: int = SAMPLE) -> DataFrame:
    """docs(text, ...) with kept, rejected_by and the reported features.

    A text is kept if no rule rejects it: rules run from the best to the worst by
    rejections per cost, and the first that rejects ends them.  rejected_by: the first
    of ``rules`` that rejects the text, whatever order the sample gave, null if kept.  A
    feature of report is computed for every row, whatever the cascade needed.  Null
    text counts as empty, so it has no words; equal rows have equal verdicts; an empty
    table gives an empty result.  Other columns are carried along; those with the names
    of new ones are replaced.
    """
    places = {r.name: k for k, r in enumerate(rules)}
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name, _, _ in estimate(docs, rules, sample)]
    kinds = {"kept": "boolean", "rejected_by": "string"} | dict.fromkeys(report, "long")
    kept_columns = [c for c in docs.columns if c.lower() not in kinds]
    source = docs.select(*kept_columns)
    bound_batches(docs.sparkSession)
    types = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {k: [] for k in kinds}
            for text in b.column("text").cast(pa.binary()).to_pylist():
                f = Features(text or b"")
                hit = next((rule.name for rule in ordered if rule.rejects(f)), None)
                by = hit and next(rule.name for rule in rules[: places[hit] + 1] if rule.name == hit or rule.rejects(f))
                for k, v in (("kept", by is None), ("rejected_by", by), *((k, getattr(f, k)) for k in report)):
                    found[k].append(v)
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, types[kinds[k]]) for k, v in found.items())], names=[*names, *kinds])

    schema = ", ".join(f"`{c}` {t}" for c, t in [*source.dtypes, *kinds.items()])
    return source.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the features of the base, base_failed, kept, rejected_by: the cascade with every base feature."""
    return cascade(docs.select("doc_id", "text"), report=BASE_COLUMNS, sample=sample).select("doc_id", *BASE_COLUMNS, base_failed().alias("base_failed"), "kept", "rejected_by")
