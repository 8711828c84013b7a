"""Line-first cleaning: judge every line, drop the failures, then reject documents that lost too much.

A line (``\\n``-split, at least one word) fails when a rule of :class:`LineRules` holds:

* punctuation - more than ``symbols_per_100_words`` of ``[#*$%&|<>]`` or more than
  ``bangs_per_100_words`` exclamation marks for every hundred words;
* navigation - at most ``nav_words`` words and no closing punctuation of any script (menus, breadcrumbs, buttons);
* boilerplate - at most ``boiler_words`` words and one of :data:`BOILERPLATE` inside.

A document is kept when its base statistics pass and failed lines hold at most ``max_lost_percent``
of its words. Null or empty texts have no words: base_failed, not kept. Repeated rows are judged each
on its own; extra columns of the input are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import slices, texts

SYMBOLS = "#*$%&|<>"
#: Marks that close a sentence: Latin, then CJK, Arabic, Indic, Armenian, Ethiopic and Khmer ones.
CLOSERS = ".!?…:;\"'”’»)]" "。！？．：；｡」』）】》〉" "؟؛۔" "।॥" "։՞՜" "።፧" "។៕"
#: Fixed phrases, matched in ASCII lower case.
BOILERPLATE = (
    "all rights reserved",
    "copyright",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie",
    "javascript",
    "licensed under",
    "spdx-license-identifier",
    "permission is hereby granted",
    "subscribe",
    "sign up",
    "log in",
    "click here",
    "read more",
    "lorem ipsum",
)
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))
_UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@dataclass(frozen=True)
class LineRules:
    symbols_per_100_words: int = 20
    bangs_per_100_words: int = 50
    nav_words: int = 4
    boiler_words: int = 40
    max_lost_percent: int = 50


def words_of(text: str) -> list[bytes]:
    """Maximal runs without the ASCII white space 0x20, 0x09-0x0D, as UTF-8 (bytes.split knows just these)."""
    return text.encode("utf-8", "surrogatepass").split()


def line_fails(line: str, n_words: int, rules: LineRules) -> bool:
    """The verdict of the three rules on one line of ``n_words`` words."""
    if 100 * sum(map(line.count, SYMBOLS)) > rules.symbols_per_100_words * n_words:
        return True
    if 100 * line.count("!") > rules.bangs_per_100_words * n_words:
        return True
    if n_words <= rules.nav_words and line.rstrip(" \t\n\v\f\r")[-1] not in CLOSERS:
        return True
    return n_words <= rules.boiler_words and bool(_BOILER.search(line.translate(_UPPER)))


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a three-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
    key = pair[:-1] * len(ids) + seq[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def judge(text: str | None, rules: LineRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, cleaned text)."""
    text = text or ""
    lines = text.split("\n")
    words, seen, kept_lines = [], set(), []
    dup = lost = 0
    for line in lines:
        own = words_of(line)
        if not own:
            kept_lines.append(line)
            continue
        words += own
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, len(own), rules):
            lost += len(own)
        else:
            kept_lines.append(line)
    n = len(words)
    repeat = repeated_words(words)
    base_failed = n < 50 or 100 * repeat > 50 * n
    kept = not base_failed and 100 * lost <= rules.max_lost_percent * n
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, base_failed, kept, lost, "\n".join(kept_lines)


STATS = (
    ("n_words", pa.int64(), "bigint"),
    ("word_chars", pa.int64(), "bigint"),
    ("n_symbols", pa.int64(), "bigint"),
    ("n_dup_lines", pa.int64(), "bigint"),
    ("n_repeat_words", pa.int64(), "bigint"),
    ("base_failed", pa.bool_(), "boolean"),
    ("kept", pa.bool_(), "boolean"),
    ("lost_words", pa.int64(), "bigint"),
    ("clean_text", pa.string(), "string"),
)


def apply_rules(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), with_text: bool = True, rules: LineRules = LineRules()) -> DataFrame:
    """``carry`` columns of every row, its statistics and verdict, and (``with_text``) the cleaned text."""
    stats = STATS if with_text else STATS[:-1]
    slim = texts(docs).select(*[F.col(c) for c in carry], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [judge(t, rules)[: len(stats)] for t in batch.column(len(carry)).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(stats)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(carry))] + [pa.array(c, t) for c, (_, t, _) in zip(cols, stats)],
                names=[*carry, *(name for name, _, _ in stats)],
            )

    fields = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in carry] + [f"{n} {t}" for n, _, t in stats])
    return slim.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The pipeline's form: kept documents with their failing lines removed, in the columns of ``documents``."""
    out = apply_rules(docs, carry=("doc_id", "lang", "source", "n_chars"), rules=rules).where("kept")
    return out.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("bigint").alias("n_chars"))
