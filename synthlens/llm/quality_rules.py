"""Line-first quality cleaning.

Every line is judged on its own; failing lines are removed; then the
document is judged by what it lost. A line with words fails if it

- is *boilerplate*: fixed phrases, each on word boundaries, hold at least
  half of its words (a mention within prose does not count);
- is *navigation or symbols*: over 30% of its words hold one of the
  characters ``# * $ % & | < >``;
- is *shouting*: at least 4 words, over 60% of them with A-Z but no a-z;
- is a *repeat* of an earlier line of the document;
- lacks *punctuation*: fewer than 3 words and no sentence mark at its end.

A document is kept if the base rule passes and removed lines hold at most
40% of its words. Counts are over whole texts.

Cases: null and empty texts have no words, so the base rule fails; repeated
rows are judged alike; an empty table gives an empty result; only the named
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.llm.common import slices

SYMBOLS = b"#*$%&|<>"
# Phrases of boilerplate lines, lower case.
BOILERPLATE = (b"all rights reserved", b"privacy policy", b"terms of use", b"terms of service", b"cookie policy",
               b"click here", b"enable javascript", b"subscribe to our newsletter", b"sign in to", b"powered by")
# Marks that end a sentence.
ENDS = b".!?:;\"')]}"
BOILERPLATE_PERCENT = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 30
MAX_CAPITAL_PERCENT = 60
MIN_CAPITAL_WORDS = 4
MIN_LINE_WORDS = 3
MAX_LOST_PERCENT = 40

_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")
# A letter, digit or byte above ASCII beside a phrase makes it part of another word.
_PHRASE = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(map(re.escape, BOILERPLATE)) + rb")(?![0-9a-z\x80-\xff])")
_NOT_WORD = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed",
          "n_words_removed")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, until = 0, 0  # words before ``until`` are counted already
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def line_fails(line: bytes, words: list[bytes], seen: bool) -> bool:
    """Whether a line with words is removed."""
    n = len(words)
    if seen or 100 * sum(len(p.split()) for p in _PHRASE.findall(line.lower())) >= BOILERPLATE_PERCENT * n:
        return True
    if _SYMBOL.search(line) and 100 * sum(1 for w in words if _SYMBOL.search(w)) > MAX_SYMBOL_PERCENT * n:
        return True
    if n >= MIN_CAPITAL_WORDS and 100 * sum(map(bytes.isupper, words)) > MAX_CAPITAL_PERCENT * n:
        return True
    return n < MIN_LINE_WORDS and words[-1][-1] not in ENDS


def judge(text: str | None) -> tuple[list[int], bool, bool, str]:
    """(the counts of ``COUNTS``, base_failed, kept, cleaned text)."""
    text = text or ""
    seen: set[bytes] = set()
    left: list[bytes] = []
    words: list[bytes] = []
    dup = gone = gone_words = 0
    for line in text.encode("utf-8").split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        words += own
        again = line in seen
        dup += again
        seen.add(line)
        if line_fails(line, own, again):
            gone += 1
            gone_words += len(own)
        else:
            left.append(line)
    n = len(words)
    repeated = repeat_words(words)
    counts = [n, len(text) - sum(map(text.count, _NOT_WORD)), sum(map(text.count, SYMBOLS.decode())), dup, repeated,
              gone, gone_words]
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    kept = not base_failed and 100 * gone_words <= MAX_LOST_PERCENT * n
    return counts, base_failed, kept, b"\n".join(left).decode("utf-8") if gone else text


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """(doc_id, the counts, base_failed, kept[, clean_text]): one pass, no shuffle."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
                           *([T.StructField("clean_text", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [judge(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0)] + [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            cols += [pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_())]
            if with_text:
                cols.append(pa.array([r[3] for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The kept documents with their cleaned texts, every other column as it
    was (``chars_col``: set to the new length)."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [judge(t) for t in b.column(at).to_pylist()]
            b = b.set_column(at, text_col, pa.array([r[3] for r in rows], pa.string()))
            if chars_col in names:
                n = names.index(chars_col)
                b = b.set_column(n, chars_col, pa.array([len(r[3]) for r in rows], pa.int64()).cast(b.schema[n].type))
            yield b.filter(pa.array([r[2] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
