"""Rule bitmask ledger: every rule is evaluated once, policies and ablations only combine bits.

``ledger`` measures each text once and stores the measurements with one bit for each failed rule. ``apply_policy`` gives
a versioned policy's verdicts from the bits alone, ``ablation`` the effect of leaving each rule out, from counts by
distinct bit pattern (at most 2 ** len(RULES) groups, however many rows there are).

Defined results: a null or empty text, or one of white space alone, has no words, so every measurement is 0 and the rule
``few_words`` fails; so for a table of such texts alone. A null id stays null. Equal rows are judged each on its own, row by row. Texts of any length are measured whole. An empty
table gives an empty ledger. Columns of the input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkit
from .common import texts, with_rest, without_rest

#: Words of one window of the repetition rule.
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rule name -> condition of failure over the measurements. The place in this list is the rule's bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "many_words": "n_words > 1000000",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: Version -> rules whose failure rejects a text.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words", "many_words"),
    # Length alone rejects no text: many_words is recorded only.
    "v3": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
}
CURRENT = "v3"


def mask(version: str) -> int:
    return sum(BITS[name] for name in POLICIES[version])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id and the measurements of each row, and its columns from the third on, before which the text stays if there are any."""
    for rows, data, offs in textkit.blocks(batches):
        words = textkit.Words(data, offs)
        n = rows.num_rows
        n_words = np.diff(words.first)
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(words.black & ((data & 0xC0) != 0x80), out=letters[1:])
        symbols = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_SYMBOL[data], out=symbols[1:])
        at = words.runs(WINDOW)
        marks = np.zeros(len(words.start), bool)
        marks[at] = textkit.twice(textkit.by_row(words.row[at], textkit.window_numbers(words.number[0], WINDOW)[at]))
        again = textkit.covered(marks, WINDOW, words.first[:-1], words.row)
        # Lines: a word's line is the count of line feeds before it; only lines with a word matter.
        feeds = np.flatnonzero(data == 10)
        line_start = np.unique(np.concatenate([offs[:-1], feeds + 1]))
        line_start = line_start[line_start < len(data)]
        line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
        line_row = np.searchsorted(offs, line_start, "right") - 1
        line_end = line_end - (data[line_end - 1] == 10)
        full = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
        line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
        keys = textkit.by_row(line_row, textkit.numbered(data, line_start, line_end)[0])
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                *map(
                    pa.array,
                    (
                        n_words.astype(np.int64),
                        letters[offs[1:]] - letters[offs[:-1]],
                        symbols[offs[1:]] - symbols[offs[:-1]],
                        np.bincount(line_row[textkit.later(keys)], minlength=n).astype(np.int64),
                        np.bincount(words.row[again], minlength=n).astype(np.int64),
                        np.bincount(line_row, minlength=n).astype(np.int64),
                    ),
                ),
                *rows.columns[1 if rows.num_columns > 2 else 2 :],
            ],
            names=["doc_id", *MEASURES, *rows.schema.names[1 if rows.num_columns > 2 else 2 :]],
        )


_LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
_FAILED = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]}L ELSE 0L END" for name, rule in RULES.items())


def ledger(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: a bit for each rule that the text fails."""
    return texts(docs, id_column, text).mapInArrow(_measure, _LEDGER).withColumn("failed", F.expr(_FAILED))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    base = sum(BITS[name] for name in BASE)
    return rows.withColumns({"base_failed": F.col("failed").bitwiseAND(F.lit(base)) != 0, "kept": F.col("failed").bitwiseAND(F.lit(mask(version) | base)) == 0})


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: texts that fail it, and texts that the policy would keep but for this rule alone."""
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    active = mask(version)
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).alias("bit")) for name in POLICIES[version]]))
    each = patterns.withColumn("r", rules).select("failed", "n", "r.rule", "r.bit")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.lit(active)) == F.col("bit")
    return each.groupBy("rule").agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"))


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` whose text passes the policy, judged in one pass, with nothing shuffled."""
    rows = with_rest(docs)
    schema = StructType([*StructType.fromDDL(_LEDGER).fields, rows.schema["text"], rows.schema["rest"]])
    judged = apply_policy(rows.mapInArrow(_measure, schema).withColumn("failed", F.expr(_FAILED)), version)
    return without_rest(judged.filter("kept"), docs.columns)
