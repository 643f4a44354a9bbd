"""P5: parser for question / choices / answer replies.

A reply looks like ``... Q: <question> Choices: <a, b, c> A: <answer>\\n ...``.
Parts are the pieces after the first ``"Q: "``.  For each part the question is
the text before the first ``"Choices: "``, the choices the text between it and
the next ``"Choices: "`` cut at the first ``"A: "``, the answer the text after
the part's first ``"A: "`` up to the end of that line.  Parsing stops at the
first part that lacks either marker; earlier parts are kept and the row is
flagged as an anomaly.  A missing reply is an anomaly with empty lists; a
reply without any ``"Q: "`` is not.

Field extraction uses ``instr`` / ``substring_index`` (no regular
expressions); the only regex split is the one that cuts the reply into parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.functions.text import _col, strip

# The markers the question-generation replies use.
Q_MARK = "Q: "
CHOICES_MARK = "Choices: "
A_MARK = "A: "

_BIG = 1 << 30


def _after_first(x: Column, mark: str) -> Column:
    """``x.split(mark)[1]`` for a part known to contain ``mark``."""
    return F.substring_index(x.substr(F.instr(x, mark) + F.lit(len(mark)), F.lit(_BIG)), mark, 1)


def _question(x: Column) -> Column:
    return strip(F.substring_index(x, CHOICES_MARK, 1))


def _choices(x: Column) -> Column:
    return strip(F.substring_index(_after_first(x, CHOICES_MARK), A_MARK, 1))


def _answer(x: Column) -> Column:
    return strip(F.substring_index(_after_first(x, A_MARK), "\n", 1))


def _parts(t: Column) -> Column:
    pieces = F.split(t, Q_MARK)
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def _first_bad(parts: Column) -> Column:
    """1-based position of the first part missing a marker, 0 when none."""
    bad = F.transform(parts, lambda x: (F.instr(x, CHOICES_MARK) == 0) | (F.instr(x, A_MARK) == 0))
    return F.coalesce(F.array_position(bad, True), F.lit(0))


def _good(parts: Column, first_bad: Column) -> Column:
    return F.coalesce(F.when(first_bad == 0, parts).otherwise(F.slice(parts, 1, (first_bad - 1).cast("int"))),
                      F.array())


def _fields(good: Column) -> Column:
    return F.struct(F.transform(good, _question).alias("questions"),
                    F.transform(good, _choices).alias("choices"),
                    F.transform(good, _answer).alias("answers"))


def parse_qca(c) -> Column:
    """Single-expression form: ``struct<questions, choices, answers, anomaly>``.
    Prefer :func:`with_qca` on large inputs — it evaluates the split once."""
    t = _col(c)
    parts = _parts(t)
    fb = _first_bad(parts)
    f = _fields(_good(parts, fb))
    return F.struct(f["questions"].alias("questions"), f["choices"].alias("choices"),
                    f["answers"].alias("answers"), (t.isNull() | (fb > 0)).alias("anomaly"))


def with_qca(df: DataFrame, reply: str, out: str = "qca", anomaly: str = "anomaly") -> DataFrame:
    """Add ``out`` (questions / choices / answers) and ``anomaly`` columns.

    Staged projections: Catalyst does not collapse a projection whose
    non-trivial expression would be duplicated, so the split runs once per
    row.  Markers are checked with two ``instr`` calls per part; the three
    fields are extracted only for the parts before the first bad one."""
    staged = df.withColumn("_qca_parts", _parts(F.col(reply)))
    staged = staged.withColumn("_qca_bad", _first_bad(F.col("_qca_parts")))
    staged = staged.withColumn("_qca_good", _good(F.col("_qca_parts"), F.col("_qca_bad")))
    return (staged.withColumn(out, _fields(F.col("_qca_good")))
                  .withColumn(anomaly, F.col(reply).isNull() | (F.col("_qca_bad") > 0))
                  .drop("_qca_parts", "_qca_bad", "_qca_good"))


def choice_list(c) -> Column:
    """Choices are stored as one comma-joined string; split and strip them."""
    return F.transform(F.split(_col(c), ","), strip)
