"""Several values packed in one field: one row per value with its position.

Fields are masked to *delimiter skeletons*, in which every run of ordinary characters (letters and digits) is one
`A`. There are far fewer skeletons than fields; each distinct one is resolved once to a splitting rule that names the
runs and literal characters of every value. Rules are joined back (broadcast where their counted number is small) and
applied by position with built-in functions, so no field passes through Python.

Splitting: what stands in quotes is one value; outside, every character that is not ordinary delimits. Enclosing quotes, brackets and outer blanks are no part of a value; values
are upper case; empty ones have no position. A quote that is never closed counts as a delimiter; a doubled quote
within quotes stands for itself.

Defined results: null, empty and blank fields give no rows; repeated rows count once; a null id gives no rows; texts of
any length are split whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import cut, small

ORDINARY = r"[\p{L}\p{N}]+"
#: Opening quotes with the quotes that close them.
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“”", "‘": "’", "«": "»", "`": "`"}
RULE = "array<array<struct<run:int,text:string>>>"


def skeleton(field: str) -> Column:
    return F.regexp_replace(F.col(field), ORDINARY, "A")


def _trimmed(piece: list[tuple[int, str]]) -> list[tuple[int, str]]:
    blank = lambda x: x[0] < 0 and x[1].isspace()
    while piece and blank(piece[0]):
        piece = piece[1:]
    while piece and blank(piece[-1]):
        piece = piece[:-1]
    return piece


def _closing(skel: str, i: int) -> int:
    """Where the quote opened at i is closed, -1 if nowhere; a doubled quote doesn't close."""
    c, j = skel[i], i + 1
    while j < len(skel):
        if skel[j] in QUOTES[c]:
            if j > i + 1 and skel[j] == c and skel[j + 1 : j + 2] == c:
                j += 1
            else:
                return j
        j += 1
    return -1


def splitting_rule(skel: str) -> list[list[tuple[int, str]]]:
    """Values of a skeleton, each as pieces: (number of the run, '') or (-1, literal character)."""
    out: list[list[tuple[int, str]]] = []
    piece: list[tuple[int, str]] = []
    run, i, n = 0, 0, len(skel)

    def close(kept: list[tuple[int, str]]) -> None:
        if any(r >= 0 for r, _ in kept):
            out.append(_trimmed(kept))

    while i < n:
        c = skel[i]
        if c == "A":
            piece.append((run, ""))
            run += 1
        elif c in QUOTES and not piece and (end := _closing(skel, i)) > 0:
            inner, j = [], i + 1
            while j < end:
                if skel[j] == "A":
                    inner.append((run, ""))
                    run += 1
                else:
                    inner.append((-1, skel[j]))
                    j += skel[j : j + 2] == c * 2
                j += 1
            close(inner)
            i = end
        else:
            close(piece)
            piece = []
        i += 1
    close(piece)
    return out


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(rule=[[[{"run": r, "text": t} for r, t in v] for v in splitting_rule(s)] for s in pdf["skel"]])


def packed_values(df: DataFrame, field: str, out: str) -> DataFrame:
    """df with `out`, the array of the field's values in order, null where it holds none; no row is moved but by a join on the skeleton."""
    rows = df.withColumn("_skel", F.when(F.col(field).rlike(ORDINARY), skeleton(field)))
    rules = cut(rows.where("_skel is not null").select(F.col("_skel").alias("skel")).distinct().mapInPandas(_resolve, f"skel string, rule {RULE}"))
    ruled = rows.join(small(rules, rules.count()), F.col("_skel") == F.col("skel"), "left")
    # Bound by a generator, so that the runs are extracted once a field and not once a piece.
    runs = F.when(F.col("rule").isNotNull(), F.regexp_extract_all(field, F.lit(f"({ORDINARY})"), 1))
    bound = ruled.withColumn("_runs", F.explode(F.array(runs)))
    value = F.transform("rule", lambda v: F.upper(F.concat_ws("", F.transform(v, lambda p: F.when(p.run >= 0, F.get("_runs", p.run)).otherwise(p.text)))))
    return bound.withColumn(out, value).drop("_skel", "skel", "rule", "_runs")


def split_packed(df: DataFrame, row_id: str, field: str) -> DataFrame:
    """(row_id, position, value) of every value packed in the field; see the module's docstring."""
    rows = df.select(F.col(row_id).alias("id"), F.col(field).alias("field")).where(F.col("id").isNotNull() & F.col("field").rlike(ORDINARY))
    listed = packed_values(rows, "field", "values")
    return listed.select(F.col("id").alias(row_id), F.posexplode("values").alias("position", "value")).select(row_id, (F.col("position") + 1).alias("position"), "value").distinct()
