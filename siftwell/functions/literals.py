"""Many plain strings found in texts in one pass: an automaton (Aho-Corasick) runs over each text once, however many strings there are.

Texts go to Python in Arrow batches and only places of strings come back. A worker builds an automaton once. Up to ``PART`` strings travel
with the job and texts are not shuffled; a larger table is cut into parts of that size by a hash, texts meet each part in a bucket,
part first and texts streaming after, so that no task holds more than one part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings of one automaton (some hundred bytes each).
PART = 200_000

_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(strings: Sequence[str], name: str = "") -> ahocorasick.Automaton | None:
    if name not in _built:
        _built.clear()  # one at a time
        out = ahocorasick.Automaton()
        for i, s in enumerate(strings):
            if s:
                out.add_word(s, (i, len(s)))
        out.make_automaton()
        _built[name] = out
    return _built[name] if len(_built[name]) else None


def _places(found: ahocorasick.Automaton | None, text: str | None) -> list[int]:
    return sorted({i for _, (i, _) in found.iter(text)}) if found and text else []


def _in_word(c: str) -> bool:
    return c == "_" or c.isascii() and c.isalnum()


def _words(found: ahocorasick.Automaton | None, text: str | None, bounds: Sequence[int]) -> list[int]:
    """Twice the place of each string that the upper-cased text holds within its bounds, and one more where it surely is a word of its own."""
    if not found or not text:
        return []
    upper = text.upper()
    same = len(upper) == len(text)
    out: dict[int, int] = {}
    for end, (i, size) in found.iter(upper):
        if out.get(i) == 1:
            continue
        first, behind = end - size + 1, end + 1
        before, after = upper[first - 1] if first else " ", upper[behind] if behind < len(upper) else " "
        if bounds[i] & 1 and _in_word(before) or bounds[i] & 2 and _in_word(after):
            continue
        sure = same and before.isascii() and after.isascii() and not _in_word(before) and not _in_word(after) and text[first:behind].isascii()
        out[i] = int(sure)
    return sorted(2 * i + sure for i, sure in out.items())


def occurring(text: Column, strings: Sequence[str], bounds: Sequence[int] | None = None) -> Column:
    """Places in ``strings`` of those that a text contains, sorted (array of int; null has none; empty strings are never found).

    With ``bounds`` the strings are upper-case and texts are compared in upper case; a bound tells whether a string counts only where no ASCII letter,
    digit or underscore stands before (1), behind (2), or either (3). Places then come doubled, and one is added where the string surely
    is a word of its own: ASCII throughout, with ASCII that is no part of a word around it.
    """
    strings = list(strings)
    name = hashlib.sha256(json.dumps(strings).encode()).hexdigest()

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        found = _automaton(strings, name)
        return pd.Series([_places(found, t) if bounds is None else _words(found, t, bounds) for t in texts], dtype=object)

    return find(text)


def table_of(values: Sequence[str]) -> Column:
    """A constant array of many strings, as one literal (the optimizer folds it)."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, salt, id, text) in their order: strings of a part have no id and come first."""
    bucket, strings, found = None, [], None
    for batch in batches:
        ids, texts = [], []
        for part, salt, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (part, salt) != bucket:
                bucket, strings, found = (part, salt), [], None
            if key is None:
                strings.append(text)
                continue
            if found is None:
                _built.clear()
                found = _automaton(strings)
            for i in _places(found, text):
                ids.append(key)
                texts.append(strings[i])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "string"])
    _built.clear()


def matches(texts: DataFrame, strings: DataFrame, id_col: str, text_col: str, string_col: str) -> DataFrame:
    """(id, string) for every distinct string of a table that a text contains; ids as strings. Null and empty strings are never found."""
    spark = texts.sparkSession
    wanted = strings.select(F.col(string_col).alias("string")).where("string <> ''").distinct()
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    few = [r[0] for r in wanted.limit(PART + 1).collect()]
    if len(few) <= PART:
        few.sort()
        return rows.select("id", F.explode(occurring(F.col("text"), few)).alias("_i")).select("id", F.get(table_of(few), F.col("_i")).alias("string"))
    n = wanted.count()
    parts = -(-2 * n // PART)  # half full, so that a hash's uneven parts stay below the size
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    columns = ("part", "salt", "id", "text")
    asked = wanted.select(F.pmod(F.xxhash64("string"), F.lit(parts)).cast("int").alias("part"), every(salts).alias("salt"), F.lit(None).cast("string").alias("id"), F.col("string").alias("text"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).withColumn("part", every(parts))
    both = asked.select(*columns).unionByName(met.select(*columns))
    dealt = both.repartition("part", "salt").sortWithinPartitions("part", "salt", F.col("id").isNotNull())
    return dealt.mapInArrow(_streamed, "id string, string string")
