"""Fill-in-middle transformation of texts, by DuckDB SQL over Arrow batches inside the tasks.

A text is cut into units by a pattern, the units into prefix, middle and
suffix at two places that a SHA-256 of the document's id gives, and the three
are written with sentinels as psm (prefix, suffix, middle) or spm (suffix,
prefix, middle), or the text stays plain. Each task registers one slice of a
batch at a time, about a megabyte of text or one longer text, with a DuckDB
connection of its own, which runs one thread, has a memory limit and writes no
files; the result goes back to Spark as Arrow. No row is shuffled.

Defined results: a null text counts as empty; an empty text, one that holds a
sentinel, and one that the pattern does not tile stay plain, with null prefix
and middle; a null doc_id is hashed as the word null; repeated rows are each
transformed, alike; a text of any length is one text, as far as the memory
limit goes (about 30 bytes a unit).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.arrow_text import chunks, text_view

#: One code point is a unit.
CODE_POINT = "(?s)."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred of those so many have their suffix first.
RATE, SPM_RATE = 90, 20
MEMORY = "1GB"

#: What a task can return of a row: kind and SQL over the columns of ``_SQL``.
COLUMNS = {
    "doc_id": ("long", "doc_id"),
    "n": ("long", "n"),
    "form": ("string", "form"),
    "prefix_chars": ("long", "CASE WHEN form <> 'plain' THEN length(prefix) END"),
    "middle_chars": ("long", "CASE WHEN form <> 'plain' THEN length(middle) END"),
    "output": ("string", "output"),
    "output_sha256": ("string", "sha256(output)"),
    "restored": ("string", "restored"),
    "restored_sha256": ("string", "sha256(restored)"),
}
TEXTS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
DIGESTS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")

#: The text from an output and its form: sentinels stand nowhere else, so splitting at them undoes the writing.
_RESTORED = f"""
CASE form
    WHEN 'psm' THEN substr(string_split(output, '{SUFFIX}')[1], {len(PREFIX) + 1})
        || string_split(output, '{MIDDLE}')[2]
        || string_split(string_split(output, '{SUFFIX}')[2], '{MIDDLE}')[1]
    WHEN 'spm' THEN string_split(string_split(output, '{PREFIX}')[2], '{MIDDLE}')[1]
        || string_split(output, '{MIDDLE}')[2]
        || substr(string_split(output, '{PREFIX}')[1], {len(SUFFIX) + 1})
    ELSE output
END"""

_SQL = f"""
WITH cut AS (
    SELECT doc_id, text, regexp_extract_all(text, $unit) AS units, sha256($seed || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h
    FROM slice),
drawn AS (
    SELECT *, len(units) AS n, $tiles OR array_to_string(units, '') = text AS whole,
        [('0x' || h[8 * k - 7:8 * k])::UBIGINT FOR k IN [1, 2, 3, 4]] AS draws
    FROM cut),
placed AS (
    SELECT doc_id, text, units, n,
        least(draws[1] % (n + 1), draws[2] % (n + 1))::BIGINT AS first_end, greatest(draws[1] % (n + 1), draws[2] % (n + 1))::BIGINT AS second_end,
        CASE WHEN n = 0 OR NOT whole OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR draws[3] % 100 >= $rate THEN 'plain'
            WHEN draws[4] % 100 < $spm_rate THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT doc_id, text, n, form,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, first_end), '') END AS prefix,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, first_end + 1, second_end), '') END AS middle,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, second_end + 1, n), '') END AS suffix
    FROM placed),
written AS (
    SELECT *, CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
        WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END AS output
    FROM parts),
done AS (SELECT *, {_RESTORED} AS restored FROM written)
"""


def connection(memory: str = MEMORY):
    """A DuckDB connection for one task: one thread, bounded memory, nothing on disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})


def _answer(sql: str, columns: Sequence[str]):
    """A function from a connection, part of a batch and parameters to the rows of ``sql``, which reads the part as ``slice``."""
    schema = pa.schema([(c, {"long": pa.int64(), "string": pa.string()}[COLUMNS[c][0]]) for c in columns])

    def run(con, rows: pa.RecordBatch, values: dict | None = None) -> list[pa.RecordBatch]:
        con.register("slice", pa.Table.from_batches([rows]))
        out = con.sql(sql, params=values).to_arrow_table()
        con.unregister("slice")
        return out.cast(schema).combine_chunks().to_batches()

    return run


def transform(
    documents: DataFrame, columns: Sequence[str] = TEXTS, *, unit: str = CODE_POINT, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, memory: str = MEMORY
) -> DataFrame:
    """Per document the ``columns`` asked for, of COLUMNS: length in units, form, lengths of prefix and middle in characters, output and the text rebuilt from it."""
    chosen = ", ".join(f"{COLUMNS[c][1]} AS {c}" for c in columns)
    answer = _answer(f"{_SQL} SELECT {chosen} FROM done", columns)
    values = {"unit": unit, "seed": str(seed), "rate": rate, "spm_rate": spm_rate, "tiles": unit == CODE_POINT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with connection(memory) as con:
            for batch in batches:
                text = batch.column(1).fill_null("")
                rows = pa.RecordBatch.from_arrays([batch.column(0), text], names=["doc_id", "text"])
                for lo, hi in chunks(text_view(text)[1]):
                    yield from answer(con, rows.slice(lo, hi - lo), values)

    return documents.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))


def restore(outputs: DataFrame, memory: str = MEMORY) -> DataFrame:
    """doc_id and text of rows with doc_id, output and form; a null output gives a null text."""
    sql = f"SELECT doc_id, {_RESTORED} AS restored FROM slice"
    answer = _answer(sql, ("doc_id", "restored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with connection(memory) as con:
            for batch in batches:
                for lo, hi in chunks(text_view(batch.column(1))[1]):
                    yield from answer(con, batch.slice(lo, hi - lo))

    return outputs.select("doc_id", "output", "form").mapInArrow(run, "doc_id long, restored string").withColumnRenamed("restored", "text")
