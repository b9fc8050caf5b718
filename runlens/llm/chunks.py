"""Dictionaries per chunk of the input: facts about words brought to the rows without moving the texts.

A chunk is a run of rows that lie next to each other in an input file. Its distinct words leave it, are joined
with what is known of them, and come back as a file for that chunk, which the
task that reads the rows again loads. Neither texts nor word occurrences are
shuffled, and nothing is broadcast; a dictionary is bounded by its chunk.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.shared import cut_lineage, filesystem, shared_folder, worker_texts

#: Distinct words a task gathers before it hands them on (a word may then come twice).
FLUSH_WORDS = 600_000
#: Rows next to each other in a file that `placed` gives one chunk.
CHUNK_ROWS = 1 << 13
#: Bits of the size of a text from which its span has fewer rows.
SPAN_BITS = 14


def _place(docs: DataFrame) -> tuple[DataFrame, Column]:
    """`docs`, and where each row lies: the Parquet file and the number of the row in it.

    Rows that do not lie in Parquet files, or are behind a join or an aggregate, are
    written to some first.
    """
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["row_index"])
    except AnalysisException:
        docs = cut_lineage(docs)
        place = docs.metadataColumn("_metadata")
    return docs, place


def placed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """`docs`, and a column that names the chunk of each row by its file and its place among the file's rows.

    Unlike a split, which follows the cores alive when a scan is planned, such a
    chunk is the same in every scan.
    """
    docs, place = _place(docs)
    return docs, F.xxhash64(place["file_path"], F.floor(place["row_index"] / CHUNK_ROWS)).alias("chunk")


def _span(place: Column, text: Column) -> Column:
    """Names the span of a row: the rows of its chunk, but of texts over 16 KB only half as many, over 32 KB a quarter and so on.

    A span holds 128 MB of text at most (or one text), whatever the texts' sizes; a chunk, only so many rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    halved = F.when(size < 1 << SPAN_BITS, 0).otherwise(F.length(F.bin(F.shiftright(size, SPAN_BITS))))
    rows = F.greatest(F.lit(1), F.floor(F.lit(CHUNK_ROWS) / F.pow(F.lit(2), halved)))
    return F.xxhash64(place["file_path"], halved, F.floor(place["row_index"] / rows))


def chunked(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """doc_id, text, chunk, span (and `more`) of every row; chunk as `placed` has it.

    `span` serves facts whose number grows with the texts, not with their words (see `_span`). Both are the same in
    every scan. They are named by hashes, and should two names meet, the two share a dictionary.
    """
    more = [m.alias(f"more_{i}") for i, m in enumerate(more)]
    docs, place = _place(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more))
    chunk = F.xxhash64(place["file_path"], F.floor(place["row_index"] / CHUNK_ROWS)).alias("chunk")
    span = _span(place, F.col("text")).alias("span")
    return worker_texts(docs, "doc_id", "text", chunk, span, *[F.col(f"more_{i}") for i in range(len(more))])


def parts(b: pa.RecordBatch):
    """A batch cut where the chunk changes: (chunk, rows)."""
    names = b.column("chunk").to_pylist()
    at = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[at]:
            yield names[at], b.slice(at, i - at)
            at = i


def write_dictionary(words: DataFrame, name: str) -> str:
    """Writes (chunk, ...) rows as one folder per chunk and returns the folder above them."""
    folder = shared_folder(words.sparkSession, name)
    words.repartition("chunk").write.partitionBy("chunk").parquet(folder)
    return folder


class Dictionaries:
    """A task's view of the dictionaries: the one of the chunk at hand."""

    def __init__(self, folder: str, make):
        self.folder, self.make, self.held = folder, make, (None, None)

    def __getitem__(self, chunk: int):
        """The chunk's dictionary; a chunk without one is an error."""
        if (found := self.get(chunk)) is None:
            raise KeyError(f"no dictionary for chunk {chunk} in {self.folder}")
        return found

    def get(self, chunk: int, other=None):
        if self.held[0] != chunk:
            self.held = (chunk, None)
            files, place = filesystem(f"{self.folder}/chunk={chunk}")
            if files.get_file_info(place).type != FileType.NotFound:
                self.held = (chunk, self.make(pq.read_table(place, filesystem=files, partitioning=None)))
        return other if self.held[1] is None else self.held[1]
