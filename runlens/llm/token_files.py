"""Token ids in Arrow files of equal-length sequences, and reading them back."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.shared import batch, cut_lineage, filesystem, shared_folder, worker_texts
from runlens.llm.word_cache import word_cache

#: Ids of a sequence, sequences of a record batch.
SEQUENCE, BATCH_SEQUENCES = 2048, 256

_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
_SPANS = pa.schema([
    ("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())
])


class SequenceWriter:
    """Writes a stream of ids as an Arrow file whose rows are `ids` and `mask`, lists of fixed size.

    All rows have the same length and all batches but the last BATCH_SEQUENCES rows, so
    row i of the file lies at a computed place and can be used without a copy. Only the last row may hold padding, which its
    mask marks. A second file lists the documents and where they start.
    """

    def __init__(self, files, path: str, width: int):
        self.kind = np.dtype(f"<u{width}")
        item = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("ids", pa.list_(item, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.sink = files.open_output_stream(f"{path}.arrow")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = files.open_output_stream(f"{path}.docs.arrow")
        self.index = pa.ipc.new_file(self.index_sink, _DOCUMENTS)
        self.waiting, self.held, self.total, self.docs = [], 0, 0, 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.rows.append((doc_id, self.total, n))
        self.waiting.append(ids)
        self.held, self.total, self.docs = self.held + n, self.total + n, self.docs + 1
        if self.held >= SEQUENCE * BATCH_SEQUENCES:
            self._flush(self.held // (SEQUENCE * BATCH_SEQUENCES) * BATCH_SEQUENCES)

    def _flush(self, sequences: int) -> None:
        flat = np.frombuffer(b"".join(self.waiting), self.kind)
        for at in range(0, sequences, BATCH_SEQUENCES):
            take = min(BATCH_SEQUENCES, sequences - at) * SEQUENCE
            part = flat[at * SEQUENCE : at * SEQUENCE + take]
            mask = np.zeros(take, bool)
            mask[: len(part)] = True
            if len(part) < take:
                part = np.concatenate([part, np.zeros(take - len(part), self.kind)])
            self.file.write_batch(batch(
                self.schema, *(pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (part, mask))
            ))
        rest = flat[sequences * SEQUENCE :].tobytes()
        self.waiting, self.held = [rest], len(rest) // self.kind.itemsize
        if self.rows:
            self.index.write_batch(batch(_DOCUMENTS, *map(list, zip(*self.rows))))
            self.rows = []

    def close(self) -> None:
        self._flush(-(-self.held // SEQUENCE))
        for x in (self.file, self.index, self.sink, self.index_sink):
            x.close()


class SequenceFile:
    """Random access to a written file; a local one is mapped, not read."""

    def __init__(self, path: str):
        files, place = filesystem(path)
        self.source = pa.memory_map(f"{place}.arrow") if files.type_name == "local" else files.open_input_file(f"{place}.arrow")
        self.file = pa.ipc.open_file(self.source)
        with files.open_input_file(f"{place}.docs.arrow") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self._held = (-1, None)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self._held[0] != k:
            self._held = (k, self.file.get_batch(k))
        return self._held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view, no copy) and mask of one sequence, from the batch and place that its number gives."""
        k, i = divmod(i, BATCH_SEQUENCES)
        b = self._batch(k)
        at = slice(i * SEQUENCE, (i + 1) * SEQUENCE)
        return b.column(0).values.to_numpy()[at], b.column(1).values[at]

    def documents(self):
        """(doc_id, start, ids) of every document, in the order of the file; one batch is held at a time."""
        k, begin, flat = -1, 0, np.zeros(0, np.uint16)
        for row in zip(*(self.docs.column(c).to_pylist() for c in _DOCUMENTS.names)):
            doc_id, start, n = row
            parts, need = [], n
            while need:
                if start >= begin + len(flat):
                    begin, k = begin + len(flat), k + 1
                    flat = self._batch(k).column(0).values.to_numpy()
                    continue
                part = flat[start - begin : start - begin + need]
                parts.append(part)
                start, need = start + len(part), need - len(part)
            yield doc_id, row[1], np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes every text's ids and `end_id`, in ascending order of the id column; returns the manifest.

    The manifest has one row per file: part (files follow each other in its
    order), path, n_tokens, n_docs. Each file is one range of ids and is written
    by one task under a name of its own, so a task that runs again cannot disturb
    a file that counts: only files in the manifest do. Null ids come first; rows
    with one id follow each other by a hash of the text and are dealt out by it
    too, so an id that many rows share is no hot range. Null texts are empty: they
    give `end_id` only. An empty table gives no file. `tokenizer` must be a file
    every executor has.
    """

    def written(batches):
        writer = path = None
        part = TaskContext.get().partitionId()
        files, place = filesystem(folder)
        for b in batches:
            cache = word_cache(tokenizer, spaces=False, lower=True)
            if writer is None:
                files.create_dir(place, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                path, writer = f"{folder}/{name}", SequenceWriter(files, f"{place}/{name}", cache.width)
            end = int(end_id).to_bytes(cache.width, "little")
            ids = cache.encode([t.decode() for t in b.column("text").to_pylist()])
            for doc_id, found in zip(b.column("doc_id").to_pylist(), ids):
                writer.add(doc_id, found + end)
        if writer is not None:
            writer.close()
            yield batch(_MANIFEST, [part], [path], [writer.total], [writer.docs])

    rows = worker_texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return cut_lineage(rows.mapInArrow(written, "part int, path string, n_tokens long, n_docs long"))


def read_spans(manifest: DataFrame) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for part, path in zip(b.column("part").to_pylist(), b.column("path").to_pylist()):
                rows = [
                    (part, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, start, ids in SequenceFile(path).documents()
                ]
                for at in range(0, len(rows), 5000):
                    yield batch(_SPANS, *map(list, zip(*rows[at : at + 5000])))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = manifest.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    spans = manifest.select("part", "path").repartition(max(1, manifest.count())).mapInArrow(
        read, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    return spans.join(starts, "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_spans(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_spans(write_tokens(docs, tokenizer, end_id, folder))
