"""Token ids in bit- or byte-plane blocks.

Texts are encoded with a public tokenizer (a ``.tiktoken`` rank file, given by its path; none is trained here) and
the ids of a partition's documents are laid end to end, each document closed by ``end_id``, and cut into blocks of
``block_ids`` ids.  A block is transposed into planes: plane k holds bit k (or byte k) of every id.  Low planes look
random, high planes are nearly constant, and each is compressed by itself with zstandard.

One row is one block, and carries its share of the chunk index: which documents begin or go on in it, from which id
of theirs, where in the block and for how many ids.  A reader therefore finds a document's blocks by filtering the
index columns and decompresses nothing else; bit planes that are constant cost a few bytes.  Nothing is shuffled:
blocks are filled within a task, and a task that is run again yields the same rows.  The vocabulary is read once, on
the driver, and sent to the workers (a few MB).

Defined cases: null and empty texts have no ids but their closing ``end_id``, so every row of the table is in the
index; a row with a null doc_id is indexed under the null; repeated rows are written as often as they occur, in the
order of the table; a text of any length is encoded in whole and goes on over as many blocks as it needs; an empty
table has no blocks; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, pick, prepare, texts_of

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY, END_ID, BLOCK_IDS, LEVEL = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 1 << 16, 3
_SCHEMA = "partition int, block long, n_ids int, width int, planes array<binary>, doc_ids array<{id}>, doc_no array<bigint>, doc_from array<bigint>, doc_at array<int>, doc_n array<int>"


def encoder(ranks: bytes):
    """The tokenizer of a rank file's contents."""
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})


def width_of(largest: int) -> int:
    """Bytes of an id."""
    return 2 if largest < 1 << 16 else 4


def to_planes(ids: np.ndarray, width: int, mode: str, level: int = LEVEL) -> list[bytes]:
    import zstandard

    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(len(ids), width)
    if mode == "byte":
        planes = [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k]).tobytes() for k in range(8 * width)]
    compressor = zstandard.ZstdCompressor(level=level)
    return [compressor.compress(p) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, width: int) -> np.ndarray:
    """The ids of a block; its planes are bytes if there are ``width`` of them, else bits."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(d.decompress(p, max_output_size=n_ids + 8), np.uint8) for p in planes]
    if len(planes) == width:
        return np.stack(raw, axis=1).reshape(-1).view(f"<u{width}").astype(np.int64)
    bits = np.stack([np.unpackbits(p, count=n_ids) for p in raw], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(f"<u{width}").astype(np.int64)


def blocks_of(documents: Iterator[tuple[object, np.ndarray]], block_ids: int) -> Iterator[tuple]:
    """(ids, doc_ids, numbers, from, at, n) of each block of a run of (doc_id, ids)."""
    held: list[np.ndarray] = []
    index: tuple[list, ...] = ([], [], [], [], [])
    room = block_ids
    for number, (doc_id, ids) in enumerate(documents):
        done = 0
        while done < len(ids):
            take = min(room, len(ids) - done)
            held.append(ids[done : done + take])
            for column, value in zip(index, (doc_id, number, done, block_ids - room, take), strict=True):
                column.append(value)
            done += take
            room -= take
            if not room:
                yield (np.concatenate(held), *index)
                held, index, room = [], ([], [], [], [], []), block_ids
    if held:
        yield (np.concatenate(held), *index)


def _task(ranks, end_id: int, block_ids: int, mode: str, schema: pa.Schema, level: int):
    def task(batches):
        encode = encoder(ranks.value)
        width = width_of(max(end_id, encode.max_token_value))
        part = TaskContext.get().partitionId()

        def documents():
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                for doc_id, text in zip(ids, texts_of(batch), strict=True):
                    yield doc_id, np.array([*encode.encode_ordinary(text), end_id], np.uint32)

        for k, (ids, docs, number, begin, at, n) in enumerate(blocks_of(documents(), block_ids)):
            row = {"partition": part, "block": k, "n_ids": len(ids), "width": width, "planes": to_planes(ids, width, mode, level), "doc_ids": docs, "doc_no": number, "doc_from": begin, "doc_at": at, "doc_n": n}
            yield pa.RecordBatch.from_pylist([row], schema)

    return task


def write_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS, mode: str = "bit", level: int = LEVEL) -> DataFrame:
    """One row a block: its planes and its part of the index.  mode: 'bit' or 'byte'."""
    if mode not in ("bit", "byte"):
        raise ValueError(f"mode is 'bit' or 'byte', not {mode!r}")
    prepare(docs.sparkSession)
    own = pick(docs, doc_id="doc_id", text="text")
    kind = own.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema(
        [("partition", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()), ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(to_arrow_type(kind))), ("doc_no", pa.list_(pa.int64())), ("doc_from", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int32())), ("doc_n", pa.list_(pa.int32()))]
    )
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    return map_arrow(own, _task(ranks, end_id, block_ids, mode, schema, level), _SCHEMA.format(id=kind.simpleString()))


def read_documents(blocks: DataFrame) -> DataFrame:
    """(partition, doc_no, doc_id, ids) of every document in blocks, without the closing id; a document may span blocks."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = blocks.schema["doc_ids"].dataType.elementType
    out = pa.schema([("partition", pa.int32()), ("doc_no", pa.int64()), ("doc_id", to_arrow_type(kind)), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def task(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = from_planes(r["planes"], r["n_ids"], r["width"])
                index = zip(r["doc_ids"], r["doc_no"], r["doc_from"], r["doc_at"], r["doc_n"], strict=True)
                yield pa.RecordBatch.from_pylist([{"partition": r["partition"], "doc_no": k, "doc_id": d, "start": f, "ids": ids[a : a + n]} for d, k, f, a, n in index], out)

    parts = map_arrow(blocks, task, f"partition int, doc_no long, doc_id {kind.simpleString()}, start long, ids array<bigint>")
    whole = parts.groupBy("partition", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.select("partition", "doc_no", "doc_id", F.slice("ids", 1, F.size("ids") - 1).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as blocks of bit planes."""
    return write_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
