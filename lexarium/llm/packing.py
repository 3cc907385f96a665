"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its pieces best-fit-decreasing, in blocks of bounded size: nearly full bins are final, underfull
bins go on as items to the next block. The underfull bins of all partitions are then merged as items in a tree of rounds
whose tasks each hold a bounded number of them, until a round no longer lowers their number.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import plain, written
from .bpe import byte_letters

#: Pieces or bins that are packed in one go, and at most held by a task of a later round.
BLOCK_ITEMS = 8192
#: Longest run of white space, in characters, that `tiktoken` is given; its pattern fails on runs of a million.
LONGEST_SPACE = 100_000
# Fixed value: what the `ByteLevel` pre-tokenizer takes for words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """Ids (little-endian 32-bit) by a byte-level BPE file of the `tokenizers` library.

    If the vocabulary's ids follow its merges, `tiktoken` gives the same ids sooner, word after word without a cache that grows.
    Texts that hold a special token, or a run of white space too long for its pattern, go to `tokenizers` itself.
    """

    def __init__(self, definition: str):
        import tokenizers

        spec = json.loads(definition)
        self.library = tokenizers.Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        ids = [vocab.get(m, -1) for m in merges]
        byte = {c: b for b, c in enumerate(byte_letters())}
        by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
        self.fast = None
        if by_words and ids == sorted(set(ids)) and len(vocab) == len(merges) + 256 and all(c in vocab for c in byte):
            import tiktoken

            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        spaced = len(text) >= LONGEST_SPACE and any(m.end() - m.start() >= LONGEST_SPACE for m in re.finditer(r"\s+", text))
        if self.fast is None or spaced or any(t in text for t in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) of each document's tokens and the end id.

    A document of more than capacity tokens is cut from its end into pieces of capacity; its first piece has the rest. A null or
    empty text is the end id alone. Rows that repeat an id are documents of their own, null ids too; an empty table gives no
    rows, and further columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_column].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa

        tokenizer = ByteTokenizer(definition.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, 1024):
                rows: list[tuple] = []
                for doc_id, text in zip(ids[at : at + 1024], texts.slice(at, 1024).to_pylist(), strict=True):
                    tokens = memoryview(tokenizer.encode(text or "") + end)
                    n, start, piece = len(tokens) // 4, 0, 0
                    length = n if n <= capacity else n % capacity or capacity
                    while start < n:
                        rows.append((doc_id, piece, start, length, zlib.crc32(tokens[4 * start : 4 * (start + length)])))
                        start, piece, length = start + length, piece + 1, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Best-fit-decreasing of one block after another; bins left with at most `slack` are closed."""

    def __init__(self, capacity: int, slack: int):
        self.capacity, self.slack = capacity, slack

    def pack(self, sizes: list[int]) -> tuple[list[int], list[int], list[int]]:
        """For each item its bin and its offset there, and the fill of each bin."""
        capacity = self.capacity
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        open_rooms = 0  # bit r: a bin has room r
        bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            size = sizes[i]
            fits = open_rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
            else:
                b, room = len(fills), capacity
                fills.append(0)
            bins[i], offsets[i] = b, fills[b]
            fills[b] += size
            if left := room - size:
                by_room[left].append(b)
                open_rooms |= 1 << left
        return bins, offsets, fills


def _round(items: DataFrame, columns: list[str], size: str, capacity: int, slack: int, round_: int) -> DataFrame:
    """Packs the items of each partition, block by block; rows of kind 0: an item with its bin and offset, of kind 1: an underfull bin.

    An underfull bin of a block is an item of the next block of the partition, whose rows then say where it went (kind 2).
    """
    # Rows of kinds 1 and 2 have no item: all columns are nullable.
    fields = [T.StructField(f.name, f.dataType) for f in items.select(*columns).schema]
    out = T.StructType(fields).add("kind", "integer").add("bin", "long").add("place", "long").add("fill", "long")

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        best, next_bin, held = BestFit(capacity, slack), (round_ << 56) | (task << 28), []  # held: underfull bins (id, fill)

        def emit(block, kind, bins, places, fills):
            n = len(bins)
            numbers = [pa.array(np.full(n, kind, np.int32)), pa.array(bins, pa.int64()), pa.array(places, pa.int64()), pa.array(fills, pa.int64())]
            columns_ = block.columns if block is not None else [pa.nulls(n, f) for f in kinds]
            return pa.RecordBatch.from_arrays([*columns_, *numbers], names=[*columns, "kind", "bin", "place", "fill"])

        kinds = None
        for batch in batches:
            kinds = batch.schema.types
            for at in range(0, batch.num_rows, BLOCK_ITEMS):
                block = batch.slice(at, BLOCK_ITEMS)
                sizes = block.column(columns.index(size)).to_pylist()
                bins, places, fills = best.pack([*sizes, *[f for _, f in held]])
                names = [next_bin + b for b in range(len(fills))]
                next_bin += len(fills)
                n = len(sizes)
                yield emit(block, 0, [names[b] for b in bins[:n]], places[:n], [0] * n)
                if held:
                    # kind 2: fill holds the bin that moved, bin and place where it is now
                    yield emit(None, 2, [names[b] for b in bins[n:]], places[n:], [h for h, _ in held])
                held = [(names[b], f) for b, f in enumerate(fills) if capacity - f > slack]
                if len(held) > BLOCK_ITEMS:
                    yield emit(None, 1, [h for h, _ in held], [0] * len(held), [f for _, f in held])
                    held = []
        if held:
            yield emit(None, 1, [h for h, _ in held], [0] * len(held), [f for _, f in held])

    return items.select(*columns).mapInArrow(pack, out)


def _moved(places: DataFrame, moves: DataFrame) -> DataFrame:
    """places (.., bin, place) after the bins have moved into others: moves (old, bin, place)."""
    to = moves.select(F.col("old").alias("bin"), F.col("bin").alias("_to"), F.col("place").alias("_at"))
    columns = places.columns
    out = places.join(to, "bin", "left").withColumns({"place": F.col("place") + F.coalesce("_at", F.lit(0)), "bin": F.coalesce("_to", "bin")})
    return out.select(*columns)


def best_fit_packing(pieces: DataFrame, capacity: int = 2048, slack: int = 16, size_column: str = "length", rounds: int = 12) -> DataFrame:
    """pieces with sequence_id and offset (long): sequences of at most capacity tokens, gapless from offset 0.

    Sizes must be from 1 to capacity. Bins with at most slack tokens left count as full. An empty table gives no rows;
    repeated rows are packed each on their own; ties go by place in the partition. Columns named sequence_id and offset
    are replaced. The merge tree ends where a round no longer lowers the number of underfull bins, or after `rounds` rounds: each
    divides that number by about BLOCK_ITEMS, so 12 leave none to merge, and what is left in the end are sequences of their own.
    """
    pieces, called = plain(pieces.drop("sequence_id", "offset"))
    size_column = called[size_column]
    pieces = written(pieces, "pieces")
    columns = pieces.columns
    # Enough items in a task for bins to fill up; no more tasks than that, and no shuffle.
    items = pieces.coalesce(max(1, -(-pieces.count() // BLOCK_ITEMS)))
    packed = written(_round(items, columns, size_column, capacity, slack, 0), "packed", ("kind",))
    placed = packed.filter("kind = 0").select(*columns, "bin", "place")
    # Chains of moves within a partition: each bin moves at most once a block.
    moves = packed.filter("kind = 2").select(F.col("fill").alias("old"), "bin", "place")
    under = packed.filter("kind = 1").select(F.col("bin").alias("item"), "fill")
    every = moves.withColumn("round", F.lit(0))
    count = under.count()
    for r in range(1, rounds):
        if count < 2:
            break
        tasks = -(-count // BLOCK_ITEMS)
        # The tree: a task gets as many bins as it may hold, so their number falls from round to round.
        packed = written(_round(under.withColumnRenamed("fill", "size").repartition(tasks, F.xxhash64("item", F.lit(r))), ["item", "size"], "size", capacity, slack, r), f"merged{r}", ("kind",))
        every = every.unionByName(packed.filter("kind = 0").select(F.col("item").alias("old"), "bin", "place", F.lit(r).alias("round")))
        every = every.unionByName(packed.filter("kind = 2").select(F.col("fill").alias("old"), "bin", "place", F.lit(r).alias("round")))
        under = packed.filter("kind = 1").select(F.col("bin").alias("item"), "fill")
        left = under.count()
        if left > 0.98 * count and tasks == 1 or left == count:
            break
        count = left
    steps = written(every.select("old", "bin", "place"), "moves")
    # Follow the chains by doubling: after i steps each move leads 2^i moves on.
    while True:
        further = steps.alias("a").join(steps.select(F.col("old").alias("bin"), F.col("bin").alias("_to"), F.col("place").alias("_at")).alias("b"), "bin", "left")
        doubled = written(further.select("old", F.coalesce("_to", "bin").alias("bin"), (F.col("place") + F.coalesce("_at", F.lit(0))).alias("place"), F.col("_to").isNotNull().alias("went")), "moves")
        steps = doubled.select("old", "bin", "place")
        if doubled.filter("went").isEmpty():
            break
    out = _moved(placed, steps)
    return out.select(*[F.col(c).alias(n) for n, c in called.items()], F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
