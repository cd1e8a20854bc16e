"""Vector bin packing of documents and of instruction data into token sequences.

Every example has a vector of sizes (tokens, segments, loss-bearing tokens) and
every sequence has capacities for them. The dot-product heuristic fills the
open sequence with the fitting example whose vector has the largest product
with the capacities that are left; when none fits, the sequence is closed.
Examples meet in groups of at most ``GROUP`` in the order of a task's rows, so a
task holds one group. Ids: a sequence's is the task's partition number times
2^33 plus its number there, so a task that runs again gives the same rows.

``pack_examples`` packs conversations. A segment is a turn with its end id, and
the turns of some roles bear loss, so the three limits differ. A conversation is
one example if it fits; else it is cut between turns into examples that do, and
a turn that alone breaks a limit is cut inside. Its turns meet in a task in
order, by blocks of BLOCK_TURNS turn numbers, so that one endless conversation
is many tasks' work: a conversation longer than a block is cut there, which is
above the segments that a sequence holds.

``pack_documents`` cuts freely: a document gives full sequences of its own, and
what is left of it is an example of one segment, all of whose tokens bear loss;
nothing is shuffled. A group's sequences are then topped up by cutting the
examples of its emptiest sequences; what remains is cut at powers of two, which
need no padding.

Defined cases: a null or empty text is its end id alone; documents and turns of
any length are cut; a null conv_id is a conversation of its own, a null turn
comes first, a null role bears no loss; repeated rows are packed each; ties go
to the earlier example; extra columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm import token_codes
from textloom.sources.tables import table

SEQUENCE, GROUP, END_ID = 2048, 2048, 1
#: Segments a sequence of documents may hold.
SEGMENTS = 256
#: Of instruction data: segments and loss-bearing tokens of a sequence, the roles that bear loss, turns that meet in a task.
TURNS, LOSS_TOKENS, LOSS_ROLES, BLOCK_TURNS = 32, 1024, ("assistant",), 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def dot_product_pack(sizes: np.ndarray, capacity: np.ndarray) -> list[list[int]]:
    """Bins of row numbers. sizes: examples x limits, each at most the capacity."""
    share = sizes / capacity
    # the products need floats; whether an example fits is decided in whole numbers
    todo = np.lexsort((np.arange(len(sizes)), -share.sum(1)))  # largest first, ties to the earlier
    share, left_sizes = share[todo], sizes[todo]
    alive, bins = np.ones(len(todo), bool), []
    first = 0
    while True:
        while first < len(todo) and not alive[first]:
            first += 1
        if first == len(todo):
            return bins
        alive[first] = False
        row, left = [int(todo[first])], capacity - left_sizes[first]
        while (left[0]) > 0:
            fits = alive[first:] & (left_sizes[first:] <= left).all(1)
            if not fits.any():
                break
            k = first + int(np.argmax(np.where(fits, share[first:] @ (left / capacity), -1.0)))
            alive[k] = False
            row.append(int(todo[k]))
            left = left - left_sizes[k]
        bins.append(row)


@dataclass
class Piece:
    doc: int | None
    start: int
    total: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.total, self.ids[:n]), Piece(self.doc, self.start + n, self.total, self.ids[n:])


def _size(row: list[Piece]) -> int:
    return sum(len(p.ids) for p in row)


def fill(bins: list[list[Piece]], length: int, segments: int) -> list[list[Piece]]:
    """Tops sequences up from the emptiest ones; the last remainder is cut at powers of two."""
    bins = sorted(bins, key=_size, reverse=True)
    loose: list[Piece] = []
    done, k, j = [], 0, len(bins) - 1
    while k <= j:
        row = bins[k]
        room = length - _size(row)
        while room and len(row) < segments and (loose or k < j):
            if not loose:
                loose, j = bins[j], j - 1
            p = loose.pop()
            if len(p.ids) > room:
                p, rest = p.cut(room)
                loose.append(rest)
            row.append(p)
            room -= len(p.ids)
        done.append(row)
        k += 1
    open_rows = [*([loose] if loose else [])]
    for row in [*done, *open_rows]:
        if (n := _size(row)) and n < length and n & (n - 1):
            rest, out = list(row), []
            row.clear()
            for bit in reversed(range(n.bit_length())):
                if n >> bit & 1:
                    need, part = 1 << bit, []
                    while need:
                        p = rest.pop()
                        if len(p.ids) > need:
                            p, q = p.cut(need)
                            rest.append(q)
                        part.append(p)
                        need -= len(p.ids)
                    out.append(part)
            open_rows += out
    return [r for r in [*done, *open_rows] if r]


@dataclass
class Packer:
    """Rows of SCHEMA from documents in turn; holds one group of examples."""

    length: int = SEQUENCE
    segments: int = SEGMENTS
    group: int = GROUP
    first_id: int = 0
    made: int = 0
    examples: list[Piece] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def _emit(self, row: list[Piece]) -> None:
        at = 0
        for p in row:
            crc = zlib.crc32(p.ids.astype("<u4").tobytes())
            self.rows.append((p.doc, p.start, len(p.ids), crc, p.total, self.first_id + self.made, at))
            at += len(p.ids)
        self.made += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        for a in range(0, n - self.length + 1, self.length):
            self._emit([Piece(doc, a, n, ids[a : a + self.length])])
        if n % self.length:
            a = n - n % self.length
            self.examples.append(Piece(doc, a, n, ids[a:].copy()))
        if len(self.examples) >= self.group:
            self.close()

    def close(self) -> None:
        if self.examples:
            n = np.array([len(p.ids) for p in self.examples])
            sizes = np.stack([n, np.ones_like(n), n], 1)
            bins = dot_product_pack(sizes, np.array([self.length, self.segments, self.length]))
            for row in fill([[self.examples[i] for i in b] for b in bins], self.length, self.segments):
                self._emit(row)
            self.examples = []

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, length: int = SEQUENCE, segments: int = SEGMENTS, group: int = GROUP) -> DataFrame:
    """(doc_id, text) to pieces of sequences; see SCHEMA."""
    storage.bounded_arrow_batches(docs.sparkSession)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = token_codes.encoder(path)
        packer = Packer(length, segments, group, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], code.dtype)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.take())) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for b in batches:
            ids = code.encode_many(b.column(1))
            for doc, x in zip(b.column(0).to_pylist(), ids):
                packer.add(doc, np.concatenate([x, end]))
            yield out()
        packer.close()
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


@dataclass
class Example:
    """Turns of one conversation that stay together: (conv_id, turn, start, length, ids_crc32, loss tokens)."""

    turns: list[tuple] = field(default_factory=list)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(3, np.int64))


@dataclass
class ExamplePacker:
    """Rows of EXAMPLE_SCHEMA from turns in order; holds one group of examples."""

    limits: np.ndarray
    group: int = GROUP
    first_id: int = 0
    made: int = 0
    conv: object = None
    open: Example | None = None
    examples: list[Example] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def add(self, conv: int | None, turn: int | None, ids: np.ndarray, bears_loss: bool) -> None:
        if conv is None or conv != self.conv:
            self.end()
        self.conv = conv
        most = int(min(self.limits[0], self.limits[2]) if bears_loss else self.limits[0])
        for start in range(0, len(ids), most):
            part = ids[start : start + most]
            need = np.array([len(part), 1, len(part) * bears_loss])
            if self.open and (self.open.sizes + need > self.limits).any():
                self.end()
            self.open = self.open or Example()
            self.open.turns.append((conv, turn, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(part) * bears_loss))
            self.open.sizes = self.open.sizes + need

    def end(self) -> None:
        if self.open:
            self.examples.append(self.open)
            self.open = None
        if len(self.examples) >= self.group:
            self.close()

    def close(self) -> None:
        if self.examples:
            for row in dot_product_pack(np.stack([e.sizes for e in self.examples]), self.limits):
                at, turns = 0, [t for i in row for t in self.examples[i].turns]
                for k, t in enumerate(turns):
                    self.rows.append((*t, self.first_id + self.made, k, at))
                    at += t[3]
                self.made += 1
            self.examples = []

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


EXAMPLE_SCHEMA = "conv_id long, turn long, start long, length long, ids_crc32 long, loss_tokens long, sequence_id long, segment long, offset long"


def pack_examples(
    turns: DataFrame, path: str, end_id: int = END_ID, length: int = SEQUENCE, segments: int = TURNS, loss_tokens: int = LOSS_TOKENS, loss_roles: tuple[str, ...] = LOSS_ROLES, group: int = GROUP
) -> DataFrame:
    """(conv_id, turn, role, text) to pieces of sequences within three limits; see EXAMPLE_SCHEMA."""
    storage.bounded_arrow_batches(turns.sparkSession)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in EXAMPLE_SCHEMA.split(", ")])
    limits = np.array([length, segments, loss_tokens])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = token_codes.encoder(path)
        packer = ExamplePacker(limits, group, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], code.dtype)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.take())) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for b in batches:
            for conv, turn, role, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), code.encode_many(b.column(3))):
                packer.add(conv, turn, np.concatenate([x, end]), role in loss_roles)
            yield out()
        packer.end()
        packer.close()
        yield out()

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    dealt = rows.repartition("conv_id", F.floor(F.col("turn") / BLOCK_TURNS), own)
    return dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]).mapInArrow(run, EXAMPLE_SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), token_codes.default_path())


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in sequences of at most 2048 tokens, 32 turns and 1024 tokens of assistant turns."""
    return pack_examples(table(spark, sf_dir, "conversations"), token_codes.default_path())
