"""Best-fit packing of token pieces into sequences, by partitions first and then up a tree.

A document longer than a sequence is cut from its end, so that only its first piece is shorter. Each task
packs its pieces best-fit, longest first, in slabs, and closes the bins that are nearly full. The open bins
of several tasks meet as items of the next round, and so on up to one task.

What a task hands up is bounded without loss. Best-fit opens a bin only for an item that no bin takes, so at
most one bin is at most half full, and bins that are more than half full never fit together. What can still
move is that one bin of each task; the others can only receive such bins. A group of `fan` tasks has at most
`fan` of these to place, which need at most `fan` receivers, and the emptiest ones take whatever others would.
So a task hands up its small bin and its `fan` emptiest others and closes the rest as they are: with all of
them no sequence more could be saved.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared, tokens

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
PLACED_DDL = PIECE_DDL + ", sequence_id long, offset long, open boolean"
#: A sequence's number: round, task and count, so that no two tasks share one.
ROUND_BIT, TASK_BIT = 57, 33
TASKS = (1 << (ROUND_BIT - TASK_BIT)) - 1


def cut(n: int, most: int) -> list[int]:
    """Lengths of the pieces of a document with n ids."""
    short = n % most
    return [short] * (short > 0) + [most] * (n // most)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return shared.spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def cutter(tokenizer: str, most: int):
    """A function from batches (doc_id, text) to batches of PIECE: a row for each piece of each text (null: empty, which
    has the end id alone)."""

    def get(batches):
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            for part in shared.slices(batch, "text"):
                ids, starts = enc.encode(part.column(1))
                ids = ids.astype("<u4")
                cols: list[list] = [[], [], [], [], []]
                for doc, a, b in zip(part.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    at = a
                    for k, size in enumerate(cut(b - a, most)):
                        for c, v in zip(cols, (doc, k, at - a, size, zlib.crc32(ids[at : at + size]))):
                            c.append(v)
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, PIECE)], schema=PIECE)

    return get


def pieces(docs: DataFrame, tokenizer: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each text (null: empty, which has the end id alone)."""
    return texts(docs, id_col, text_col).mapInArrow(shared.tidy(cutter(tokenizer, most)), PIECE_DDL)


def best_fit(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's bin and place there, and each bin's load: the longest first, into the fullest bin that takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    loads: list[int] = []
    by_gap: list[list[int]] = [[] for _ in range(most + 1)]
    gaps = 0  # bit g: there is a bin with gap g
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, b = most, len(loads)
            loads.append(0)
        bins[i], places[i] = b, most - gap
        loads[b] += size
        if gap > size:
            by_gap[gap - size].append(b)
            gaps |= 1 << (gap - size)
    return bins, places, np.array(loads, np.int64)


def pack_items(t: pa.Table, most: int, slack: int, carry: int, first: int, last: bool) -> tuple[pa.Table, int]:
    """Packs items, which are runs of rows of one sequence_id with offsets inside; new sequences are numbered from first.

    Gives PLACED, the bins that may go on marked as open: unless last, those that are not nearly full, but beside the
    emptiest one at most `carry`. Also how many sequences there are.
    """
    length = t["length"].to_numpy()
    old, item = np.unique(t["sequence_id"].to_numpy(), return_inverse=True)
    sizes = np.bincount(item, length, len(old)).astype(np.int64)
    bins, places, loads = best_fit(sizes, most)
    is_open = np.zeros(len(loads), bool)
    if not last:
        loose = np.nonzero(loads < most - slack)[0]
        is_open[loose[np.argsort(loads[loose], kind="stable")[: carry + 1]]] = True
    of = bins[item]
    cols = [t[c].combine_chunks() for c in PIECE.names]
    return pa.table([*cols, pa.array(first + of), pa.array(places[item] + t["offset"].to_numpy()), pa.array(is_open[of])], schema=PLACED), len(loads)


def as_items(batch: pa.RecordBatch, first: int) -> pa.Table:
    """Pieces as items of one row each; their numbers are negative, unlike those of sequences."""
    n = batch.num_rows
    numbers = -1 - first - np.arange(n)
    return pa.Table.from_batches([batch.select(PIECE.names)]).append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(np.zeros(n, np.int64)))


def pack(parts: DataFrame, spark: SparkSession, most: int = 2048, slack: int = 8, fan: int = 16, carry: int | None = None, slab: int = 200_000, make=None) -> DataFrame:
    """Places every piece (columns of PIECE; others are not read) in a sequence of at most `most` ids.

    make: a function from batches of parts' rows to batches of pieces, where parts aren't pieces yet; it runs in the
    worker that packs them, so that a task has one.

    Pieces have 1 to `most` ids; equal rows are pieces of their own. Bins with more than most - slack ids are
    closed at once. A task packs where its pieces lie, `slab` pieces at a time, the open bins of one slab being items of
    the next, so its memory is bounded whatever it gets. carry: open bins that a task hands up beside its emptiest one,
    `fan` unless told, which loses nothing. An empty table gives an empty one. Each round is a table in the shared folder.
    """
    carry = fan if carry is None else carry

    def first_round(batches):
        """Slabs of pieces; between them 16 * carry open bins stay."""
        base, n_seen, n_bins, held, waiting, rows = TaskContext.get().partitionId() << TASK_BIT, 0, 0, [], [], 0
        for b in batches:
            if b.num_rows:
                waiting.append(as_items(b, n_seen))
                n_seen, rows = n_seen + b.num_rows, rows + b.num_rows
            if rows >= slab:
                out, n = pack_items(pa.concat_tables(held + waiting), most, slack, 16 * carry, base + n_bins, False)
                held, n_bins, waiting, rows = [out.filter(out["open"]).drop_columns(["open"])], n_bins + n, [], 0
                yield from out.filter(pc.invert(out["open"])).to_batches(100_000)
        if n_seen:
            yield from pack_items(pa.concat_tables(held + waiting), most, slack, carry, base + n_bins, False)[0].to_batches(100_000)

    def later_round(round_no: int, last: bool):
        """The items of one group after another; a group takes the place of a task in the numbers."""

        def get(batches):
            group, waiting = None, []

            def packed():
                base = (round_no << ROUND_BIT) + (group << TASK_BIT)
                yield from pack_items(pa.concat_tables(waiting), most, slack, carry, base, last)[0].to_batches(100_000)

            for b in batches:
                of = ((b.column(5).to_numpy() >> TASK_BIT) & TASKS) // fan
                cuts = np.nonzero(np.diff(of))[0] + 1
                for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                    if to == at:
                        continue
                    if waiting and of[at] != group:
                        yield from packed()
                        waiting = []
                    group = int(of[at])
                    waiting.append(pa.Table.from_batches([b.slice(at, to - at)]))
            if waiting:
                yield from packed()

        return get

    rows = parts.select(*PIECE.names) if make is None else parts
    start = first_round if make is None else lambda batches: first_round(make(batches))
    done = [shared.written(rows.mapInArrow(shared.tidy(start), PLACED_DDL), spark, "pack-0")]
    task = F.shiftright("sequence_id", TASK_BIT).bitwiseAND(F.lit(TASKS))
    top = done[0].where("open").agg(F.max(task)).first()[0]
    tasks = 0 if top is None else top + 1
    while tasks:
        k, groups = len(done), -(-tasks // fan)
        items = done[-1].where("open").drop("open")
        group = F.floor(task / fan)
        items = items.repartition(groups, group).sortWithinPartitions(group) if groups > 1 else items.coalesce(1)
        done.append(shared.written(items.mapInArrow(shared.tidy(later_round(k, groups == 1)), PLACED_DDL), spark, f"pack-{k}"))
        tasks = groups if groups > 1 else 0
    out = done[0].where("not open")
    for x in done[1:]:
        out = out.unionByName(x.where("not open"))
    return out.drop("open")


def pack_texts(docs: DataFrame, spark: SparkSession, tokenizer: str, most: int = 2048) -> DataFrame:
    """Every piece of every text and its place in a sequence of at most `most` ids."""
    return pack(texts(docs), spark, most, make=cutter(tokenizer, most))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text of `documents` and its place in a sequence of at most 2048 ids."""
    import public_tokenizers

    return pack_texts(shared.table(spark, sf_dir, "documents"), spark, public_tokenizers.path("byte_bpe_50k.json"))
