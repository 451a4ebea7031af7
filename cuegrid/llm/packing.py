"""Operator 4: best-fit packing of documents into sequences, refined by local search.

Null text counts as empty: a document of the end id alone. Documents longer than a sequence
are cut into whole sequences, the first piece taking the remainder. Pieces are dealt at random
(by a hash) into shards; a shard is packed best fit, longest first, and its underfull bins are
then improved by moving a document, exchanging one for one, two for one or one for two, each
step raising the sum of squared fills, until bins come empty. Bins still underfull are opened
again and their pieces meet those of other shards in the next round. Repeated rows are packed
as often as they occur; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.chunk_codec import codec
from cuegrid.llm.common import slices, texts, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY = 1024
END_ID = 2
#: Pieces of a shard, on average.
SHARD = 2048
ROUNDS = 3
#: Tasks that a round of packing is dealt over, at most.
MOST_TASKS = 20_000


def pieces(docs: DataFrame, tokenizer_path: str = BYTE_BPE, ranks_path: str = BYTE_RANKS, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = codec(tokenizer_path, ranks_path), np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            rows = []
            ids = b["doc_id"].to_pylist()
            for doc, raw in zip(ids, enc.encode(b["text"].to_pylist())):
                raw += end
                n = len(raw) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for k, stop in enumerate(stops):
                    rows.append((doc, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start = stop
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s is set if some bin has space s
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        fits = spaces >> need
        if fits:
            space = need + (fits & -fits).bit_length() - 1
            k = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
            bins[k].append(item)
        else:
            space, k = capacity, len(bins)
            bins.append([item])
        by_space[space - need].append(k)
        spaces |= 1 << (space - need)
    return bins


Options = tuple[list[int], list[tuple]]


def _ones_and_twos(items: list[int], lengths: list[int]) -> Options:
    """One item of each length, and one pair of each sum of two of the distinct lengths: the lengths in order, and the items."""
    one: dict[int, list[int]] = {}
    for i in items:
        one.setdefault(lengths[i], []).append(i)
    out = {n: (v[0],) for n, v in one.items()}
    keys = sorted(one)
    for x, a in enumerate(keys):
        for b in keys[x:]:
            if a != b:
                out.setdefault(a + b, (one[a][0], one[b][0]))
            elif len(one[a]) > 1:
                out.setdefault(a + b, tuple(one[a][:2]))
    order = sorted(out)
    return order, [out[n] for n in order]


def _step(give: Options, take: Options, space: int):
    """What to move from one bin to another and back, so that the other fills most; None if nothing does."""
    sums, ours = give
    best, most = None, 0
    for back, theirs in zip((0, *take[0]), ((), *take[1])):
        # The longest that fits the space and what comes back.
        k = bisect_right(sums, back + space) - 1
        gain = sums[k] - back if k >= 0 else 0
        if gain > most and not (len(theirs) == 2 and len(ours[k]) == 2):
            best, most = (gain, ours[k], theirs), gain
            if gain == space:
                break
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, offer: int = 32) -> list[list[int]]:
    """Empty the least filled bins into the fuller ones; every step raises the squared fill.

    A bin gives only while the other underfull bins have room for all it holds; past that no
    sequence of steps empties it. Bins of very many items offer their ``offer`` longest.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    options: dict[int, Options] = {}

    def offers(k: int) -> Options:
        if k not in options:
            options[k] = _ones_and_twos(sorted(bins[k], key=lambda i: -lengths[i])[:offer], lengths)
        return options[k]

    open_ = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])
    again = True
    while again:
        again = False
        room = sum(capacity - fill[k] for k in open_)
        for donor in open_:
            if fill[donor] > room - (capacity - fill[donor]):
                break
            for target in reversed(open_):
                while bins[donor] and target != donor and fill[target] >= fill[donor] and fill[target] < capacity:
                    step = _step(offers(donor), offers(target), capacity - fill[target])
                    if step is None:
                        break
                    gain, out, back = step
                    bins[donor] = [i for i in bins[donor] if i not in out] + list(back)
                    bins[target] = [i for i in bins[target] if i not in back] + list(out)
                    fill[donor] -= gain
                    fill[target] += gain
                    options.pop(donor, None)
                    options.pop(target, None)
                    again = True
            if not bins[donor]:
                room -= capacity
        open_ = sorted((k for k in open_ if bins[k] and fill[k] < capacity), key=lambda k: fill[k])
    return [b for b in bins if b]


def pack_shard(rows: pa.Table, capacity: int, number: int) -> pa.Table:
    """The pieces of one shard with sequence_id (from number on), offset and whether the bin is full."""
    rows = rows.sort_by([("length", "descending"), ("_row", "ascending")])
    lengths = rows["length"].to_pylist()
    sequence, offset, full = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, items in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
        at = 0
        for i in items:
            sequence[i], offset[i] = number + k, at
            at += lengths[i]
        full[items] = at == capacity
    for name, values in (("sequence_id", sequence), ("offset", offset), ("_full", full.astype(bool))):
        rows = rows.append_column(name, pa.array(values))
    return rows


def _packer(capacity: int, r: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return pack_shard(rows.drop_columns("_shard"), capacity, r << 56 | key[0].as_py() << 20)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """The rows of pieces with sequence_id and offset. pieces: doc_id, piece, start, length and more."""
    columns = pieces.columns
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") >= capacity)
    done = [whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    pool = pieces.filter(F.col("length") < capacity)
    fields = pieces.schema.simpleString()[len("struct<") : -1]
    for r in range(rounds):
        n = pool.count()
        if not n:
            break
        shards = max(1, round(n / shard))
        # Salted by the row, so that repeated and null ids spread; the work is Python's, so tasks go by shards, not bytes.
        dealt = pool.withColumn("_shard", F.pmod(F.xxhash64("_row", F.lit(r)), F.lit(shards)).cast("long")).repartition(max(1, min(shards // 4, MOST_TASKS)), "_shard")
        packed = written(dealt.groupBy("_shard").applyInArrow(_packer(capacity, r), f"{fields}, sequence_id long, offset long, _full boolean"), "packed")
        last = r == rounds - 1 or shards == 1
        done.append((packed if last else packed.filter("_full")).drop("_full"))
        if last:
            break
        pool = packed.filter("NOT _full").select(*pieces.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")
