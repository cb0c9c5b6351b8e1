"""Best-fit packing into several permitted sequence lengths.

Documents longer than the longest permitted sequence are cut into pieces. Pieces are dealt to
shards of about `shard_pieces` rows. In each shard, pieces are placed longest first, each into
the open bin it leaves the least room in; where none has room, a bin opens. Its length is chosen jointly
with what is still to be packed: for each permitted length that holds the piece, the room left is
filled in thought with the longest remaining pieces that fit, and the length opens whose bin, once
downsized to these contents, costs least for each word in it. A bin costs its length plus
`overhead`, so padding and many small bins both count. In the end every bin is downsized to the
smallest permitted length that holds its contents. Packings of the shard that open bins of one
length only (longer pieces open the smallest that holds them) are competitors, and the cheapest
packing is kept, so none of them is ever cheaper.

Scale: one pass counts words and writes (id, size) rows, one shuffle deals small rows to shards
of bounded size, whatever the ids; shards are packed independently.

Defined results: null and empty texts are packed in no bin (bin_id null, length 0); rows with
equal ids are separate documents; an empty table gives an empty result; ties go to the earlier
row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import named, word_count, written

LENGTHS = (256, 512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD_PIECES = 20_000

SCHEMA = (
    "row_id long, doc_id long, piece long, start long, length long, "
    "bin_id long, position long, bin_length long, bin_used long"
)


class Remaining:
    """How many pieces of each size are still to be placed."""

    def __init__(self, sizes: list[int]):
        self.counts = Counter(sizes)
        self.sizes = sorted(self.counts)

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.sizes.pop(bisect_left(self.sizes, size))

    def fill(self, room: int) -> int:
        """Words that the longest pieces which fit, one after the other, put into the room."""
        left, at = room, len(self.sizes)
        while left and at:
            at = bisect_right(self.sizes, left, 0, at)
            if at:
                at -= 1
                left -= self.sizes[at] * min(self.counts[self.sizes[at]], left // self.sizes[at])
        return room - left


def joint_length(size: int, remaining: Remaining, lengths: tuple[int, ...], overhead: int) -> int:
    """The length to open for a piece: least cost a word with what may still go in; of equal ones, the longest."""
    best = None
    for length in reversed(lengths[bisect_left(lengths, size) :]):
        used = size + remaining.fill(length - size)
        cost = (fitted(used, lengths) + overhead) / used
        if best is None or cost < best[0]:
            best = cost, length
    return best[1]


def best_fit(sizes: Iterable[int], length_of: Callable[[int], int]) -> tuple[list[int], list[int]]:
    """The bin of each piece and the words in each bin, for pieces in the order given.

    `length_of` is asked for each piece that no open bin has room for.
    """
    rooms: list[int] = []  # rooms that open bins have, sorted
    bins_with: dict[int, list[int]] = {}
    bin_of, used = [], []
    for size in sizes:
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            number = bins_with[room].pop()
            if not bins_with[room]:
                del bins_with[room]
                rooms.pop(at)
            used[number] += size
            room -= size
        else:
            number = len(used)
            used.append(size)
            room = length_of(size) - size
        if room:
            if room not in bins_with:
                bins_with[room] = []
                insort(rooms, room)
            bins_with[room].append(number)
        bin_of.append(number)
    return bin_of, used


def joint_fit(sizes: list[int], lengths: tuple[int, ...], overhead: int) -> tuple[list[int], list[int]]:
    """Best fit in which every opening chooses among the lengths."""
    remaining = Remaining(sizes)

    def pieces():
        for size in sizes:
            remaining.take(size)
            yield size

    return best_fit(pieces(), lambda size: joint_length(size, remaining, lengths, overhead))


def uniform_fit(sizes: list[int], length: int, lengths: tuple[int, ...]) -> tuple[list[int], list[int]]:
    return best_fit(sizes, lambda size: max(length, fitted(size, lengths)))


def fitted(used: int, lengths: tuple[int, ...]) -> int:
    return lengths[bisect_left(lengths, used)]


def pack_pieces(sizes: list[int], lengths: tuple[int, ...], overhead: int) -> tuple[list[int], list[int]]:
    """The cheaper of the joint packing and those with one length to open; of equal ones, the joint one."""
    packings = [joint_fit(sizes, lengths, overhead), *[uniform_fit(sizes, x, lengths) for x in sorted(lengths, reverse=True)]]
    return min(packings, key=lambda packing: sum(fitted(x, lengths) + overhead for x in packing[1]))


def pack_sizes(sizes: DataFrame, lengths=LENGTHS, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packs a written table (row_id, doc_id, size); see SCHEMA for the result."""
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    n_pieces = F.greatest(F.ceil(F.col("size") / longest), F.lit(1)).cast("long")
    total = sizes.agg(F.coalesce(F.sum(n_pieces), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_pieces))
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)))
    pieces = pieces.withColumn("start", F.col("piece") * longest)
    pieces = pieces.withColumn("length", F.least(F.col("size") - F.col("start"), F.lit(longest)))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row_id", "piece"), F.lit(shards)))
    pieces = pieces.select("shard", "row_id", "doc_id", "piece", "start", "length")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row_id", "piece"], ascending=[False, True, True])
        bin_of, used = pack_pieces(rows["length"].tolist(), lengths, overhead)
        number = pd.Series(bin_of, index=rows.index)
        words = number.map(dict(enumerate(used)))
        return rows.assign(
            bin_id=(int(key[0]) << 32) + number,
            position=rows.groupby(number)["length"].cumsum() - rows["length"],
            bin_length=words.map(lambda x: fitted(x, lengths)),
            bin_used=words,
        )[[x.split()[0] for x in SCHEMA.split(", ")]]

    packed = pieces.where("length > 0").groupBy("shard").applyInPandas(pack, SCHEMA)
    nothing = [F.lit(None).cast("long").alias(x) for x in ("bin_id", "position", "bin_length", "bin_used")]
    return packed.unionByName(pieces.where("length = 0").drop("shard").select("*", *nothing))


def pack(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Packs all documents; a size is the number of words."""
    sizes = docs.select(
        F.monotonically_increasing_id().alias("row_id"), named(id_col).alias("doc_id"),
        word_count(named(text_col)).alias("size"),
    )
    return pack_sizes(written(sizes, "pack-sizes"), **options)
