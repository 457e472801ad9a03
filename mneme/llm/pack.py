"""Filling fixed-capacity containers with items: minimum bin slack.

Items are spread at random over blocks of a fixed number of containers' worth of tokens. Within a
block each container takes the largest item left and, with it, the combination of the others that
leaves the least slack; which sums can be reached is a bitset (one big integer) that grows by a
shift for every available length, and the combination is read back from the stages of the bitset.
Containers that stay open (the last ones of a block) are emptied and their items packed once more, in
blocks of the same size, so slack does not grow with the number of blocks. That ends once one block
holds all that is left, or once a round neither fills a tenth of its containers nor saves a hundredth
of them: items of more than half the capacity, for one, can't be packed any closer.

An item is cut only if it alone exceeds the capacity: into full pieces and a rest, never inside a
UTF-8 character. Null and empty texts have no tokens: they come out once, without a container.
Rows without key are left out;
repeated rows are items of their own. One block bounds what a task holds (``block_containers`` times
the capacity in tokens), whatever the sizes; no text is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mneme.storage import materialize

CAPACITY = 8192
#: Containers' worth of tokens in a block.
BLOCK_CONTAINERS = 512
#: Containers filled less than this are packed once more.
CLOSED = 0.995
#: Least share of a round's containers that it must fill, or save, for another round.
FILLED, SAVED = 0.1, 0.01


def fill(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; sizes are 1..capacity."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for i, size in enumerate(sizes):
        waiting[size].append(i)
    lengths = sorted(waiting, reverse=True)
    out, container = [0] * len(sizes), 0
    while lengths:
        room = capacity - lengths[0]
        taken = [lengths[0]]
        if room:
            mask, sums, stages = (1 << (room + 1)) - 1, 1, []
            for length in lengths:
                if length > room:
                    continue
                for _ in range(min(len(waiting[length]) - (length == lengths[0]), room // length)):
                    grown = (sums | sums << length) & mask
                    if grown == sums:
                        break
                    stages.append((length, sums))
                    sums = grown
                if sums >> room:
                    break
            goal = sums.bit_length() - 1
            for length, without in reversed(stages):
                if not without >> goal & 1:
                    taken.append(length)
                    goal -= length
        for length in taken:
            out[waiting[length].pop()] = container
        container += 1
        if any(not waiting[x] for x in taken):
            lengths = [x for x in lengths if waiting[x]]
    return out


def cut_bytes(text: bytes, capacity: int) -> list[tuple[int, int]]:
    """Pieces of at most ``capacity`` bytes as start and end, none of them inside a character."""
    out, at = [], 0
    while len(text) - at > capacity:
        end = at + capacity
        while end > at + 1 and text[end] & 0xC0 == 0x80:
            end -= 1
        out.append((at, end))
        at = end
    return [*out, (at, len(text))]


def _block_packer(capacity: int, level: int):
    def one_block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "__item"])
        numbers = fill(group["tokens"].tolist(), capacity)
        filled = group["tokens"].groupby(numbers).transform("sum").to_numpy()
        return group.assign(container=[f"{level}-{b}-{n}" for b, n in zip(group["__block"], numbers)], __filled=filled)

    return one_block


def pack(docs: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, block_containers: int = BLOCK_CONTAINERS) -> DataFrame:
    """``key, piece, n_pieces, start_byte, tokens, container`` for every piece of every item."""
    if capacity < 4:
        raise ValueError("a container must hold any one character: at least 4 tokens")
    kind = dict(docs.dtypes)[key]
    sized = docs.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("__text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("tokens"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, whole in zip(batch[key], batch["__text"]):
                found = cut_bytes(whole.encode(), capacity)
                rows += [(name, i + 1, len(found), a, b - a) for i, (a, b) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "piece", "n_pieces", "start_byte", "tokens"])

    schema = f"`{key}` {kind}, piece int, n_pieces int, start_byte long, tokens long"
    one, zero = F.lit(1), F.lit(0).cast("long")
    plain = [F.col(key), one.alias("piece"), one.alias("n_pieces"), zero.alias("start_byte"), F.col("tokens")]
    items = (
        sized.where((F.col("tokens") > 0) & (F.col("tokens") <= capacity)).select(*plain)
        .unionByName(sized.where(F.col("tokens") > capacity).select(key, "__text").mapInPandas(pieces, schema))
    )
    closed, level, opened = [], 0, None
    # equal keys are told apart by a number, so that repeated rows keep containers of their own
    waiting = materialize(items.withColumn("__item", F.monotonically_increasing_id()), "items")
    while True:
        total = waiting.agg(F.sum("tokens")).first()[0] or 0
        blocks = max(1, -(-total // (capacity * block_containers)))
        spread = waiting.withColumn("__block", F.pmod(F.xxhash64("__item", F.lit(level)), F.lit(blocks)))
        if blocks > 1:
            spread = spread.repartition(blocks, "__block")

        done = spread.groupBy("__block").applyInPandas(_block_packer(capacity, level), f"{schema}, __item long, __block long, container string, __filled long")
        done = materialize(done, f"level{level}")
        full = F.col("__filled") >= CLOSED * capacity
        counted = done.groupBy("container").agg(F.first("__filled").alias("__filled")).agg(F.count_if(full).alias("full"), F.count_if(~full).alias("open")).first()
        made = counted["full"] + counted["open"]
        gained = opened is None or opened - made >= SAVED * opened
        if blocks == 1 or counted["open"] == 0 or not (gained or counted["full"] >= FILLED * made):
            closed.append(done)
            break
        closed.append(done.where(full))
        waiting, level, opened = done.where(~full).select(*waiting.columns), level + 1, counted["open"]
    empty = sized.where(F.col("tokens") == 0).select(*plain, F.lit(None).cast("string").alias("container"))
    columns = [key, "piece", "n_pieces", "start_byte", "tokens", "container"]
    for part in closed:
        empty = empty.unionByName(part.select(*columns))
    return empty
