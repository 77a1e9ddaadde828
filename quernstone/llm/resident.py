"""State that stays where it is between rounds.

A round's state is an RDD of (place, (kind, ...)) whose partitioner is known, so that joining it with messages that were
dealt by the same places moves the messages alone. Plain DataFrames cannot say this: a table written each round
is read back without its partitioning, or has to be shuffled or sorted into buckets as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark import RDD, StorageLevel

Block = tuple[int, Any]
Step = Callable[[Iterator[Block]], Iterator[Block]]


def place_of(key: int) -> int:
    """The partition of a place is its own number."""
    return int(key)


def dealt(blocks: RDD, places: int) -> RDD:
    """Blocks (place, ...) moved to their places."""
    return blocks.partitionBy(places, place_of)


def beside(stays: RDD, messages: RDD) -> RDD:
    """The blocks of a place and the messages for it in one partition; only the messages are shuffled."""
    return stays.union(dealt(messages, stays.getNumPartitions()))


def kept(state: RDD) -> RDD:
    """Held in memory and on disk; a lost part is computed again from its lineage."""
    return state.persist(StorageLevel.MEMORY_AND_DISK)


def _sent(blocks: Iterator[Block]) -> Iterator[Block]:
    return ((place, ("come", *block[1:])) for place, block in blocks if block[0] == "sent")


def next_step(done: RDD, step: Step) -> RDD:
    """``step`` over the blocks that the last one left at a place and those that were sent there.

    Blocks of kind ``sent`` arrive as ``come``. A place still sees what it sent itself, which spares a pass of its own over the blocks that stay.
    """
    return kept(beside(done, done.mapPartitions(_sent)).mapPartitions(step, preservesPartitioning=True))
