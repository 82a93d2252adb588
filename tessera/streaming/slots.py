"""Reservoirs of ``k`` edge slots: what they count, where the slots are kept (at hand or in a stream's state)."""

from __future__ import annotations

import math
import random
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VARIANTS = ("fixed", "recorded", "adaptive")
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEAD = "t long, round long, hits long, interval long, total double, before double, rate double, gone double, used int, free array<int>"
#: Rows of a stream's state hold so many slots, and the sampled neighbours of a run of so many ids: a row for each would take most of the time.
SLOT_BLOCK, VERTEX_RUN = 256, 1024
SLOT = np.dtype([("slot", "<i4"), ("src", "<i8"), ("dst", "<i8"), ("p", "<f8"), ("round", "<i8"), ("gone", "<f8")])
NEAR = "vertices array<long>, ids array<long>, slots array<int>"


class Slots:
    """slot -> (src, dst, p, round, gone), and vertex -> {neighbour: slot}, at hand."""

    def __init__(self, both: bool = True):
        """both: are edges found from either end, or from src alone?"""
        self.both = both
        self.edges: dict[int, tuple] = {}
        self.near: dict[int, dict[int, int]] = {}

    def slot(self, i: int) -> tuple:
        return self.edges[i]

    def neighbours(self, vertex: int) -> dict[int, int]:
        return self.near.get(vertex, {})

    def put(self, i: int, edge: tuple) -> None:
        self.edges[i] = edge
        self.near.setdefault(edge[0], {})[edge[1]] = i
        if self.both:
            self.near.setdefault(edge[1], {})[edge[0]] = i

    def remove(self, i: int) -> None:
        src, dst = self.edges.pop(i)[:2]
        for a, b in ((src, dst), (dst, src))[: 1 + self.both]:
            if self.near.get(a, {}).get(b) == i:  # a repeated edge may have a newer slot
                del self.near[a][b]
                if not self.near[a]:
                    del self.near[a]


class StateSlots(Slots):
    """The same in two map states, of blocks of slots and of runs of vertices. What a micro-batch touches is read once and written once, at its end; nothing else is."""

    def __init__(self, slots, near, both: bool = True):
        super().__init__(both)
        self.slot_state, self.near_state = slots, near
        self.read_slots: set[int] = set()
        self.runs: dict[int, dict[int, None]] = {}  # those read, with their vertices
        self.dirty_slots: set[int] = set()
        self.dirty_near: set[int] = set()

    def _read_block(self, i: int) -> int:
        block = i // SLOT_BLOCK
        if block not in self.read_slots:
            self.read_slots.add(block)
            if self.slot_state.containsKey((block,)):
                self.edges.update((row[0], row[1:]) for row in np.frombuffer(self.slot_state.getValue((block,))[0], SLOT).tolist())
        return block

    def _read_run(self, vertex: int) -> int:
        run = vertex // VERTEX_RUN
        if run not in self.runs:
            self.runs[run] = {}
            if self.near_state.containsKey((run,)):
                for v, w, i in zip(*(map(int, x) for x in self.near_state.getValue((run,))), strict=True):
                    self.near.setdefault(v, {})[w] = i
                    self.runs[run][v] = None
        return run

    def slot(self, i: int) -> tuple:
        self._read_block(i)
        return self.edges[i]

    def neighbours(self, vertex: int) -> dict[int, int]:
        self._read_run(vertex)
        return super().neighbours(vertex)

    def _touch(self, i: int, ends: tuple) -> None:
        self.dirty_slots.add(self._read_block(i))
        for vertex in ends:
            run = self._read_run(vertex)
            self.runs[run][vertex] = None
            self.dirty_near.add(run)

    def put(self, i: int, edge: tuple) -> None:
        self._touch(i, edge[: 1 + self.both])
        super().put(i, edge)

    def remove(self, i: int) -> None:
        self._touch(i, self.slot(i)[: 1 + self.both])
        super().remove(i)

    def write(self) -> None:
        for block in self.dirty_slots:
            rows = [(i, *self.edges[i]) for i in range(block * SLOT_BLOCK, (block + 1) * SLOT_BLOCK) if i in self.edges]
            _written(self.slot_state, block, rows and (np.array(rows, SLOT).tobytes(),))
        for run in self.dirty_near:
            rows = [(v, w, i) for v in self.runs[run] for w, i in self.near.get(v, {}).items()]
            _written(self.near_state, run, tuple(map(list, zip(*rows, strict=True))))


def _written(state, key: int, value: tuple) -> None:
    """A row of a map state; one without anything goes."""
    if value:
        state.updateValue((key,), value)
    elif state.containsKey((key,)):
        state.removeKey((key,))


class Reservoir:
    """An edge is counted against the sample before it is stored.

    fixed: insertion with (1 - rate)^(round - 1); recorded: with k / t, each edge keeps its probability and round;
    adaptive: as recorded, and the rate follows the mean age of the edges in triangles. What an edge keeps of its
    probability is the product of (1 - rate) over the rounds since: a difference of logarithms' sums (``gone``), so that no
    round has to be remembered. What is drawn depends on the seed, the position and the round alone: a stream that starts
    again from its checkpoint draws the same.
    """

    def __init__(self, k: int, rate: float, variant: str = "recorded", z: float = 0.25, bound: int = 5, seed: int = 1, mine: Callable[[int, int, int], bool] | None = None, held: Slots | None = None, count: bool = True):
        """mine: does a triangle (three vertices) belong to this reservoir? By default all do. count: are triangles counted?"""
        if variant not in VARIANTS or k * rate < 1:
            raise ValueError("unknown variant, or no slot would be freed in a round")
        self.k, self.start, self.variant, self.z, self.bound, self.seed, self.mine, self.count = k, rate, variant, z, bound, seed, mine, count
        self.held = held if held is not None else Slots()
        self.t, self.round, self.hits, self.interval, self.total, self.before, self.rate, self.gone, self.used = 0, 1, 0, 0, 0.0, 0.0, rate, 0.0, 0
        self.free: list[int] = []
        self.nodes: dict[int, float] = {}  # counts since the reservoir was made or read from a state
        self.ended: tuple | None = None  # of the last round that ended: round, t, rate, total, increment, hits, interval

    def head(self) -> tuple:
        return self.t, self.round, self.hits, self.interval, self.total, self.before, self.rate, self.gone, self.used, self.free

    def restore(self, head: tuple) -> None:
        self.t, self.round, self.hits, self.interval, self.total, self.before, self.rate, self.gone, self.used, free = head
        self.free = [int(i) for i in free]

    def survival(self, slot: int) -> float:
        """With what probability the edge of the slot was stored and is still there."""
        _, _, p, _, gone = self.held.slot(slot)
        if self.variant == "fixed":
            return (1 - self.start) ** (self.round - 1)
        return p * math.exp(self.gone - gone)

    def counted(self, src: int, dst: int) -> None:
        few, many = sorted((self.held.neighbours(src), self.held.neighbours(dst)), key=len)
        found = 0.0
        for w in [w for w in few if w in many and (self.mine is None or self.mine(src, dst, w))]:
            weight = 1 / (self.survival(few[w]) * self.survival(many[w]))
            self.hits += 1
            self.interval += 2 * self.round - self.held.slot(few[w])[3] - self.held.slot(many[w])[3]
            self.nodes[w] = self.nodes.get(w, 0.0) + weight
            found += weight
        if found:
            for x in (src, dst):
                self.nodes[x] = self.nodes.get(x, 0.0) + found
            self.total += found

    def add(self, src: int, dst: int) -> None:
        if src == dst and self.count:
            return
        self.t += 1
        if self.count:
            self.counted(src, dst)
        if self.used < self.k:
            self.held.put(self.used, (src, dst, 1.0, 1, 0.0))
            self.used += 1
            return
        if not self.free:
            self.new_round()
        p = (1 - self.start) ** (self.round - 1) if self.variant == "fixed" else self.k / self.t
        if xxhash.xxh64_intdigest(struct.pack("<qq", self.seed, self.t)) < p * 2.0**64:
            self.held.put(self.free.pop(), (src, dst, p, self.round, self.gone))

    def new_round(self) -> None:
        rate = self.start
        if self.variant == "adaptive" and self.round > self.bound and self.hits:
            rate = max(rate, round(1 - (self.z ** (self.hits / self.interval) if self.interval else 0.0), 4))
        self.ended = self.round, self.t - 1, self.rate, self.total, self.total - self.before, self.hits, self.interval
        self.before, self.rate = self.total, rate
        self.round += 1
        self.free = random.Random(xxhash.xxh64_intdigest(struct.pack("<qq", self.seed, -self.round))).sample(range(self.k), int(self.k * rate))
        for slot in self.free:
            self.held.remove(slot)
        self.gone += math.log1p(-rate) if rate < 1 else 0.0  # at 1 nothing is left that the sum would be asked for
        self.hits = self.interval = 0


def with_states(spark: SparkSession) -> None:
    """Processors with states of their own need Spark's RocksDB store; it is set unless the session names one of the kind."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


class SlotProcessor(StatefulProcessor):
    """A reservoir for each key; its state is a row of numbers, a row for each block of slots and one for each run of the sample's vertices."""

    def __init__(self, make: Callable[[int, Slots], Reservoir], columns: list[str], local: bool, both: bool = True):
        self.make, self.columns, self.local, self.both = make, columns, local, both

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.slots = handle.getMapState("slots", "block int", "data binary")
        self.near = handle.getMapState("near", "run long", NEAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = StateSlots(self.slots, self.near, self.both)
        r = self.make(int(key[0]), held)
        if self.head.exists():
            r.restore(tuple(self.head.get()))
        out = self.fed(r, int(key[0]), pd.concat(list(rows)).sort_values("seq"))
        held.write()
        self.head.update(r.head())
        yield pd.DataFrame(out, columns=self.columns)

    def fed(self, r: Reservoir, key: int, rows: pd.DataFrame) -> list[tuple]:
        for src, dst in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
            r.add(src, dst)
        if self.local:
            return list(r.nodes.items())
        return [(key, r.t, r.round, r.rate, r.total, r.total - r.before, r.hits, r.interval)]

    def close(self) -> None:
        pass
