"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots, which never change. A small table maps slots to
shards; it has versions, kept in a folder, and balancing or growing writes a new version in which
as few slots as needed have moved, with the edits as rows beside it. A later load takes up the
last version, so records stay where they are unless their slot is moved. What is planned on the
driver is that table: its size is the number of slots, a parameter, whatever the number of records.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hetweave.lineage import use_checkpoint_dir
from hetweave.llm.common import cut, numbered_copies

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map; edits lists the (slot, from, to) since the last."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    edits: tuple[tuple[int, int, int], ...] = field(default=())

    @classmethod
    def start(cls, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        """Slots dealt out in turn."""
        return cls(0, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for shard, size in zip(self.shards, sizes, strict=True):
            out[shard] += size
        return out

    def _edited(self, shards: list[int], n_shards: int) -> SlotMap:
        edits = tuple((s, a, b) for s, (a, b) in enumerate(zip(self.shards, shards, strict=True)) if a != b)
        return SlotMap(self.version + 1, n_shards, tuple(shards), edits)

    def balance(self, sizes: list[int], within: float = 0.001) -> SlotMap:
        """The next version: slots move, or swap, from the fullest to the emptiest shard.

        Each edit is the one that leaves the two shards most alike. It ends when the spread is
        at most `within` of the mean, or when no edit lessens it.
        """
        shards, loads = list(self.shards), self.loads(sizes)
        mean = sum(loads) / self.n_shards
        for _ in range(4 * len(shards)):
            full, bare = loads.index(max(loads)), loads.index(min(loads))
            gap = loads[full] - loads[bare]
            if gap <= within * mean:
                break
            giving = [s for s in range(len(shards)) if shards[s] == full and sizes[s] > 0]
            taking = sorted((sizes[s], s) for s in range(len(shards)) if shards[s] == bare)
            moves = [(abs(gap - 2 * sizes[s]), s, None) for s in giving if sizes[s] < gap]
            best = min(moves, default=None)
            if best is None or best[0] > within * mean:  # a swap may do better
                keys = [t[0] for t in taking]
                for s in giving:
                    k = _near(keys, sizes[s] - gap / 2)
                    if k is not None and 0 < sizes[s] - keys[k] < gap:
                        best = min(best or (gap, s, None), (abs(gap - 2 * (sizes[s] - keys[k])), s, taking[k][1]), key=lambda m: (m[0], m[1]))
            if best is None or best[0] >= gap:
                break
            _, out, back = best
            shards[out] = bare
            loads[full], loads[bare] = loads[full] - sizes[out], loads[bare] + sizes[out]
            if back is not None:
                shards[back] = full
                loads[full], loads[bare] = loads[full] + sizes[back], loads[bare] - sizes[back]
        return self._edited(shards, self.n_shards)

    def grow(self, sizes: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots from the others and no others move."""
        n, shards, loads = self.n_shards + 1, list(self.shards), [*self.loads(sizes), 0]
        goal = sum(loads) / n
        for s in sorted(range(len(shards)), key=lambda s: -sizes[s]):
            if loads[shards[s]] - sizes[s] >= goal - sizes[s] / 2 and loads[-1] + sizes[s] <= goal:
                loads[shards[s]] -= sizes[s]
                loads[-1] += sizes[s]
                shards[s] = n - 1
        return self._edited(shards, n)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, n_shards, virtual_slot, shard): the map as a table."""
        return spark.createDataFrame([(self.version, self.n_shards, s, x) for s, x in enumerate(self.shards)], "version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, store: str) -> None:
        """Add this version to the store; a version that is there already is an error."""
        folder = f"version={self.version}"
        self.frame(spark).drop("version").coalesce(1).write.parquet(f"{store}/slots/{folder}")
        edits = spark.createDataFrame(list(self.edits), "virtual_slot int, from_shard int, to_shard int")
        edits.coalesce(1).write.parquet(f"{store}/edits/{folder}")

    @classmethod
    def load(cls, spark: SparkSession, store: str, version: int | None = None) -> SlotMap | None:
        """The given or the last version in the store; None if there is none."""
        try:
            slots, edits = spark.read.parquet(f"{store}/slots"), spark.read.parquet(f"{store}/edits")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        last = slots.agg(F.max("version")).first()[0] if version is None else version
        found = slots.where(F.col("version") == last).orderBy("virtual_slot").collect()  # n_slots rows
        if not found:
            return None
        moved = edits.where(F.col("version") == last).orderBy("virtual_slot").collect()  # n_slots rows at most
        return cls(last, found[0].n_shards, tuple(r.shard for r in found), tuple((r.virtual_slot, r.from_shard, r.to_shard) for r in moved))


def new_store(spark: SparkSession) -> str:
    """A folder of its own below the shared checkpoint folder, for a map that one run needs."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/slot-map-{uuid4().hex}"


def _near(keys: list[int], wanted: float) -> int | None:
    from bisect import bisect_left

    if not keys:
        return None
    k = bisect_left(keys, wanted)
    return min((j for j in (k - 1, k) if 0 <= j < len(keys)), key=lambda j: abs(keys[j] - wanted))


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has size 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def virtual_slot(*columns: Column, n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n_slots)).cast("int")


def slot_sizes(records: DataFrame, n_slots: int = SLOTS) -> list[int]:
    """Bytes of each virtual slot, from records with (virtual_slot, size)."""
    found = {r[0]: r[1] for r in records.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    return [found.get(s, 0) for s in range(n_slots)]


def plan_shards(sizes: list[int], n_shards: int, start: SlotMap | None = None) -> list[SlotMap]:
    """The versions that lead from the map in use, or from slots dealt in turn, to even shards.

    Missing shards are added one at a time, each a version; the last version is balanced by the
    bytes that the slots hold now. A map that nothing needs to move is its own only version.
    """
    now = start or SlotMap.start(n_shards, len(sizes))
    if len(now.shards) != len(sizes):
        raise ValueError(f"the map in use has {len(now.shards)} slots")
    if now.n_shards > n_shards:
        raise ValueError(f"the map in use has {now.n_shards} shards; taking shards away is not supported")
    versions = [now]
    while versions[-1].n_shards < n_shards:
        versions.append(versions[-1].grow(sizes))
    even = versions[-1].balance(sizes)
    return [*versions, even] if even.edits or start is None else versions


def assign_shards(
    docs: DataFrame, n_shards: int = 8, *, doc_id: str = "doc_id", text: str = "text", n_slots: int = SLOTS, start: SlotMap | None = None, store: str | None = None
) -> tuple[DataFrame, SlotMap]:
    """(doc_id, size, text_crc32, virtual_slot, shard, position) of each row, and the map used.

    store is a folder of map versions: the last one there is the map in use, new versions are
    added, and the records are placed by the stored table. Without a store the map lives for this
    call only, from `start` or from slots dealt in turn.

    The slot of a record comes from its id, its text's checksum and, for rows that repeat each
    other in full, their number among the repeats: so rows that share an id, equal texts and full
    repeats all spread, and shard sizes in bytes are nearly equal whatever repeats. Groups of
    equal texts are not kept together. position counts the rows of a shard from 0 without gaps,
    in order of slot, id and checksum: counts of the slots are summed first, so no task sorts more
    than its share of slots. A null text has size 1 and checksum null; null ids are ids like
    others; an empty table gives no rows and a map edited by nothing.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("binary")
    records = docs.select(F.col(doc_id).alias("doc_id"), size_of(F.col(text)).alias("size"), F.crc32(body).alias("text_crc32"))
    records = numbered_copies(records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "copies", "copy")
    records = cut(records.withColumn("virtual_slot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), F.col("copy"), n_slots=n_slots)))
    used = SlotMap.load(spark, store) if store else None
    versions = plan_shards(slot_sizes(records, n_slots), n_shards, used or start)
    plan = versions[-1]
    if store:
        for m in versions[1:] if used else versions:
            m.save(spark, store)
        table = spark.read.parquet(f"{store}/slots").where(F.col("version") == plan.version)
    else:
        table = plan.frame(spark)
    slots = F.broadcast(table.select("virtual_slot", "shard"))  # n_slots rows
    counts = records.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(slots, "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n")
    offsets = F.broadcast(counts.select("virtual_slot", "shard", before.alias("first")))  # n_slots rows
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy"))
    placed = records.withColumn("inside", inside.cast("long")).join(offsets, "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("inside") - 1).alias("position")), plan
