"""Hard negatives for contrastive training, found exactly from Hilbert-ordered blocks of vectors.

Vectors become whole numbers, are sorted along a Hilbert curve through all
dimensions and written as Parquet, a block of at most ``BLOCK`` vectors a row,
with a zone map: the smallest and greatest value of each dimension, and the labels
inside. The inner product of an anchor with any vector of a block lies within an
interval that follows from the zone map, so the zone maps alone tell which blocks
an anchor must read: for its positives those whose interval reaches the worst of
the best found in its own block, for its negatives those whose interval meets one
of its windows.

Anchors travel in groups: a request is a block's number with the anchors of one
group that must read it, and joins the block by that number, so a block is
shuffled once. A task keeps the best rows of the groups that it meets, so it gives
out a few rows an anchor, not a few for every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
LOW, HIGH = 30, 90
#: Vectors of a block, blocks of a zone table's row, anchors of a group, groups whose best rows a task keeps at once.
BLOCK, ZONES, GROUP, KEPT = 512, 1024, 128, 256
#: Codes are held within these bounds, so that scores of up to 32,768 dimensions fit 64 bits.
LARGEST = 1 << 24
#: Bits of a dimension in a vector's place along the curve.
BITS = 4
CODED = "vec_id long, label int, code binary, curve binary"
BLOCKS = "block long, vec_ids binary, labels binary, codes binary, lo binary, hi binary, kinds array<int>"
GROUPS = "group long, ids binary, labels binary, blocks binary, places binary, codes binary, limits binary"
REQUEST = "group long, slots binary, block long"
FOUND = "anchor_id long, group long, slot int, nth int, positive_id long, positive_score long, vec_id long, score long"
_LEAST = np.iinfo(np.int64).min


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places of rows of ``bits``-bit coordinates along the Hilbert curve, as rows of bytes that sort like them.

    Coordinates are turned, one bit level after the other, into the curve's own
    frame (exchange or inversion of low bits, then Gray code) and interleaved.
    """
    x = cells.astype(np.uint8).T.copy()
    if not x.size:
        return np.zeros((cells.shape[0], 1), np.uint8)
    for level in range(bits - 1, 0, -1):
        low = np.uint8((1 << level) - 1)
        for k in range(len(x)):
            on = (x[k] >> level & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[k]) & low).astype(np.uint8)
            x[0] ^= np.where(on, low, swap).astype(np.uint8)
            x[k] ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.uint8)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, np.uint8((1 << level) - 1), 0).astype(np.uint8)
    x ^= turn
    planes = np.stack([x >> level & 1 for level in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(-1, planes.shape[2]).T, axis=1)


def _coded(dims: int, top: int):
    """Codes of vectors, padded with zeros to ``dims``, and their places along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("code")
            lengths = np.diff(np.asarray(lists.offsets))
            inside = np.arange(dims) < lengths[:, None]
            codes = np.zeros((batch.num_rows, dims), np.int32)
            codes[inside] = np.asarray(lists.flatten())
            cells = (codes.astype(np.int64) + top) * ((1 << BITS) - 1) // max(2 * top, 1)
            binary = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (codes, hilbert(cells))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *binary], names=["vec_id", "label", "code", "curve"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted vectors of a task; inside a block they lie by id."""
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 32, 0

    def block(rows: pa.Table) -> pa.RecordBatch:
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), "<i4").reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        whole = [x.tobytes() for x in (ids[order].astype("<i8"), labels[order].astype("<i4"), codes[order], codes.min(axis=0), codes.max(axis=0))]
        return _record(BLOCKS, [(first + made, *whole, np.unique(labels).tolist())])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        table = pa.Table.from_batches(rest)
        whole = len(table) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            yield block(table.slice(at, BLOCK))
            made += 1
        rest = table.slice(whole).to_batches()
    if rest:
        yield block(pa.Table.from_batches(rest))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _array(raw: bytes, kind: str = "<i8", width: int | None = None) -> np.ndarray:
    out = np.frombuffer(raw, kind)
    return out if width is None else out.reshape(width, -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in floating point where no sum can reach 2**53, otherwise in whole numbers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _anchor_groups(every: int, positives: int):
    """Groups of the anchors in some blocks, each with its limit: the score of the last of its best positives in its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, held = TaskContext.get().partitionId() << 32, 0, []

        def group() -> pa.RecordBatch:
            columns = [np.array(c) for c in zip(*held, strict=True)]
            kinds = ("<i8", "<i4", "<i8", "<i4", "<i4", "<i8")
            return _record(GROUPS, [(first + made, *(c.astype(k).tobytes() for c, k in zip(columns, kinds, strict=True)))])

        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = _array(row["vec_ids"]), _array(row["labels"], "<i4")
                codes = _array(row["codes"], "<i4", len(ids))
                places = np.flatnonzero(ids % every == 0)
                scores = _product(codes[places], codes)
                for place, score in zip(places.tolist(), scores, strict=True):
                    own = labels == labels[place]
                    own[place] = False
                    best = np.sort(score[own])[::-1]
                    held.append((ids[place], labels[place], row["block"], place, codes[place], best[positives - 1] if len(best) >= positives else _LEAST))
                    if len(held) == GROUP:
                        yield group()
                        made, held = made + 1, []
        if held:
            yield group()

    return run


Wanted = Callable[[dict, np.ndarray, np.ndarray, dict], np.ndarray]


def _requests(wanted: Wanted):
    """For each group and row of the zone table, the blocks that some of the group's anchors must read, by the intervals of their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, zones = len(row["ids"]) // 8, row["zones"]
                codes = _array(row["codes"], "<i4", n)
                up, down = np.maximum(codes, 0), np.minimum(codes, 0)
                lo, hi = (np.stack([_array(z[c], "<i4") for z in zones]) for c in ("lo", "hi"))
                least, most = _product(up, lo) + _product(down, hi), _product(up, hi) + _product(down, lo)
                take = wanted(row, least, most, zones)
                out = [(row["group"], np.flatnonzero(take[:, k]).astype("<i4").tobytes(), z["block"]) for k, z in enumerate(zones) if take[:, k].any()]
                if out:
                    yield _record(REQUEST, out)

    return run


def _for_positives(row: dict, least: np.ndarray, most: np.ndarray, zones: list[dict]) -> np.ndarray:
    labels, limits = _array(row["labels"], "<i4"), _array(row["limits"])
    has = np.stack([np.isin(labels, z["kinds"]) for z in zones], axis=1)
    return has & (most >= limits[:, None])


def _for_negatives(low: int, high: int) -> Wanted:
    def wanted(row: dict, least: np.ndarray, most: np.ndarray, zones: list[dict]) -> np.ndarray:
        labels = _array(row["labels"], "<i4")
        other = np.stack([(len(z["kinds"]) > 1) | (z["kinds"][0] != labels) for z in zones], axis=1)
        meets = np.zeros(least.shape, bool)
        for p in row["found"]:
            k, score = p["slot"], p["score"]
            meets[k] |= (100 * most[k] >= low * score) & (100 * least[k] <= high * score)
        return other & meets

    return wanted


class _Best:
    """The best rows of each slot of a group: highest score first, of equal ones the smallest id."""

    def __init__(self, slots: int, most: int):
        self.most, self.limit = most, np.full(slots, _LEAST, np.int64)
        self.slot = self.score = self.id = np.empty(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = order[rank < self.most]
        self.slot, self.score, self.id = slot[rank < self.most], score[keep], ids[keep]
        last = rank[rank < self.most] == self.most - 1
        self.limit[self.slot[last]] = self.score[last]


def _scored(low: int | None, high: int | None, positives: int, most: int):
    """The best rows for the anchors of each request among the rows of its block.

    Without ``low`` and ``high`` these are the positives, one slot an anchor;
    with them the rows of other labels in each window, a slot for each positive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[dict, _Best]] = {}

        def out(row: dict, best: _Best) -> pa.RecordBatch:
            ids = _array(row["ids"])
            windows = {p["slot"] * positives + p["nth"]: p for p in row["found"] or ()}
            rows = []
            for slot, score, vec_id in zip(best.slot.tolist(), best.score.tolist(), best.id.tolist(), strict=True):
                p = windows.get(slot)
                anchor = slot // positives if p else slot
                rows.append((ids[anchor], row["group"], anchor, p["nth"] if p else 0, p and p["vec_id"], p and p["score"], vec_id, score))
            return _record(FOUND, rows)

        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] not in kept:
                    if len(kept) == KEPT:
                        yield from (out(r, b) for r, b in kept.values() if len(b.slot))
                        kept.clear()
                    kept[row["group"]] = {k: row[k] for k in ("group", "ids", "found")}, _Best(len(row["ids"]) // 8 * positives, most)
                best, slots, n = kept[row["group"]][1], _array(row["slots"], "<i4"), len(row["vec_ids"]) // 8
                vec_ids, labels = _array(row["vec_ids"]), _array(row["block_labels"], "<i4")
                own = _array(row["labels"], "<i4")[slots]
                codes = _array(row["codes"], "<i4", len(row["ids"]) // 8)[slots]
                scores = _product(codes, _array(row["block_codes"], "<i4", n))
                if low is None:
                    fits = own[:, None] == labels
                    here = _array(row["blocks"])[slots] == row["block"]
                    fits[np.flatnonzero(here), _array(row["places"], "<i4")[slots][here]] = False
                    a, b = np.nonzero(fits & (scores >= best.limit[slots][:, None]))
                    best.add(slots[a].astype(np.int64), scores[a, b], vec_ids[b])
                    continue
                of, pending = {s: k for k, s in enumerate(slots.tolist())}, []
                for p in row["found"]:
                    if (k := of.get(p["slot"])) is None:
                        continue
                    s, slot = scores[k], p["slot"] * positives + p["nth"]
                    b = np.flatnonzero((labels != own[k]) & (100 * s >= low * p["score"]) & (100 * s <= high * p["score"]) & (s >= best.limit[slot]))
                    if len(b) > most:  # rows lie by id, so a stable sort keeps the smallest of equal scores first
                        b = b[np.argsort(-s[b], kind="stable")[:most]]
                    pending.append((np.full(len(b), slot), s[b], vec_ids[b]))
                if pending:
                    best.add(*(np.concatenate(x) for x in zip(*pending, strict=True)))
        yield from (out(r, b) for r, b in kept.values() if len(b.slot))

    return run


def _best(found: DataFrame, by: tuple[str, ...], most: int, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    Rows with a null id, label or vector, or a component that is null or not
    finite, take no part; components become floor(256 x), held within 2**24 either
    way; shorter vectors are padded with zeros. Anchors are the rows whose id is
    divisible by ``every``; a row is never its own positive, but one that repeats
    its id may be. Of equal scores the smaller id comes first; of rows equal in
    both any may. A positive below zero has no window, one of zero only scores of zero. No rows, or
    no anchors, give no rows.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    code = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), code.alias("code"))
    dims, top = rows.agg(F.max(F.size("code")), F.max(F.array_max(F.transform("code", F.abs)))).first()
    coded = rows.mapInArrow(_coded(int(dims or 0), int(top or 0)), CODED)
    blocks = staged(coded.repartitionByRange("curve", "vec_id").sortWithinPartitions("curve", "vec_id", "label", "code").mapInArrow(_blocks, BLOCKS))
    groups = staged(blocks.select("block", "vec_ids", "labels", "codes").mapInArrow(_anchor_groups(every, positives), GROUPS))
    # The zone table: one row for up to ZONES blocks, by the task and the thousand in which they were made.
    task, part = F.shiftright("block", 32), F.shiftright(F.col("block").bitwiseAND((1 << 32) - 1), ZONES.bit_length() - 1)
    zones = blocks.groupBy(task.alias("task"), part.alias("part")).agg(F.collect_list(F.struct("block", "lo", "hi", "kinds")).alias("zones"))
    tasks, parts = blocks.agg(F.max(task), F.max(part)).first()

    def read(of: DataFrame, wanted: Wanted, run) -> DataFrame:
        every_zone = of.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(int(tasks or 0))))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(int(parts or 0)))))
        asked = every_zone.join(zones, ["task", "part"]).mapInArrow(_requests(wanted), REQUEST)
        payload = blocks.select("block", "vec_ids", F.col("labels").alias("block_labels"), F.col("codes").alias("block_codes"))
        return asked.join(of, "group").join(payload, "block").mapInArrow(run, FOUND)

    unknown = F.lit(None).cast("array<struct<slot:int,nth:int,vec_id:long,score:long>>")
    alike = _best(read(groups.withColumn("found", unknown), _for_positives, _scored(None, None, 1, positives)), ("group", "slot"), positives, "place")
    found = alike.groupBy("group").agg(F.collect_list(F.struct("slot", (F.col("place") - 1).alias("nth"), "vec_id", "score")).alias("found"))
    windows = staged(groups.join(found, "group"))
    hard = _best(read(windows, _for_negatives(low, high), _scored(low, high, positives, negatives)), ("group", "slot", "nth"), negatives, "rank")
    return hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same rows for DuckDB.
MINE_SQL = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS code
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(CAST(a.code AS DOUBLE[]), CAST(b.code AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""
