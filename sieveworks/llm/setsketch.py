"""Near duplicates by SetSketch: exponentially spaced truncated minima, bands of register values, a joint likelihood estimate, and exact sets.

Each shingle is a Poisson process of points on a line, each point with a random register out of m. A register keeps the first
point of any shingle of the set; as the points of one register are again a Poisson process, these minima are independent and
of exponential law. Registers hold the minimum's logarithm to a base near 1, rounded down, so two sketches of sets merge by the larger of each
register, and registers of two sets are equal with a chance near the sets' Jaccard similarity. Only the points up to the
one that fills the last register are made: about m (ln m + 3) for a set, however many shingles it has.

Sets whose register values are equal throughout a band share a bucket. Each set is first tried with one head of its
buckets; buckets that then hold several classes are cut into tiles, where sets of different classes meet. A pair is
verified by intersection of the sorted shingle arrays unless the likelihood of its registers rules the threshold out.

With 36 bands of 6 registers a pair at a similarity of 0.85 has no band in common with a chance of 4e-8, at 0.9 of 1e-12;
the likelihood drops one at the threshold with a chance of about 1e-9."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import jaccard, wordhash
from sieveworks.llm.components import components, roots_of_parents
from sieveworks.llm.store import write_table
from sieveworks.llm.wordhash import mix

BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
#: Registers are floor(1 + log_BASE(SPAN / minimum)), between 0 and TOP.
BASE, SPAN, TOP = 1.001, 20.0, (1 << 16) - 1
#: A pair is dropped where the log likelihood of its best similarity, below the threshold, exceeds that of the threshold by so much.
SLACK = 18.0
#: Rows of up to five numbers that are sent to the tasks that hold the bodies; of more, both sides are shuffled.
SENT_ROWS = 250_000
#: Points that are made at once for each shingle while many are open, or few.
_OPEN, _WIDE = 4096, 64
_STEP, _REGISTER, _BAND = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


def _minima(sets: list[np.ndarray], horizon: float, m: int) -> np.ndarray:
    """The first point in each register (rows: sets), infinite where none comes before horizon / size of the set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets)
    ends = horizon / sizes[owner]
    at, out, step = np.zeros(len(elements)), np.full(len(sets) * m, np.inf), 0
    live = np.arange(len(elements))
    while len(live):
        wide = 1 if len(live) > _OPEN else _WIDE
        h = mix(elements[live][:, None] + np.arange(step + 1, step + wide + 1, dtype=np.uint64) * _STEP)
        step += wide
        gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
        points = at[live][:, None] + np.cumsum(gaps, axis=1)
        register = ((mix(h ^ _REGISTER) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        np.minimum.at(out, (owner[live][:, None] * m + register.astype(np.int64)).ravel(), points.ravel())
        at[live] = points[:, -1]
        live = live[at[live] <= ends[live]]
    return out.reshape(len(sets), m)


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """The registers (unsigned 16 bits) of each set of distinct hashes; an empty set has all registers 0."""
    out = np.zeros((len(sets), m), np.uint16)
    left, horizon = [i for i, s in enumerate(sets) if len(s)], log(m) + 3
    while left:
        found = _minima([sets[i] for i in left], horizon, m)
        # A point beyond the horizon may have an earlier one in the same register that was not made.
        sizes = np.array([len(sets[i]) for i in left])
        full = (found <= (horizon / sizes)[:, None]).all(1)
        done = [i for i, f in zip(left, full) if f]
        out[done] = np.clip(np.floor(1 + np.log(SPAN / found[full]) / log(BASE)), 0, TOP).astype(np.uint16)
        left, horizon = [i for i, f in zip(left, full) if not f], horizon * 2
    return out


def bands(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's register values (rows: sets)."""
    values = registers.reshape(len(registers), -1, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, values.shape[1] + 1, dtype=np.uint64) * _BAND, values.shape[:2]).copy()
    for i in range(rows):
        out = mix(out * _STEP + values[:, :, i])
    return out


def _share(x: np.ndarray) -> np.ndarray:
    """The chance that a register of one set exceeds the other's, where the first alone holds a share x of both together."""
    return -np.log1p(-np.maximum(x, 0.0) * (BASE - 1) / BASE) / log(BASE)


def _likelihood(similarity, u, v, more, less, same):
    above, below = _share(u - v * similarity), _share(v - u * similarity)
    tiny = 1e-300
    return more * np.log(above + tiny) + less * np.log(below + tiny) + same * np.log(np.maximum(1 - above - below, tiny))


def most_likely(size_a, size_b, more, less, same) -> np.ndarray:
    """The similarity at which registers of two sets of known sizes would most likely compare as they do: more, less and
    same count those in which a's is larger, smaller and equal. The likelihood is concave, so thirds close in on it."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(50):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = _likelihood(a, u, v, more, less, same) < _likelihood(b, u, v, more, less, same)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def may_link(size_a, size_b, more, less, same, percent: int) -> np.ndarray:
    """Whether the registers leave it open that the similarity reaches the threshold."""
    size_a, size_b = np.asarray(size_a, np.float64), np.asarray(size_b, np.float64)
    at = percent / 100
    open_ = np.minimum(size_a, size_b) >= at * np.maximum(size_a, size_b) * (1 - 1e-12)
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    reached = _likelihood(np.minimum(at, np.minimum(u / v, v / u)), u, v, more, less, same)
    # Far pairs end at one lower similarity; for the others the best one is sought.
    open_ &= _likelihood(np.full_like(u, at * 0.7), u, v, more, less, same) - reached <= SLACK
    left = np.flatnonzero(open_)
    if len(left):
        best = most_likely(size_a[left], size_b[left], more[left], less[left], same[left])
        gap = _likelihood(best, u[left], v[left], more[left], less[left], same[left]) - reached[left]
        open_[left] = (best >= at) | (gap <= SLACK)
    return open_


def compare(rows: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many registers of each of the rows are larger than, smaller than and equal to those of row."""
    more, same = (rows > row).sum(1), (rows == row).sum(1)
    return more, rows.shape[1] - more - same, same


def can_differ(n: int, percent: int) -> bool:
    """Whether a set of n can link with one that is not equal."""
    return 100 * n >= percent * (n + 1)


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n, two halves of the set's fingerprint, its band hashes; none where it can link with equal sets only."""

    def describe(batches):
        for batch in batches:
            for part in wordhash.slices(batch, 1):
                found = wordhash.shingles(wordhash.split(part.column(1)), n)
                f = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in found), np.int64).reshape(-1, 2)
                wide = [can_differ(len(s), percent) for s in found]
                hashes = bands(sketches([s for s, w in zip(found, wide) if w])) if any(wide) else np.empty((0, BANDS), np.uint64)
                ends = np.concatenate(([0], np.cumsum(wide))) * hashes.shape[1]
                yield part.column(0), [len(s) for s in found], pa.array(f[:, 0]), pa.array(f[:, 1]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.ravel().view(np.int64)))

    return jaccard._batches(docs.select("id", "text"), describe, "id long, n int, f1 long, f2 long, bands array<long>")


def _bodies(docs: DataFrame, n: int) -> DataFrame:
    """id, n, and the registers followed by the sorted shingle array of each document."""

    def describe(batches):
        for batch in batches:
            for part in wordhash.slices(batch, 1):
                found = wordhash.shingles(wordhash.split(part.column(1)), n)
                yield part.column(0), [len(s) for s in found], [r.tobytes() + s.tobytes() for r, s in zip(sketches(found), found)]

    return jaccard._batches(docs.select("id", "text"), describe, "id long, n int, body binary")


def _parts(body) -> tuple[np.ndarray, np.ndarray]:
    """The registers and the shingles of a body."""
    return np.frombuffer(body, np.uint16, REGISTERS), np.frombuffer(body, np.uint64, offset=2 * REGISTERS)


def _sent(rows: DataFrame) -> DataFrame:
    """Narrow rows, with the hint to broadcast them if they are few enough."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _confirm(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), one for each b, those whose sets link. The sets of one a come together in parts of about HUB."""
    hubs = write_table(pairs.groupBy("a").count().where(F.col("count") > jaccard.HUB).select("a", F.ceil(F.col("count") / jaccard.HUB).cast("int").alias("parts")), "near-hubs")
    keyed = pairs.join(jaccard._small(hubs), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"), "b")
    keyed = write_table(keyed, "near-pairs")
    heads = keyed.select("a", "part").distinct().select("a", "part", F.col("a").alias("id"))
    rows = bodies.select("id", "body").join(_sent(heads.unionByName(keyed.select("a", "part", F.col("b").alias("id")))), "id")
    rows = rows.select("a", "part", (F.col("id") != F.col("a")).cast("int").alias("role"), "id", "body")

    def check(batches):
        head = None
        for batch in batches:
            out = [], []
            for role, i, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                registers, shingles = _parts(body.as_buffer())
                if role == 0:
                    head = i, registers.copy(), shingles.copy()
                elif may_link([len(shingles)], [len(head[2])], *compare(registers[None, :], head[1]), percent)[0] and jaccard.links(head[2], shingles, percent):
                    out[0].append(head[0])
                    out[1].append(i)
            yield out

    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return write_table(jaccard._batches(rows, check, "a long, b long"), "near-links")


def tile_links(rows: list[tuple[int, int, int, bytes]], percent: int) -> Iterator[tuple[int, int]]:
    """rows: side (1 left, 2 right, 3 both), id, class, body. Links that join sets of different classes, fewer than the rows;
    sets of different sides meet, and those of 3 all."""
    held = sorted(((*_parts(r[3]), *r[:3]) for r in rows), key=lambda r: len(r[1]))
    registers, shingles = np.stack([r[0] for r in held]), [r[1] for r in held]
    side, ids = np.array([r[2] for r in held]), [r[3] for r in held]
    classes, group = np.unique(np.array([r[4] for r in held]), return_inverse=True)
    size, left = np.array([len(s) for s in shingles], np.int64), len(classes)
    for i in range(len(held)):
        if left < 2:
            return
        to = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
        there = np.arange(i + 1, to)
        there = there[(group[i + 1 : to] != group[i]) & ((side[i + 1 : to] | side[i]) == 3)]
        if not len(there):
            continue
        for j in there[may_link(size[there], np.full(len(there), size[i]), *compare(registers[there], registers[i]), percent)]:
            if group[j] != group[i] and jaccard.links(shingles[i], shingles[j], percent):
                group[group == group[j]] = group[i]
                left -= 1
                yield min(ids[i], ids[j]), max(ids[i], ids[j])


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """The links of all tiles, from rows tile, side, id, class, body in order of tile."""

    def work(batches):
        key, held = None, []

        def flush():
            found = list(tile_links(held, percent))
            return [p[0] for p in found], [p[1] for p in found]

        for batch in batches:
            for tile, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != key:
                    if len(held) > 1:
                        yield flush()
                    key, held = tile, []
                held.append(row)
        if len(held) > 1:
            yield flush()

    return jaccard._batches(members, work, "a long, b long")


def near_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs: id (long, unique, not null), text. A row (id, n_shingles, component) for each document; component is the least
    id that links reach. Null texts and texts without words have no shingles and link with nothing; equal sets always
    link, and one stands for all of them from the start. A very long text is shingled and compared whole. An empty
    table gives an empty result."""
    sets = write_table(_sets(docs, n, percent), "near-sets")
    full = sets.where("n > 0")
    equal = full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("count")).where("count > 1")
    equal = write_table(equal.select("f1", "f2", "n", "rep"), "near-equal")
    copies = write_table(full.join(jaccard._small(equal), ["f1", "f2", "n"]).where("id <> rep").select("id", "rep"), "near-copies")
    reps = sets.where("size(bands) > 0").join(jaccard._small(copies.select("id")), "id", "left_anti")

    # Buckets: the band values that stand on several sets; buckets of the same members are one.
    postings = reps.select(F.explode("bands").alias("token"), "id").repartitionByRange("token", "id").sortWithinPartitions("token", "id")
    shared = write_table(jaccard._members(postings), "near-shared")
    buckets = shared.groupBy("token").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"))
    buckets = buckets.where("size > 1").groupBy("head", "last", "size", "sum").agg(F.min("token").alias("token"), F.count("*").alias("times"))
    buckets = write_table(buckets.select("token", "head", "times"), "near-buckets")
    members = write_table(shared.join(jaccard._small(buckets), "token").select("token", "id", "head", "times"), "near-members")
    involved = write_table(members.select("id").distinct(), "near-ids")
    bodies = write_table(_bodies(docs.select("id", "text").join(jaccard._small(involved), "id", "left_semi"), n), "near-bodies")

    # Each set against the head that it shares most bands with.
    pairs = members.where("id <> head").groupBy("id", "head").agg(F.sum("times").alias("times"))
    best = pairs.groupBy("id").agg(F.max(F.struct("times", "head")).alias("x")).select(F.col("x.head").alias("a"), F.col("id").alias("b"))
    linked = _confirm(best, bodies, percent)
    roots = write_table(roots_of_parents(linked.select(F.col("b").alias("node"), F.col("a").alias("parent"))), "near-roots")

    # Buckets that hold several classes.
    grouped = write_table(members.join(roots, F.col("id") == F.col("node"), "left").select("token", "id", F.coalesce("root", "id").alias("class")), "near-grouped")
    mixed = grouped.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("token")
    rows = write_table(grouped.join(mixed, "token").join(bodies.select("id", "n"), "id").select("token", "id", "n", "class"), "near-mixed")
    dealt = write_table(jaccard._dealt(rows, percent), "near-dealt")
    tiled = bodies.select("id", "body").join(_sent(dealt), "id").select("tile", "side", "id", "class", "body")
    more = write_table(_tiles(tiled.repartition("tile").sortWithinPartitions("tile"), percent), "near-links")

    # The links within tiles join the classes found before.
    first, second = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    ends = more.join(first, "a", "left").join(second, "b", "left")
    joined = components(ends.select(F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v")))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left")
    final = write_table(joined.unionByName(moved.select("node", F.coalesce("final", "root").alias("root"))), "near-roots")
    far = copies.join(final.select(F.col("node").alias("rep"), "root"), "rep", "left").select(F.col("id").alias("node"), F.coalesce("root", "rep").alias("root"))
    final = final.unionByName(far)
    return sets.join(final, F.col("id") == F.col("node"), "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "id").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id (the least doc_id of its class) and kept (doc_id = component_id),
    one row for each row.

    Rows of one doc_id and text are one document, and are kept together. A null doc_id takes part like others and is
    never kept; a class has a null component_id only if none of its rows has an id. Other columns are not returned."""
    if not jaccard.ids_repeat(docs):
        found = near_classes(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), n, percent)
        rows = found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    else:
        keyed = jaccard.numbered(docs.select("doc_id", "text"))
        found = write_table(near_classes(keyed.select(F.col("__row").alias("id"), "text"), n, percent), "near-rows")
        keyed = keyed.select(F.col("doc_id").cast("long"), F.col("__row").alias("id")).join(found, "id")
        rows = keyed.join(keyed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
