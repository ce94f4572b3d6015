"""Exact n-gram Jaccard join and its classes: size bands, group signatures, tiles of bitmaps, then exact intersection.

Sets of sizes m and n that link at t% differ in at most (m + n)(100 - t) / (100 + t) shingles. Sizes are cut into bands. For
each band the space of shingle hashes is cut into groups of equal width; each group that holds a shingle gives a token,
the hash of the band, the group's number and the shingles in it. A change spoils one group, so a set with g groups in use
that differs by at most c from any it can link with has at least g - c tokens in common with each of those. A set with
no more than c groups in use also gives each shingle as a token. A set gives tokens for its own band and for higher
bands that hold sizes it can link with.

Sets that share a token form a bucket, all of one or two size bands. As g - c tokens are common, one still is when every set
leaves out the g - c - 1 of its tokens that stand on most sets (in one order for all); so tokens that nobody shares
count against a set, and most sets that are only similar leave all their buckets. Round 1 verifies each set against one head of its
buckets, which joins most of what belongs together. Round 2 takes the buckets that still hold several classes, cuts large
ones by size and then by hash into tiles (a tile is a family of buckets where they fit), and compares the bitmaps of sets of different classes within a tile: the bits in
which two bitmaps differ bound the overlap from above, so most pairs end there. The others are verified by intersection of the
sorted arrays at once, and a link joins their classes, so a tile gives fewer links than it has rows. Every pair that links
is thus in one class after round 1, or verified in round 2."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm import wordhash
from sieveworks.llm.components import components, roots_of_parents
from sieveworks.llm.store import write_table
from sieveworks.llm.wordhash import mix

#: Rows of ids (8 bytes each) that are sent to all executors; beyond it, joins shuffle.
BROADCAST_IDS = 1_000_000
#: Sets, and shingles of sets, that one side of a tile holds, as a rule.
TILE, TILE_SHINGLES = 8192, 6_000_000
#: Sets that are verified against one head in one place.
HUB = 20_000
MOST_BITS = 1 << 15
#: Each size band ends at 3/2 of its start.
BAND = 1.5
#: Groups of a band for each change: more give more tokens, and leave fewer sets in buckets.
SPREAD = 1.25
_GROUP, _LEVEL, _SINGLE = np.uint64(0xD6E8FEB86659FD93), 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_WRAP = (1 << 64) - 1
#: Kinds of tokens: the last three bits.
KINDS = 8
_TOKEN = np.uint64(_WRAP - KINDS + 1)


def _band_starts() -> list[int]:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    return starts


_STARTS = _band_starts()


def band(n: int) -> int:
    return bisect_right(_STARTS, n) - 1


def most_changes(n: int, level: int, percent: int) -> int:
    """The shingles in which a set of n can differ from one that it links with, the larger of both being of the band."""
    other = min(_STARTS[level + 1] - 1, 100 * n // percent)
    return (n + other) * (100 - percent) // (100 + percent)


@cache
def band_groups(level: int, percent: int) -> int:
    """The groups of a band's tokens: SPREAD times the changes at its largest size, and so many that sets of the least
    size that can take part mostly have more groups in use than changes."""
    most, least = _STARTS[level + 1] - 1, -(-percent * _STARTS[level] // 100)
    changes = 2 * most * (100 - percent) // (100 + percent)
    groups, needed = int(SPREAD * changes) + 2, most_changes(least, level, percent) + 1
    while groups < 3 * changes:
        empty = np.exp(-least / groups)
        if groups * (1 - empty) - 3 * np.sqrt(groups * empty * (1 - empty)) > needed:
            break
        groups += max(1, groups >> 5)
    return groups


def tokens(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """The tokens of a sorted shingle array, and how many of each kind may be left out; sets that link, and are not equal,
    have one in common. The last bits of a token tell its kind: the band's number modulo 4, and group or shingle."""
    n, out, spare = len(s), [], [0] * KINDS
    mixed = mix(s ^ _GROUP)
    for level in range(band(n), band(max(n, 100 * n // percent)) + 1):
        changes = most_changes(n, level, percent)
        if not changes:
            continue
        place = ((s >> np.uint64(32)) * np.uint64(band_groups(level, percent))) >> np.uint64(32)
        at = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        own = np.add.reduceat(mixed, at) + (place[at] + np.uint64(1)) * _GROUP
        kind = level % (KINDS // 2) * 2
        out.append(mix(own + np.uint64(_LEVEL * (level + 1) & _WRAP)) & _TOKEN | np.uint64(kind))
        spare[kind] = max(0, len(at) - changes - 1)
        if len(at) <= changes:
            out.append(mix(mixed + np.uint64(_SINGLE * (level + 1) & _WRAP)) & _TOKEN | np.uint64(kind + 1))
            spare[kind + 1] = max(0, n - changes - 1)
    return np.concatenate(out) if out else s[:0], spare


def bitmap_bits(n: int) -> int:
    """Bits for a set of n: the power of two from 2 n on, in bounds; fewer would blur the difference of two sets."""
    return min(MOST_BITS, max(64, 2 << max(0, int(n - 1).bit_length())))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = bitmap_bits(len(shingles))
    at = (mix(shingles) & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(bits, np.uint8)
    out[at] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Narrows bitmaps (rows of 64-bit words) to so many words; a set bit stays set in its place modulo the width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: intersection of sorted arrays against the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batches(rows: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow of a function from an iterator of batches to an iterator of column lists."""
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return rows.mapInArrow(run, schema)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n, two halves of the set's fingerprint, its tokens and how many of each kind it can spare, for each document."""

    def describe(batches):
        for batch in batches:
            for part in wordhash.slices(batch, 1):
                sizes, halves, found, spare = [], [], [], []
                for s in wordhash.shingles(wordhash.split(part.column(1)), n):
                    sizes.append(len(s))
                    halves.append(xxhash.xxh3_128_digest(s.tobytes()))
                    own, spared = tokens(s, percent) if len(s) else (s, [0] * KINDS)
                    found.append(own)
                    spare.append(spared)
                f = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 2)
                ends = np.concatenate(([0], np.cumsum([len(t) for t in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield part.column(0), sizes, pa.array(f[:, 0]), pa.array(f[:, 1]), lists, spare

    return _batches(docs.select("id", "text"), describe, "id long, n int, f1 long, f2 long, tokens array<long>, spare array<long>")


def _arrays(docs: DataFrame, n: int) -> DataFrame:
    """id, n and the sorted shingle array of each document."""

    def describe(batches):
        for batch in batches:
            for part in wordhash.slices(batch, 1):
                found = wordhash.shingles(wordhash.split(part.column(1)), n)
                yield part.column(0), [len(s) for s in found], [s.tobytes() for s in found]

    return _batches(docs.select("id", "text"), describe, "id long, n int, shingles binary")


def _members(postings: DataFrame) -> DataFrame:
    """From rows token, id in that order: the rows whose token stands on several, and the first and last of each task,
    as a bucket may go on in the next one."""

    def stream(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, ids = (_longs(c) for c in batch.columns)
            if last is not None:
                token, ids = np.concatenate((last[0], token)), np.concatenate((last[1], ids))
            same = token[1:] == token[:-1]
            keep = np.concatenate(([last is None or last[2]], same))
            keep[:-1] |= same
            # The last row waits for the next batch, which may have its token.
            yield pa.array(token[:-1][keep[:-1]]), pa.array(ids[:-1][keep[:-1]])
            last = token[-1:], ids[-1:], bool(keep[-1])
        if last is not None:
            yield pa.array(last[0]), pa.array(last[1])

    return _batches(postings, stream, "token long, id long")


def _needed(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """shared: token, id of tokens that stand on several sets (and a few others). Those of each set that it cannot spare:
    of every kind it leaves out as many as it may, beginning with the tokens on most sets."""
    sizes = shared.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    ids = write_table(shared.select("id").distinct(), "jaccard-ids")
    kind = F.pmod(F.col("token"), F.lit(KINDS))
    rows = shared.join(sizes, "token").join(sets.join(_small(ids), "id", "left_semi"), "id")
    rows = rows.select("token", "id", "size", kind.alias("kind"), F.element_at("spare", (kind + 1).cast("int")).alias("spare"))
    order = Window.partitionBy("id", "kind").orderBy(F.desc("size"), F.desc("token"))
    return rows.withColumn("place", F.row_number().over(order)).where("place > spare").select("token", "id")


def _verify(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), one for each b, those whose sets link. The sets of one a come together in parts of about HUB."""
    hubs = write_table(pairs.groupBy("a").count().where(F.col("count") > HUB).select("a", F.ceil(F.col("count") / HUB).cast("int").alias("parts")), "jaccard-hubs")
    sized = pairs.join(_small(hubs), "a", "left")
    keyed = write_table(sized.select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"), "b"), "jaccard-pairs")
    heads = keyed.select("a", "part").distinct()
    rows = arrays.select("id", "shingles")
    rows = heads.select("a", "part", F.col("a").alias("id")).unionByName(keyed.select("a", "part", F.col("b").alias("id"))).join(rows, "id")
    rows = rows.select("a", "part", (F.col("id") != F.col("a")).cast("int").alias("role"), "id", "shingles")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def check(batches):
        head = None
        for batch in batches:
            out = [], []
            for role, i, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                s = np.frombuffer(body.as_buffer(), np.uint64)
                if role == 0:
                    head = i, s.copy()
                elif links(head[1], s, percent):
                    out[0].append(head[0])
                    out[1].append(i)
            yield out

    return write_table(_batches(rows, check, "a long, b long"), "jaccard-links")


class Tile:
    """Sets of a tile with the class of each; finds links between classes and joins the classes as it goes."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]], percent: int):
        """rows: side (1 left, 2 right, 3 both), id, class, shingles; sets of different sides meet, and those of 3 all."""
        rows = sorted(((np.frombuffer(r[3], np.uint64), *r[:3]) for r in rows), key=lambda r: len(r[0]))
        self.sets = [r[0] for r in rows]
        self.side, self.ids, self.percent = np.array([r[1] for r in rows]), [r[2] for r in rows], percent
        _, self.group = np.unique(np.array([r[3] for r in rows]), return_inverse=True)
        self.size = np.array([len(s) for s in self.sets], np.int64)

    def links(self) -> Iterator[tuple[int, int]]:
        percent, left = self.percent, len(np.unique(self.group))
        maps = [bitmap(s) for s in self.sets]
        widths = np.array([len(m) for m in maps])
        for width in np.unique(widths):
            # A pair is compared at the width of its smaller bitmap; sizes ascend, and so do widths.
            begin = int(np.searchsorted(widths, width))
            bits = np.concatenate([fold(m[None, :], width) for m in maps[begin:]])
            for i in range(begin, int(np.searchsorted(widths, width, "right"))):
                if left < 2:
                    return
                to = int(np.searchsorted(self.size, 100 * self.size[i] // percent, "right"))
                there = np.arange(i + 1, to)
                there = there[(self.group[i + 1 : to] != self.group[i]) & ((self.side[i + 1 : to] | self.side[i]) == 3)]
                if not len(there):
                    continue
                differ = np.bitwise_count(bits[there - begin] ^ bits[i - begin]).sum(1, dtype=np.int64)
                for j in there[differ * (100 + percent) <= (self.size[there] + self.size[i]) * (100 - percent)]:
                    if self.group[j] != self.group[i] and links(self.sets[i], self.sets[j], percent):
                        self.group[self.group == self.group[j]] = self.group[i]
                        left -= 1
                        yield min(self.ids[i], self.ids[j]), max(self.ids[i], self.ids[j])


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """Links between classes, fewer than the rows, from rows tile, side, id, class, shingles in order of tile."""

    def compare(batches):
        key, held = None, []

        def flush():
            found = list(Tile(held, percent).links())
            return [p[0] for p in found], [p[1] for p in found]

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for tile, *row in zip(*columns, strict=True):
                if tile != key:
                    if len(held) > 1:
                        yield flush()
                    key, held = tile, []
                held.append(row)
        if len(held) > 1:
            yield flush()

    return _batches(members, compare, "a long, b long")


def _small(rows: DataFrame) -> DataFrame:
    """A written table, with the hint to broadcast it if it is small enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _dealt(rows: DataFrame, percent: int) -> DataFrame:
    """rows token, id, n, class of buckets that hold several classes: tile, side, id and class for each place a set goes to.

    Buckets that have sets in common make a family. A family that fits is one tile, so each of its sets goes to one place.
    Of other families, a bucket is one tile if it fits. A larger one is cut into bands of sizes in the ratio of the threshold, so that sets
    link within a band or with the next, and bands into parts by hash; a tile is a part, or two parts that can meet."""
    heads = rows.groupBy("token").agg(F.min("id").alias("head"))
    families = components(rows.join(heads, "token").select(F.col("id").alias("u"), F.col("head").alias("v")).where("u <> v").distinct())
    sets = rows.select("id", "n", "class").distinct().join(families, F.col("id") == F.col("node"), "left")
    sets = write_table(sets.select("id", "n", "class", F.coalesce("root", "id").alias("family")), "jaccard-families")
    fits = (F.count("*") <= TILE) & (F.sum("n") <= TILE_SHINGLES)
    wide = write_table(sets.groupBy("family").agg(fits.alias("fits")).where("NOT fits").select("family"), "jaccard-wide")
    together = sets.join(_small(wide), "family", "left_anti").select(F.xxhash64("family", F.lit("family")).alias("tile"), F.lit(3).alias("side"), "id", "class")
    if wide.limit(1).count() == 0:
        return together
    rows = write_table(rows.join(sets.join(_small(wide), "family", "left_semi").select("id"), "id", "left_semi"), "jaccard-mixed")
    return together.unionByName(_dealt_buckets(rows, percent))


def _dealt_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """The tiles of single buckets, as _dealt says."""
    measured = write_table(rows.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")), "jaccard-measured")
    fits = (F.col("size") <= TILE) & (F.col("shingles") <= TILE_SHINGLES)
    large = write_table(measured.where(~fits).select("token"), "jaccard-large")
    whole = rows.join(_small(large), "token", "left_anti").select(F.xxhash64("token").alias("tile"), F.lit(3).alias("side"), "id", "class")
    if large.limit(1).count() == 0:
        return whole
    step = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1.0
    cut = rows.join(_small(large), "token").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    parts = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int")
    bands = write_table(cut.groupBy("token", "band").agg(parts.alias("parts")), "jaccard-bands")
    above = bands.select("token", (F.col("band") - 1).alias("band"), F.col("parts").alias("parts_above"))
    below = bands.select("token", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_below"))
    bands = write_table(bands.join(above, ["token", "band"], "left").join(below, ["token", "band"], "left"), "jaccard-bands")
    cut = cut.join(_small(bands), ["token", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pairs(low_band, low_part, high_band, high_part, side):
        return F.struct(low_band.alias("lb"), low_part.cast("long").alias("lp"), high_band.alias("hb"), high_part.cast("long").alias("hp"), side.cast("int").alias("side"))

    def upto(n):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))

    own, part = F.col("band"), F.col("part")
    same = F.transform(upto(F.col("parts")), lambda q: pairs(own, F.least(part, q.cast("long")), own, F.greatest(part, q.cast("long")), F.when(q == part, 3).when(part < q, 1).otherwise(2)))
    up = F.transform(upto(F.col("parts_above")), lambda q: pairs(own, part, own + 1, q, F.lit(1)))
    down = F.transform(upto(F.col("parts_below")), lambda q: pairs(own - 1, q, own, part, F.lit(2)))
    dealt = cut.select("token", "id", "class", F.explode(F.concat(same, up, down)).alias("t"))
    return whole.unionByName(dealt.select(F.xxhash64("token", "t.lb", "t.lp", "t.hb", "t.hp").alias("tile"), F.col("t.side").alias("side"), "id", "class"))


def jaccard_classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs: id (long, unique, not null), text. A row (id, n_shingles, component) for each document.

    Two documents link when 100 x intersection >= percent x union of their sets of n-word shingles; component is the
    least id that links reach. Null texts and texts without words have no shingles and link with nothing, equal sets
    always link. Documents of equal sets are represented by one from the start. A very long text is shingled and compared whole, in
    one task's memory. An empty table gives an empty result."""
    sets = write_table(_sets(docs, n, percent), "jaccard-sets")
    full = sets.where("n > 0")
    classes = full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("count")).where("count > 1")
    classes = write_table(classes.select("f1", "f2", "n", "rep"), "jaccard-classes")
    copies = write_table(full.join(_small(classes), ["f1", "f2", "n"]).where("id <> rep").select("id", "rep"), "jaccard-copies")
    reps = sets.where("size(tokens) > 0").join(_small(copies.select("id")), "id", "left_anti")
    postings = reps.select(F.explode("tokens").alias("token"), "id").repartitionByRange("token", "id").sortWithinPartitions("token", "id")
    shared = write_table(_members(postings), "jaccard-shared")
    members = write_table(_needed(shared, reps.select("id", "spare")), "jaccard-members")
    buckets = members.groupBy("token").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"))
    # Buckets of the same members are one.
    buckets = buckets.where("size > 1").groupBy("head", "last", "size", "sum").agg(F.min("token").alias("token"), F.count("*").alias("times"))
    buckets = write_table(buckets.select("token", "head", "times"), "jaccard-buckets")
    members = write_table(members.join(buckets, "token").select("token", "id", "head", "times"), "jaccard-members")
    involved = write_table(members.select("id").distinct(), "jaccard-ids")
    arrays = write_table(_arrays(docs.select("id", "text").join(_small(involved), "id", "left_semi"), n), "jaccard-arrays")

    # Round 1: each set against the head that it shares most buckets with.
    pairs = members.where("id <> head").groupBy("id", "head").agg(F.sum("times").alias("times"))
    best = pairs.groupBy("id").agg(F.max(F.struct("times", "head")).alias("x")).select(F.col("x.head").alias("a"), F.col("id").alias("b"))
    linked = _verify(best, arrays, percent)
    roots = write_table(roots_of_parents(linked.select(F.col("b").alias("node"), F.col("a").alias("parent"))), "jaccard-roots")

    # Round 2: buckets that hold several classes.
    grouped = members.join(roots, F.col("id") == F.col("node"), "left").select("token", "id", F.coalesce("root", "id").alias("class"))
    grouped = write_table(grouped, "jaccard-grouped")
    mixed = grouped.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("token")
    rows = grouped.join(mixed, "token").join(arrays.select("id", "n"), "id").select("token", "id", "n", "class")
    tiled = _dealt(write_table(rows, "jaccard-mixed"), percent).join(arrays.select("id", "shingles"), "id")
    tiled = tiled.select("tile", "side", "id", "class", "shingles").repartition("tile").sortWithinPartitions("tile")
    more = write_table(_tiles(tiled, percent), "jaccard-links")

    # The links of round 2 join the classes of round 1.
    ends = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
    joined = components(ends.select(F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v")))
    final = joined.select("node", "root").unionByName(
        roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    )
    final = write_table(final, "jaccard-roots")
    far = copies.join(final.select(F.col("node").alias("rep"), "root"), "rep", "left").select(F.col("id").alias("node"), F.coalesce("root", "rep").alias("root"))
    final = final.unionByName(far)
    return sets.join(final, F.col("id") == F.col("node"), "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "id").alias("component"))


def jaccard_rows(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs (doc_id, text) with n_shingles and component_id, the least doc_id of its class; one row for each row.

    Rows of one doc_id and text are one document. A null doc_id takes part like others; a class has a null component_id
    only if none of its rows has an id. Other columns are not returned."""
    if not ids_repeat(docs):
        found = jaccard_classes(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), n, percent)
        return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    keyed = numbered(docs.select("doc_id", "text"))
    found = write_table(jaccard_classes(keyed.select(F.col("__row").alias("id"), "text"), n, percent), "jaccard-rows")
    rows = keyed.select("doc_id", F.col("__row").alias("id")).join(found, "id")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", "n_shingles", "component_id")


def ids_repeat(docs: DataFrame) -> bool:
    """Whether a doc_id is null or stands on several rows."""
    return docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count() > 0


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number __row for each row, written, so that the numbers stay."""
    return write_table(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
