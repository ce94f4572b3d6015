"""Alignment of two tokenizers: where their tokens end together, which ids meet there, and how often the corpus links them.

A text is cut into units at each space that follows another kind of character; neither tokenizer joins across such a place, so a
unit is encoded and aligned once for each distinct one of a slice. Each slice gives one posting a side id: the other ids it
is linked with there, in how many documents, and the documents with their numbers of links. Postings are dealt by group of side
ids and, where they are many, by parts of the slices, and read as sorted streams behind the counts of each id's pairs; counts and their
maximum are settled in the task, contributions of documents are emitted and summed by document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import wordhash
from sieveworks.llm.store import write_table

#: Before a space that follows another kind of character; a last space stays with the word before it, as B gives nothing for it alone.
_CUT = re.compile(r"(?<=\S)(?= [\s\S])")
#: What has such places otherwise: a space at an end, or after white space.
_ODD = r"^ | $|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Bytes of text of a slice, units that are encoded at a time, and links of a group from which on its distinct ids are paired.
SLICE, BATCH, WIDE_GROUP = 4 << 20, 8192, 64
#: Groups of side ids, and entries of a group in one part of the slices, as a rule. A document lies in one part, so it gives at
#: most one row a group whatever the size of the input.
GROUPS, PART_ENTRIES = 32, 2_000_000
#: Contributions that a task holds before it sums them, and half of it those that it keeps.
HELD = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the others,
    in order, for the characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Units(NamedTuple):
    """What distinct units give, by number: whether a unit is given back byte for byte, token numbers, groups, its groups as
    text; and its links, pairs[first[i]:first[i + 1]] (a << 32 | b) with their numbers."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    texts: list[bytes]
    first: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs (start, length) one after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, unit: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of each unit, their numbers, and where each unit's begin, from the tokens and the cuts of groups."""
    size_a, size_b = np.diff(cut_a), np.diff(cut_b)
    few = size_a * size_b <= WIDE_GROUP
    group = np.flatnonzero(few)
    left = _spread(cut_a[group], size_a[group])
    of_left = np.repeat(group, size_a[group])
    right = _spread(cut_b[of_left], size_b[of_left])
    pairs = [np.repeat(a[left], size_b[of_left]) << 32 | b[right]]
    owners, times = [np.repeat(unit[of_left], size_b[of_left])], [np.ones(len(right), np.int64)]
    # Repeated ids of a wide group are paired once.
    for g in np.flatnonzero(~few).tolist():
        x, m = np.unique(a[cut_a[g] : cut_a[g + 1]], return_counts=True)
        y, n = np.unique(b[cut_b[g] : cut_b[g + 1]], return_counts=True)
        pairs.append((x[:, None] << 32 | y).ravel())
        times.append((m[:, None] * n).ravel())
        owners.append(np.full(len(pairs[-1]), unit[g]))
    known, which = np.unique(np.concatenate(pairs), return_inverse=True)
    keys, at = np.unique(np.concatenate(owners) * len(known) + which, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate(times))
    return known[keys % max(1, len(known))], total, np.searchsorted(keys, np.arange(n_units + 1) * len(known))


class Aligner:
    """Encodes and aligns distinct units, all of a slice at once."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        alphabet, names = byte_alphabet(), [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(alphabet[c] for c in t) if set(t) <= alphabet.keys() else t.encode() for t in names]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        # Units are encoded one by one; a piece across a unit's start would join them.
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError(f"{pieces} has pieces across spaces")
        self.lengths = [np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        most = max(len(self.bytes_a), len(self.bytes_b))
        # A token in the text of groups, by what stands before it: nothing, a further group, a further token, the other side.
        self.words, self.most = [f"{before}{i}" for before in ("\n", ";", ",", "|") for i in range(most)], most

    def _encode(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all units, one after another, and how many each has."""
        first, second = self.a.encode_batch_fast, self.b.encode
        sides = ([], []), ([], [])
        for at in range(0, len(units), BATCH):
            some = units[at : at + BATCH]
            for found, (ids, sizes) in zip(([e.ids for e in first([f" {u}" for u in some], add_special_tokens=False)], second(some, num_threads=1)), sides):
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
                ids.append(np.fromiter(chain.from_iterable(found), np.int64, int(sizes[-1].sum())))
        return [(np.concatenate(ids), np.concatenate(sizes)) for ids, sizes in sides]

    def _valid(self, units: list[str], sizes: np.ndarray, side: int, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which units a side gives back byte for byte; mostly all, which one comparison tells."""
        table = (self.bytes_a, self.bytes_b)[side]
        ends = np.concatenate(([0], np.cumsum(n)))
        spelt = np.concatenate(([0], np.cumsum(self.lengths[side][ids])))[ends]
        whole, wanted = b"".join(map(table.__getitem__, ids.tolist())), f" {' '.join(units)}".encode()
        if whole == wanted and (np.diff(spelt) == sizes).all():
            return n > 0
        return np.array([whole[s:e] == f" {u}".encode() and e > s for u, s, e in zip(units, spelt.tolist(), spelt[1:].tolist())], bool)

    def __call__(self, units: list[str], sizes: np.ndarray) -> Units:
        """units: distinct, without the space that each begins with; sizes: the bytes of each with it."""
        (a, n_a), (b, n_b) = self._encode(units)
        valid = self._valid(units, sizes, 0, a, n_a) & self._valid(units, sizes, 1, b, n_b)
        a, b, n_a, n_b = a[np.repeat(valid, n_a)], b[np.repeat(valid, n_b)], n_a * valid, n_b * valid
        # Both sides spell the same bytes, so ends are compared over all units at once; units end where both do.
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cut_a, cut_b = (np.concatenate(([0], np.searchsorted(e, common, "right"))) for e in (ends_a, ends_b))
        kept = np.flatnonzero(valid)
        unit = kept[np.searchsorted(np.cumsum(sizes[kept]), common)]
        pairs, times, offsets = _links(a, b, cut_a, cut_b, unit, len(units))
        texts = [b""] * len(units)
        for i, text in zip(kept.tolist(), self._texts(a, b, cut_a, cut_b, unit)):
            texts[i] = text
        return Units(valid, n_a, n_b, np.bincount(unit, minlength=len(units)), texts, offsets, pairs, times)

    def _texts(self, a, b, cut_a, cut_b, unit) -> list[bytes]:
        """The groups of each unit as text: both sides' tokens in the order of groups, each after its mark."""
        begins = np.concatenate(([True], unit[1:] != unit[:-1]))[: len(unit)]
        marks_a, marks_b = np.full(len(a), 2), np.full(len(b), 2)
        marks_a[cut_a[:-1]] = np.where(begins, 0, 1)
        marks_b[cut_b[:-1]] = 3
        # A group's A tokens stand after all tokens of the groups before it; its B tokens after its A tokens.
        place_a = np.arange(len(a)) + np.repeat(cut_b[:-1], np.diff(cut_a))
        place_b = np.arange(len(b)) + np.repeat(cut_a[1:], np.diff(cut_b))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a], codes[place_b] = marks_a * self.most + a, marks_b * self.most + b
        return "".join(map(self.words.__getitem__, codes.tolist())).encode().split(b"\n")[1:]


@cache
def aligner(byte_bpe: str, pieces: str) -> Aligner:
    return Aligner(byte_bpe, pieces)


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in 1, 2 or 4 bytes each, after a byte that tells how many."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(body: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    """The next n numbers of a body, and the rest of it."""
    end = 1 + n * body[0]
    return np.frombuffer(body[1:end], f"<u{body[0]}").astype(np.int64), body[end:]


FACTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTINGS = "a int, base long, bs array<int>, docs array<int>, body binary"


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The units of all texts that are not empty, without the space that each begins with; how many each text has, and its number.

    Where no space follows white space and none stands at an end, units are what lies between spaces."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False).to_numpy(zero_copy_only=False)
    plain, others = np.flatnonzero((size > 0) & ~odd), np.flatnonzero((size > 0) & odd)
    pieces = pc.split_pattern(texts.take(pa.array(plain)), " ")
    listed = [[u[1:] for u in _CUT.split(f" {t}")] for t in texts.take(pa.array(others)).to_pylist()]
    counts = np.concatenate((pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(u) for u in listed], np.int64)))
    flat = pieces.flatten()
    more = pa.array(list(chain.from_iterable(listed)), flat.type)
    return pa.concat_arrays([flat, more]), counts, np.concatenate((plain, others))


def _postings(units: Units, which: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, ...]:
    """Of texts by number, given the units of each: the distinct (pair, text), in order, and the links of each."""
    both, repeats = np.unique(owner * len(units.texts) + which, return_counts=True)
    owner, which = both // len(units.texts), both % len(units.texts)
    length = np.diff(units.first)[which]
    at = _spread(units.first[:-1][which], length)
    known, pair = np.unique(units.pairs, return_inverse=True)
    keys = pair[at] * n_texts + np.repeat(owner, length)
    times = units.times[at] * np.repeat(repeats, length)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return known[keys[first] // n_texts], keys[first] % n_texts, np.add.reduceat(times, first)


def _encode(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """The facts of all rows (a null) and the postings of all slices, in one table.

    A row's number is its partition's number shifted by 40, plus its place; postings hold places from the slice's base on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align, base = aligner(byte_bpe, pieces), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in wordhash.slices(batch, 1, SLICE):
                n = part.num_rows
                flat, counts, order = _cut(part.column(1))
                coded = flat.dictionary_encode()
                which, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                units = align(names.to_pylist(), pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
                owner, bad = np.repeat(order, counts), np.ones(n, bool)
                bad[order] = False
                bad[owner[~units.valid[which]]] = True
                digests, ends = [""] * n, np.cumsum(counts)
                for doc, s, e in zip(order.tolist(), (ends - counts).tolist(), ends.tolist()):
                    if not bad[doc]:
                        digests[doc] = hashlib.sha256(b";".join(map(units.texts.__getitem__, which[s:e].tolist()))).hexdigest()
                owner, which = owner[~bad[owner]], which[~bad[owner]]
                links = np.add.reduceat(np.append(units.times, 0), units.first[:-1]) * (np.diff(units.first) > 0) if len(names) else np.empty(0, np.int64)
                sums = [np.bincount(owner, values[which], n).astype(np.int64) for values in (units.n_a, units.n_b, units.n_groups, links)]
                yield _batch([pa.array(np.arange(base, base + n)), part.column(0), *map(pa.array, sums), pa.array(digests, pa.string())], FACTS_NAMES)
                if len(which):
                    yield from _posting_rows(*_postings(units, which, owner, n), base)
                base += n

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{FACTS}, {POSTINGS}")


FACTS_NAMES = [f.split()[0] for f in FACTS.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
_FIELDS = {f.split()[0]: _TYPES[f.split()[1]] for f in f"{FACTS}, {POSTINGS}".split(", ")}


def _batch(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A batch of all columns; those not given are null."""
    given = dict(zip(names, columns, strict=True))
    n = len(columns[0])
    return pa.record_batch([given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in _FIELDS.items()], list(_FIELDS))


def _posting_rows(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, base: int) -> Iterator[pa.RecordBatch]:
    """One row a side id: its pairs' other ids, the documents of each, and the body: places and links in that order."""
    runs = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    counts = np.diff(np.append(runs, len(pair)))
    side, other = pair[runs] >> 32, pair[runs] & 0xFFFFFFFF
    at = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
    ends = np.append(at, len(side)).astype(np.int32)
    edges = np.append(runs[at], len(pair)).tolist()
    bodies = [_narrow(doc[s:e]) + _narrow(times[s:e]) for s, e in zip(edges, edges[1:])]
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (other, counts)]
    yield _batch([pa.array(side[at]), pa.array(np.full(len(at), base)), *lists, pa.array(bodies)], ["a", "base", "bs", "docs", "body"])


def _contributions(streams: DataFrame) -> DataFrame:
    """From rows a, part, kind, base, bs, docs, body in order of (a, part, kind): (row, n_best, count_sum) of each posting.

    Kind 0 tells the counts of all pairs of the id, over the whole corpus; no id has more than the other vocabulary's size.
    Kind 1 is a posting; it is read once, after them. Contributions are summed by row over all postings of a task, and leave
    at its end, or when there are too many to hold."""

    def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        found, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        out = [found]
        for i in (1, 2):
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, at, np.concatenate([h[i] for h in held]))
            out.append(sums)
        return tuple(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = counts = None
        held, size = [], 0

        def leave(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c) for c in sums], ["row", "n_best", "count_sum"])

        for batch in batches:
            columns = [batch.column(i) for i in range(2, 7)]
            for kind, base, bs, docs, body in zip(columns[0].to_pylist(), columns[1].to_pylist(), *columns[2:], strict=True):
                others, n = (np.asarray(v.values) for v in (bs, docs))
                if kind == 0:
                    order = np.argsort(others)
                    ids, counts = others[order], n[order].astype(np.int64)
                    continue
                count = np.repeat(counts[np.searchsorted(ids, others)], n)
                places, rest = _wide(memoryview(body.as_buffer()), len(count))
                times, _ = _wide(rest, len(count))
                held.append((base + places, np.where(count == counts.max(), times, 0), count * times))
                size += len(count)
                if size > HELD:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield leave(held[0])
                        held, size = [], 0
        if held:
            yield leave(summed(held))

    return streams.mapInArrow(run, "row long, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """docs (doc_id, text) encoded by a byte-level BPE (A) and a sentencepiece BPE with byte fallback (B): doc_id, n_a, n_b,
    n_groups, n_links, n_best, count_sum, groups_sha256, a row for each row.

    Groups are cut where tokens of both end; links are all pairs of tokens in one group; a pair's count is the number of
    rows of docs that hold it linked. n_best counts the links whose count is the highest of their A id, count_sum sums the
    counts over links. Null and empty texts, and texts that a tokenizer does not give back byte for byte (such as any with
    U+2581), have no tokens: zeros and an empty digest. Repeated rows and null ids are documents like others; other
    columns are not read. A very long text is encoded whole, in one task. An empty table gives an empty result."""
    table = write_table(_encode(docs, byte_bpe, pieces), "aligned")
    postings, facts = table.where("a IS NOT NULL").select(*[p.split()[0] for p in POSTINGS.split(", ")]), table.where("row IS NOT NULL").select(*FACTS_NAMES)
    pairs = postings.select("a", F.explode(F.arrays_zip("bs", "docs")).alias("p")).groupBy("a", F.col("p.bs").alias("b")).agg(F.sum("p.docs").alias("n"))
    sides = pairs.groupBy("a").agg(F.collect_list("b").alias("bs"), F.collect_list("n").alias("docs"), F.sum("n").alias("entries"))
    sides = write_table(sides, "alignment-counts")
    total = sides.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    parts = max(1, -(-total // (GROUPS * PART_ENTRIES)))
    # Every part of the slices has the counts of all ids: no more than the pairs of the two vocabularies that occur.
    heads = sides.select("a", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("base"), "bs", "docs", F.lit(None).cast("binary").alias("body"))
    rows = postings.select("a", F.pmod(F.xxhash64("base"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "base", "bs", F.col("docs").cast("array<long>").alias("docs"), "body")
    # One task a group and part, so that a document's rows follow the groups and not the tasks.
    task = F.pmod(F.xxhash64("a"), F.lit(GROUPS)).cast("int") + F.col("part") * GROUPS
    streams = heads.select("a", "part", "kind", "base", "bs", "docs", "body").unionByName(rows).repartitionById(GROUPS * parts, task).sortWithinPartitions("a", "part", "kind")
    sums = _contributions(streams).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = facts.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
