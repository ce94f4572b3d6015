"""Token counts by a tokenizer compiled to a deterministic transducer.

Byte-pair encoding with piece scores has one property that makes it finite-state: a sequence of pieces is the encoding
of its text exactly if each adjacent pair of pieces is the encoding of the pair's text. So the last piece of a prefix
is the longest piece that ends there and fits the last piece of the prefix before it, and the count of a prefix is that
prefix's count plus one. A state holds the longest suffix read that can still begin a piece, the last piece ending
before each of its characters, and the counts there relative to the newest; a transition reads one character and emits
by how much the count changes. States and transitions are compiled when first met.

White space starts a piece or stands alone in runs, so at a run's start (and at characters outside the vocabulary,
which become bytes) the machine is back in its first state. The map of a chunk of text over all states is therefore
given by the text up to its first reset, the count between, and the text after its last reset; such maps compose
associatively, and texts of several chunks are counted by a scan over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = 1 << 16
#: Segments, pairs and states that a task keeps; each memory is emptied when full.
KEPT_SEGMENTS, KEPT_PAIRS, KEPT_STATES = 300_000, 300_000, 300_000
#: Texts that models with another normaliser, prefix, byte fallback or pieces across white space count otherwise.
PROBES = ("", " ", "a", " a", "a  b", "the  end ", "A\u0301 \uff21 \u2460", "\u00a0x", "a\n\tb", "\x00\x01", "\U0001f600\u6f22", "<s> </s> <unk>", "\u2581\u2581a")
_SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class Transducer:
    """Counts pieces of one segment: no mark after other characters."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.begins = {p[:n] for p in scores for n in range(1, len(p) + 1)}
        self.alphabet = {c for p in scores for c in p}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._empty()

    def _empty(self) -> None:
        self.states: dict[tuple, int] = {}
        self.details: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start = self._state(("", (("", 0),)))

    def _state(self, detail: tuple) -> int:
        if (found := self.states.get(detail)) is None:
            found = self.states[detail] = len(self.details)
            self.details.append(detail)
            self.moves.append({})
        return found

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: the adjacent pair of the best-scored piece is joined, leftmost first."""
        parts, scores = list(text), self.scores.get
        pairs = [scores(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while found := [s for s in pairs if s is not None]:
            i = pairs.index(max(found))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = scores(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = scores(parts[i] + parts[i + 1])
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether right may follow left in an encoding; left is empty at the segment's start."""
        if (found := self.pairs.get((left, right))) is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def _move(self, state: int, char: str) -> tuple[int, int]:
        """Compiles one transition. A detail holds a suffix and, for the place before it and after each of its characters,
        (last piece, count less the newest)."""
        tail, steps = self.details[state]
        if char not in self.alphabet:
            move = (self.start, len(char.encode("utf-8", "surrogatepass")))
        else:
            text = tail + char
            for n in range(len(text), 0, -1):
                piece = text[-n:]
                if piece in self.scores or n == 1:
                    before, behind = steps[-n]
                    if self.fits(before, piece):
                        break
            else:
                raise ValueError("no piece fits")
            emitted = behind + (1 if piece in self.scores else len(piece.encode()))
            while text and text not in self.begins:
                text = text[1:]
            # Only places where a later piece can still begin tell states apart.
            kept = (s and text[i:] in self.begins and (s[0], s[1] - emitted) or None for i, s in enumerate(steps[-len(text) :]))
            move = (self._state((text, (*kept, (piece, 0)) if text else ((piece, 0),))), emitted)
        self.moves[state][char] = move
        return move

    def count(self, segment: str) -> int:
        """Pieces (and bytes of characters outside the vocabulary) of one segment."""
        if len(self.details) > KEPT_STATES:
            self._empty()
        state, total, moves = self.start, 0, self.moves
        for char in segment:
            move = moves[state].get(char) or self._move(state, char)
            state = move[0]
            total += move[1]
        return total


class ChunkMap:
    """What a chunk does from any entry state: head up to its first reset, the count between, and its tail.
    Without a reset the whole chunk is the head, and tail is None."""

    __slots__ = ("head", "count", "tail")

    def __init__(self, head: str, count: int = 0, tail: str | None = None):
        self.head, self.count, self.tail = head, count, tail


class Counter:
    """Token counts of whole texts for a piece vocabulary with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, scores: dict[str, float]):
        self.machine, self.kept = Transducer(scores), {}

    def segments(self, text: str) -> int:
        """The count of text that starts at a reset and ends at one."""
        parts, kept = _SEGMENT.findall(text), self.kept
        try:
            return sum(map(kept.__getitem__, parts))
        except KeyError:
            if len(kept) > KEPT_SEGMENTS:
                kept.clear()
            for p in parts:
                if p not in kept:
                    kept[p] = self.machine.count(p)
            return sum(map(kept.__getitem__, parts))

    def map_of(self, chunk: str) -> ChunkMap:
        """Resets within a chunk stand before a mark that follows another character."""
        first = re.search(f"(?<=[^{MARK}]){MARK}", chunk)
        if not first:
            return ChunkMap(chunk)
        last = max(m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", chunk))
        return ChunkMap(chunk[: first.start()], self.segments(chunk[first.start() : last]), chunk[last:])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a's text followed by b's."""
        left = a.head if a.tail is None else a.tail
        joint = left + b.head
        # The seam itself can be a reset: then map_of finds it in the joined text.
        seam = self.map_of(joint)
        if seam.tail is None:
            middle = (None, 0, joint)
        else:
            middle = (seam.head, seam.count, seam.tail)
        if a.tail is None and b.tail is None:
            return seam
        if a.tail is None:  # b has a reset right after joint
            if middle[0] is None:
                return ChunkMap(joint, b.count, b.tail)
            return ChunkMap(seam.head, seam.count + self.segments(seam.tail) + b.count, b.tail)
        if b.tail is None:
            if middle[0] is None:
                return ChunkMap(a.head, a.count, joint)
            return ChunkMap(a.head, a.count + self.segments(seam.head) + seam.count, seam.tail)
        return ChunkMap(a.head, a.count + self.segments(joint) + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Composes in a tree: each round halves the maps, and the compositions of a round are independent."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if len(text) <= CHUNK:
            return self.segments(text)
        whole = self.scan([self.map_of(text[at : at + CHUNK]) for at in range(0, len(text), CHUNK)])
        return self.segments(whole.head) + whole.count + (self.segments(whole.tail) if whole.tail else 0)


@cache
def piece_counter(model: str) -> Counter:
    """Compiles the counter of a sentencepiece BPE model file."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    usable = (i for i in range(pieces.get_piece_size()) if not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_unused(i)))
    counter = Counter({pieces.id_to_piece(i): pieces.get_score(i) for i in usable})
    for probe in PROBES:
        if counter(probe) != len(pieces.encode(probe)):
            raise ValueError(f"{model} does not count as a transducer without normalising: {probe!r}")
    return counter


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text); other columns are not returned.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted like others. No shuffle:
    each row is counted where it is read."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(model)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([count(t) if t else 0 for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
