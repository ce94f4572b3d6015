"""Semantic relevance of results to the concepts of queries: all terms of all queries found in one pass over each text.

The terms are compiled to an automaton: a table of the next state by state and class of character, with failure moves filled
in, and the terms that end in each state. Texts of a batch run side by side, a character of each in a step; long texts
run in windows that overlap by the longest term. What is found is joined with the terms' points and summed by result and query."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.sources.store import write_table

# Points of a term in the title, else in the description; and of one in both read together.
POINTS = {"subject": (25, 10, 0), "action": (20, 8, 0), "descriptor": (12, 5, 0), "compound": (30, 15, 0), "emotion": (0, 0, 10), "context": (0, 0, 8)}
MOST_POINTS = 100
#: Terms of one automaton (its table has about four bytes a character and letter); more run in blocks.
BLOCK_TERMS = 20_000
#: Characters of a window, and rows of points that are sent to all tasks.
WINDOW, BROADCAST_POINTS = 2048, 200_000


class TermFinder:
    """Finds which of the terms stand in texts, as parts of words too. Empty terms are found nowhere."""

    def __init__(self, terms: list[str]):
        self.letters = np.array(sorted({ord(c) for t in terms for c in t}), np.uint32)
        number = {int(c): i + 1 for i, c in enumerate(self.letters)}
        moves, ends = [{}], [[]]
        for n, term in enumerate(terms):
            state = 0
            for c in term:
                if (to := moves[state].get(number[ord(c)])) is None:
                    to = moves[state][number[ord(c)]] = len(moves)
                    moves.append({})
                    ends.append([])
                state = to
            if term:
                ends[state].append(n)
        # Letter 0 stands for all that is in no term.
        self.next, back, queue = np.zeros((len(moves), len(self.letters) + 1), np.int32), [0] * len(moves), deque([0])
        while queue:
            state = queue.popleft()
            if state:
                self.next[state] = self.next[back[state]]
                ends[state] = ends[state] + ends[back[state]]
            for letter, to in moves[state].items():
                back[to] = int(self.next[back[state]][letter]) if state else 0
                self.next[state][letter] = to
                queue.append(to)
        self.first = np.concatenate(([0], np.cumsum([len(e) for e in ends])))
        self.ends = np.array([n for e in ends for n in e], np.int64)
        self.overlap = max(map(len, terms), default=1) - 1

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text, term) pairs by number."""
        starts, sizes, owner, at = [], [], [], 0
        for n, text in enumerate(texts):
            length = len(text or "")
            for begin in range(0, max(1, length - self.overlap), WINDOW):
                starts.append(at + begin)
                sizes.append(min(WINDOW + self.overlap, length - begin))
                owner.append(n)
            at += length
        codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        none = np.empty(0, np.int64)
        if not len(codes) or not len(self.letters):
            return none, none
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letters = np.where(self.letters[place] == codes, place + 1, 0)
        order = np.argsort(-np.array(sizes), kind="stable")
        starts, sizes, owner = np.array(starts)[order], np.array(sizes)[order], np.array(owner)[order]
        state, rows, states = np.zeros(len(order), np.int32), [], []
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step, "left"))
            now = state[:live] = self.next[state[:live], letters[starts[:live] + step]]
            hit = np.flatnonzero(self.first[now + 1] > self.first[now])
            if len(hit):
                rows.append(owner[hit])
                states.append(now[hit])
        if not rows:
            return none, none
        pairs = np.unique(np.concatenate(rows) * np.int64(len(self.next)) + np.concatenate(states))
        row, state = pairs // len(self.next), pairs % len(self.next)
        n = self.first[state + 1] - self.first[state]
        term = self.ends[np.repeat(self.first[state] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        found = np.unique(np.repeat(row, n) * np.int64(len(self.ends) + 1) + term)
        return found // (len(self.ends) + 1), found % (len(self.ends) + 1)


def term_hits(rows: DataFrame, terms: list[str]) -> DataFrame:
    """rows: pos and texts. pos, term (its number) and place (1 for the first text, 2 for the second, 4 for the third, added up)."""
    finder, names = TermFinder(terms), rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = [], []
            for i in range(len(names)):
                row, term = finder(batch.column(i + 1).to_pylist())
                keys.append(row * np.int64(len(terms)) + term)
                places.append(np.full(len(row), 1 << i))
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            place = np.zeros(len(found), np.int64)
            np.add.at(place, at, np.concatenate(places))
            pos = batch.column(0).take(pa.array(found // len(terms)))
            yield pa.record_batch([pos, pa.array(found % len(terms)), pa.array(place)], ["pos", "term", "place"])

    return rows.withColumn(rows.columns[0], F.col(rows.columns[0]).cast("long")).mapInArrow(run, "pos long, term long, place long")


def semantic_relevance(results: DataFrame, concepts: DataFrame) -> DataFrame:
    """results: pos (its own for each), title, description. concepts: query_id, kind (a key of POINTS), term: a row for each
    concept and each of its related terms. query_id, pos and score, up to 100, of those above 0.

    A term counts where it stands in the lower-cased title, else the description, or (emotions and contexts) in both read
    together; a term given twice counts twice. Null texts hold nothing, null and empty terms and other kinds give nothing."""
    points = F.lit(None)
    for kind, p in POINTS.items():
        points = F.when(F.col("kind") == kind, F.array(*map(F.lit, p))).otherwise(points)
    rows = concepts.where("term <> ''").withColumn("p", points).where("p IS NOT NULL").groupBy("query_id", "term").agg(*[F.sum(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("in_title", "in_description", "in_both"))])
    rows = write_table(rows, "term-points")
    terms = [r[0] for r in rows.select("term").distinct().orderBy("term").collect()]
    texts = results.select("pos", F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.coalesce("description", F.lit(""))).alias("d"))
    texts = texts.select("pos", "t", "d", F.concat_ws(" ", "t", "d").alias("b"))
    parts = []
    for begin in range(0, len(terms), BLOCK_TERMS):
        block = terms[begin : begin + BLOCK_TERMS]
        numbered = rows.sparkSession.createDataFrame(list(enumerate(block)), "number long, term string")
        worth = rows.join(numbered, "term").select(F.col("number").alias("term"), "query_id", "in_title", "in_description", "in_both")
        # The points of one block of terms, sent to the tasks where they are few.
        hits = term_hits(texts, block).join(F.broadcast(worth) if rows.count() <= BROADCAST_POINTS else worth, "term")
        place = F.col("place")
        value = F.when(place.bitwiseAND(1) > 0, F.col("in_title")).when(place.bitwiseAND(2) > 0, F.col("in_description")).otherwise(0) + F.when(place.bitwiseAND(4) > 0, F.col("in_both")).otherwise(0)
        parts.append(hits.select("query_id", "pos", value.alias("value")))
    if not parts:
        return rows.select("query_id", F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("score")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    summed = out.groupBy("query_id", "pos").agg(F.least(F.sum("value"), F.lit(MOST_POINTS)).cast("double").alias("score"))
    return summed.where("score > 0")
