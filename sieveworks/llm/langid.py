"""Language identification: scripts narrow the candidates of each word, and a Viterbi path labels spans of text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieveworks.llm import wordhash
from sieveworks.llm.text import is_fold

#: First code point and name of the ranges that hold letters of one script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
_STARTS, _NAMES = [s for s, _ in SCRIPTS], [n for _, n in SCRIPTS]
WORD_RE = re.compile(r"[^\W\d_]+")
#: Documents of each language that the model is fitted on at most (in expectation), chosen by a hash of their id.
TRAIN_DOCS = 1500
#: A script belongs to a language from this share of its training letters on.
SCRIPT_SHARE = 0.01
#: Cost of changing the language between two words, and the most one word can speak for a language against another.
SWITCH, MOST = 12.0, 4.0
SMOOTH = 2.0
#: Bytes of text whose distinct words are scored together.
SLICE = 1 << 20


def script_of(char: str) -> str:
    return _NAMES[bisect_right(_STARTS, ord(char)) - 1]


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether a word can hold it, whether it is a letter, and its lower case if that is one code point."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    inside, letter = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for m in WORD_RE.finditer(every):
        inside[[ord(c) for c in m.group()]] = True
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in every:
        if c.isalpha():
            letter[ord(c)] = True
            if len(low := c.lower()) == 1:
                lower[ord(c)] = ord(low)
    return inside, letter, lower


def _key(a, b, c):
    """Three code points as one number."""
    return (a << np.uint64(42)) | (b << np.uint64(21)) | c


class LanguageModel:
    """Conditional letter trigrams of each language, and the scripts that each uses."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        """counts: language, three letters (with word boundaries), how often."""
        self.languages = sorted({lang for lang, _, _ in counts})
        place = {lang: i for i, lang in enumerate(self.languages)}
        grams: dict[str, np.ndarray] = {}
        contexts: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for lang, gram, n in counts:
            for table, key in ((grams, gram), (contexts, gram[:2])):
                table.setdefault(key, np.zeros(len(self.languages)))[place[lang]] += n
            if gram[2] != "$":
                letters.setdefault(script_of(gram[2]), np.zeros(len(self.languages)))[place[lang]] += n
        uniform = 1 / max(1, len({g[2] for g in grams}))
        self.gram_keys, self.gram_rows = self._table({g: np.log((n + SMOOTH * uniform) / (contexts[g[:2]] + SMOOTH)) for g, n in grams.items()})
        self.context_keys, self.context_rows = self._table({c: np.log(SMOOTH * uniform / (n + SMOOTH)) for c, n in contexts.items()})
        total = np.maximum(1, sum(letters.values())) if letters else 1
        # A script without letters in the training texts rules no language out.
        self.candidates = np.ones((len(SCRIPTS), len(self.languages)), bool)
        for i, name in enumerate(_NAMES):
            if name in letters and (own := letters[name] / total >= SCRIPT_SHARE).any():
                self.candidates[i] = own

    def _table(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their rows; one more row of zeros stands for what is not there."""
        keys = np.array([_key(*(np.uint64(ord(c)) for c in f"{g:\0<3}")) for g in rows], np.uint64)
        order = np.argsort(keys)
        out = np.zeros((len(rows) + 1, len(self.languages)), "f4")
        if len(rows):
            out[:-1] = np.array(list(rows.values()))[order]
        return keys[order], out

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of a text a row of scores (log-probability of each language less the best, at least -MOST, and
        -MOST for languages that the script rules out; 0 throughout for numerals), whether it has a letter, and the
        words in each run between blanks."""
        inside, letter, lower = _characters()
        codes = np.frombuffer(f"{text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        within = inside[codes]
        before = np.concatenate(([False], within[:-1]))
        starts = np.flatnonzero(within & ~before)
        run = np.cumsum(codes == 0x20)
        counts = np.bincount(run[starts], minlength=int(run[-1]))
        if not len(starts) or not self.languages:
            return np.zeros((len(starts), max(1, len(self.languages))), "f4"), np.zeros(len(starts), bool), counts
        # The places of a word and the one after it, where the word ends.
        at = np.flatnonzero(within | before)
        low = np.where(within, lower[codes], np.uint32(ord("^"))).astype(np.uint64)
        one = np.where(at > 0, low[at - 1], np.uint64(ord("^")))
        two = np.where((at > 1) & before[at], low[at - 2], np.uint64(ord("^")))
        keys = _key(two, one, np.where(within[at], low[at], np.uint64(ord("$"))))
        found = _find(self.gram_keys, keys)
        rows, lost = self.gram_rows[found], np.flatnonzero(found == len(self.gram_keys))
        rows[lost] = self.context_rows[_find(self.context_keys, keys[lost] & ~np.uint64((1 << 21) - 1))]
        firsts = np.searchsorted(at, starts)
        score = np.add.reduceat(rows, firsts)
        allowed = self.candidates[np.searchsorted(_STARTS, codes[starts], "right") - 1]
        score = np.where(allowed, score - np.where(allowed, score, -np.inf).max(1, keepdims=True), -MOST)
        has_letter = np.logical_or.reduceat(letter[codes[at]], firsts)
        return np.where(has_letter[:, None], np.maximum(score, -MOST), 0).astype("f4"), has_letter, counts


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among sorted keys, or their number."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


class Labeller:
    """Labels the words of texts."""

    def __init__(self, model: LanguageModel):
        self.model = model

    def labels(self, found: list[str]) -> np.ndarray | None:
        """The language's place for each word by the best path, or None if no word has a letter."""
        scores, letters, _ = self.model.word_scores(" ".join(found))
        return best_path(scores) if letters.any() and self.model.languages else None

    def label_texts(self, texts: pa.Array) -> Iterator[np.ndarray | None]:
        """The same for each text; a distinct run between blanks is scored once for all texts."""
        words = wordhash.split(texts, fold_case=False)
        if not len(words.hashes) or not self.model.languages:
            yield from (None for _ in range(len(texts)))
            return
        _, first, kind = np.unique(words.hashes, return_index=True, return_inverse=True)
        data, ends = words.data.tobytes(), words.ends[first].tolist()
        scores, letters, counts = self.model.word_scores(b" ".join([data[a:b] for a, b in zip(words.starts[first].tolist(), ends, strict=True)]).decode("utf-8", "replace"))
        begin = np.cumsum(counts) - counts
        own = counts[kind]
        after = np.concatenate(([0], np.cumsum(own)))
        rows = np.repeat(begin[kind] - after[:-1], own) + np.arange(after[-1])
        bounds = after[words.first].tolist()
        spoken = np.concatenate(([0], np.cumsum(letters[rows])))[bounds]
        some = np.flatnonzero(spoken[1:] > spoken[:-1]).tolist()
        paths = dict(zip(some, best_paths([scores[rows[bounds[i] : bounds[i + 1]]] for i in some]), strict=True))
        yield from map(paths.get, range(len(texts)))


def one_language(scores: np.ndarray, switch: float) -> int | None:
    """The language of the whole path, if one is the answer: no stretch gains more than half a switch in another. Then k
    stretches in others gain less than the k - 1 or more changes they cost."""
    best = int(scores.sum(0, dtype="f8").argmax())
    run = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype="f8")
    low = np.minimum.accumulate(run, axis=0)
    low[1:] = np.minimum(low[:-1], 0)
    low[0] = 0
    return best if (run - low).max() <= switch / 2 else None


def best_paths(texts: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """For each text (scores, a row for each word) the labels that maximise the sum of scores less switch for each change;
    ties go to the earlier language. Dynamic programming takes a step of all texts at a time."""
    out: list = [None] * len(texts)
    hard = []
    for i, scores in enumerate(texts):
        if (whole := one_language(scores, switch)) is None:
            hard.append(i)
        else:
            out[i] = np.full(len(scores), whole)
    if not hard:
        return out
    hard.sort(key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in hard])
    first = np.cumsum(sizes) - sizes
    scores = np.concatenate([texts[i] for i in hard]).astype("f8")
    came, own = np.empty(scores.shape, np.int16), np.arange(scores.shape[1])
    value = scores[first]
    # Texts still under way at each step, the longest first.
    active = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), "left")
    for t in range(1, sizes[0]):
        m = active[t]
        at, now = first[:m] + t, value[:m]
        top = now.argmax(1)
        changed = now[np.arange(m), top][:, None] - switch
        came[at] = np.where(now >= changed, own, top[:, None])
        value[:m] = np.maximum(now, changed) + scores[at]
    path = np.empty(len(scores), np.int64)
    path[first + sizes - 1] = value.argmax(1)
    for t in range(sizes[0] - 1, 0, -1):
        at = first[: active[t]] + t
        path[at - 1] = came[at, path[at]]
    for i, a, n in zip(hard, first, sizes, strict=True):
        out[i] = path[a : a + n]
    return out


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """best_paths of one text."""
    return best_paths([scores], switch)[0]


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fits on docs (doc_id, lang, text) with a language and a text: about train_docs of each language, by a hash of the id.

    Letter trigrams are counted by Spark; what reaches the driver is one row for each language and trigram."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").count().collect()
    steps = 1 << 20
    share = F.lit(0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], int(min(1.0, train_docs / row["count"]) * steps)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(steps)) < share)
    found = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    padded = F.concat(F.lit("^^"), F.col("word"), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    counts = found.select("lang", "count", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("count").alias("n"))
    return LanguageModel([(r["lang"], r["gram"], r["n"]) for r in counts.collect()])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and spans (array of struct start, end, lang; offsets in characters of the text).

    lang_pred is the language of most words on the best path and score their share; und, 0 and no spans for null texts,
    texts without a letter, and models without languages. Repeated rows are labelled alike; columns of docs with the
    names of the results are replaced. No shuffle; one Arrow batch is in memory at a time, and a very long text is labelled whole."""
    rows = docs.drop("lang_pred", "score", "spans")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = rows.columns.index(text)
    added = StructType.fromDDL("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    schema = StructType([*rows.schema.fields, *added.fields])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, names = Labeller(sent.value), sent.value.languages
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in (part for whole in batches for part in wordhash.slices(whole, place, SLICE)):
            preds, scores, spans = [], [], []
            for value, path in zip(batch.column(place), labeller.label_texts(batch.column(place)), strict=True):
                whole = value.as_py() or ""
                if path is None:
                    preds.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                votes = np.bincount(path, minlength=len(names))
                top = int(votes.argmax())
                preds.append(names[top])
                scores.append(float(votes[top] / len(path)))
                turns = np.flatnonzero(np.diff(path)) + 1
                starts = [0]
                if len(turns):
                    places = [m.start() for m in WORD_RE.finditer(whole)]
                    starts += [places[t] for t in turns]
                ends = [*starts[1:], len(whole)]
                labels = path[np.concatenate([[0], turns]).astype(np.int64)]
                spans.append([{"start": s, "end": e, "lang": names[x]} for s, e, x in zip(starts, ends, labels, strict=True)])
            columns = [*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kinds)]
            yield pa.record_batch(columns, [f.name for f in schema.fields])

    return rows.mapInArrow(label, schema)


def predict_languages(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans: a model of the documents outside the fold, applied to all."""
    held = is_fold(F.col("doc_id"), folds, fold)
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
