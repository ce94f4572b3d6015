"""The parts of the llm operators that run inside tasks, against brute force."""

import random
import subprocess
import sys
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sieveworks.llm import decontam, jaccard, langid, lm, sstable, subwords, tokencount, toxicity, wordhash
from sieveworks.llm.text import WORD_RE

random.seed(5)
ALPHABET = list("abcdeé  \n\t▁thingTHE's0123<>|/漢字😀́\r\x00ñ\x1c\x85\xa0Σς")


def texts(n, longest=60):
    special = ["<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "a <|startoftext|> b", "▁▁the"]
    return ["", " ", "the"] + ["".join(random.choices(ALPHABET, k=random.randint(0, longest))) + random.choice(["", "", *special]) for _ in range(n)]


def test_token_counts_equal_the_library():
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library, count = sentencepiece.SentencePieceProcessor(model_file=model), tokencount.piece_counter(model)
    for t in texts(3000):
        assert count(t) == len(library.encode(t)), repr(t)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_chunk_maps_compose(monkeypatch, size):
    monkeypatch.setattr(tokencount, "CHUNK", size)
    count = tokencount.piece_counter(public_tokenizers.path("piece_bpe_32k.model"))
    for t in texts(300):
        assert count(t) == count.segments(tokencount.MARK + t.replace(" ", tokencount.MARK)) or not t


def test_transducer_survives_emptying(monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT_STATES", 5)
    monkeypatch.setattr(tokencount, "KEPT_SEGMENTS", 3)
    monkeypatch.setattr(tokencount, "KEPT_PAIRS", 3)
    count = tokencount.piece_counter(public_tokenizers.path("piece_bpe_32k.model"))
    fresh = tokencount.Counter(count.machine.scores)
    for t in texts(60):
        assert fresh(t) == count(t)


def test_shard_round_trip_and_lookup():
    values = {i: np.array(random.choices(range(50000), k=random.randint(0, 4000)), "<u2").tobytes() for i in random.sample(range(-(10**12), 10**12), 300)}
    entries = sorted((sstable.key_of(i), v) for i, v in [*values.items(), (None, b"\1\0")])
    entries.insert(3, entries[2])  # a repeated key
    shard = sstable.Shard(b"".join(r + sstable.END for r in sstable.build_shard(entries, 2)))
    assert list(shard) == entries
    assert shard.documents == len(entries) and len(shard.blocks) > 3
    for key, value in entries:
        assert value in shard.get(key)
    assert shard.get(sstable.key_of(10**15)) == []
    assert sum(shard.may_have(sstable.key_of(10**13 + i)) for i in range(2000)) < 60
    empty = sstable.Shard(b"".join(r + sstable.END for r in sstable.build_shard([], 2)))
    assert list(empty) == [] and empty.get(sstable.key_of(1)) == []


@pytest.mark.parametrize("kept", [10**6, 50])
def test_encoder_equals_the_library(monkeypatch, kept):
    monkeypatch.setattr(subwords, "KEPT_WORDS", kept)
    memory = subwords.WordMemory(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    every = [*texts(1500), None, "x<|endoftext|>Y's ΣΑΣ Éa'LL I\u0307 e\u0301 ½x² \x7f", "a \x01 b\x01c", "\x01", "", "w" * 700_000, "the end " * 90_000]
    for at in range(0, len(every), 200):
        part = every[at : at + 200]
        ids, ends, words = memory(pa.array(part))
        bounds = ends[words.first]
        for i, t in enumerate(part):
            want = memory.tokenizer.encode(t or "", add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want, repr(t)[:200]


def test_words_equal_the_expression():
    for t in [texts(800), [None, "", " \t", "A", "b" * (3 << 18), "c " * (3 << 17)]]:
        found = wordhash.split(pa.array(t, pa.string()))
        for i, x in enumerate(t):
            own = range(found.first[i], found.first[i + 1])
            assert [found.word(k).decode() for k in own] == WORD_RE.findall(x or "")
        low = {}
        for i in range(len(found.hashes)):
            assert low.setdefault(int(found.hashes[i]), found.word(i).lower()) == found.word(i).lower()
        assert len(low) == len({found.word(i).lower() for i in range(len(found.hashes))})


def test_linked_sets_share_a_token_that_neither_spares():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        for _ in range(1500):
            n = int(rng.choice([3, 4, 5, 7, 9, 11, 14, 20, 33, 60, 150, 400]))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            keep = rng.random(len(a)) < rng.choice([0.8, 0.9, 0.95, 1])
            b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)]))
            if not jaccard.links(a, b, percent) or np.array_equal(a, b):
                continue
            kept = []
            for s in (a, b):
                found, spare = jaccard.tokens(s, percent)
                for kind in range(jaccard.KINDS):  # any one order of all tokens will do
                    own = sorted(t for t in found.tolist() if t % jaccard.KINDS == kind)
                    kept.append((s is a, set(own[: len(own) - spare[kind]])))
            left = set().union(*(k for side, k in kept if side))
            assert left & set().union(*(k for side, k in kept if not side)), (percent, n)


def brute_path(scores, switch):
    n, k = scores.shape
    best = None
    for code in range(k**n):
        path = [code // k**i % k for i in range(n)]
        value = sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))
        best = value if best is None else max(best, value)
    return best


def test_best_path_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-4, 1, (rng.integers(1, 7), 3)).astype("f4")
        path = langid.best_path(scores, 2.0)
        value = scores[np.arange(len(path)), path].sum() - 2.0 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(brute_path(scores, 2.0))


def test_scripts_narrow_candidates():
    counts = [("en", g, 5) for g in ("^^t", "^th", "the", "he$")] + [("ru", g, 5) for g in ("^^д", "^да", "да$")]
    model = langid.LanguageModel(counts)
    labeller = langid.Labeller(model)
    assert model.languages == ["en", "ru"]
    assert list(labeller.labels(["the"] * 9 + ["да"] * 9)) == [0] * 9 + [1] * 9
    assert labeller.labels(["½"]) is None and labeller.labels([]) is None


def test_bitmaps_bound_the_difference_from_below():
    rng = np.random.default_rng(2)
    for _ in range(100):
        base = rng.integers(0, 2**63, rng.integers(2, 900), dtype=np.uint64)
        a, b = np.unique(base[: rng.integers(1, len(base))]), np.unique(base[rng.integers(0, len(base) - 1) :])
        width = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b)))
        x, y = (jaccard.fold(jaccard.bitmap(s)[None, :], width) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_attention_is_causal_and_gradients_are_right(monkeypatch):
    vocabulary = lm.Vocabulary(300, {i: 300 - i for i in range(200)})
    model = lm.AttentionModel(vocabulary.row_class, lm.SINGLE + lm.TAILS)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 200, (2, 10))
    h, _ = model.forward(x)
    y = x.copy()
    y[:, 6:] = 7
    assert np.allclose(h.reshape(2, 10, -1)[:, :6], model.forward(y)[0].reshape(2, 10, -1)[:, :6], atol=1e-5)
    target, weight = rng.integers(0, lm.SINGLE + lm.TAILS, 20), np.full(20, 1 / 20, np.float32)

    def loss():
        h2, kept = model.forward(x)
        p = lm.softmax(model.logits(h2, x.reshape(-1)))
        return -(np.log(p[np.arange(20), target]) * weight).sum(), p, kept

    value, p, kept = loss()
    grads = model.gradients(p, kept, target, weight)
    for name in ("qkv", "mixed", "up", "down", "out", "place"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        model.p[name][at] += 1e-2
        up = loss()[0]
        model.p[name][at] -= 2e-2
        down = loss()[0]
        model.p[name][at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(grads[name][at], rel=0.05)


def test_each_token_is_scored_once():
    vocabulary = lm.Vocabulary(300, {1: 5})
    scorer = lm.Scorer(vocabulary, lm.AttentionModel(vocabulary.row_class, lm.SINGLE + lm.TAILS))
    sizes = [1, 2, lm.WINDOW - 1, lm.WINDOW, lm.WINDOW + 1, 200, 1, 777]
    first = np.concatenate(([0], np.cumsum(sizes)))
    symbols = np.random.default_rng(1).integers(0, 300, first[-1]).astype(np.int32)
    together = scorer(symbols, first)
    assert (together < 0).all()
    alone = [scorer(symbols[a:b], np.array([0, b - a])) for a, b in zip(first, first[1:])]
    assert np.allclose(np.concatenate(alone), together, atol=1e-4)
    assert abs(np.bincount(vocabulary.classes, np.exp(vocabulary.within), lm.SINGLE + lm.TAILS)[: vocabulary.classes.max() + 1] - 1).max() < 1e-3


def test_symbols_tell_words_apart():
    encode = subwords.WordMemory(public_tokenizers.path("word_bpe_49k.json"), "<i4")
    size = encode.tokenizer.get_vocab_size()
    symbols, begin, first, words = lm.symbols_of(encode, pa.array(["a b", "ab", None, "\u00a0 The thingness", ""]))
    ids = lambda t: encode.tokenizer.encode(t, add_special_tokens=False).ids
    word = lambda t: [*(2 * i for i in ids(t)[:-1]), 2 * ids(t)[-1] + 1]
    end = 2 * size + 1
    want = [[*word("a"), *word("b"), end], [*word("ab"), end], [end], [2 * size, *word("the"), *word("thingness"), end], [end]]
    assert [symbols[a:b].tolist() for a, b in zip(first, first[1:])] == want
    assert begin.tolist()[:3] == [0, 1, 3] and len(begin) == len(words.hashes) == 6


def test_chain_uses_earlier_links():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        low, tox = rng.random() < 0.4, rng.random() < 0.3
        found = {f"w{rng.randint(0, 50)}" for _ in range(10)} | ({"%%%"} if low else set()) | ({"badword"} if tox else set())
        rows.append((i % 5, found, (int(low), int(tox))))
    chain = toxicity.fit_chain(rows, ["low", "tox"])
    right = sum((chain(f)[1] >= 0.5) == bool(t) for _, f, (_, t) in rows)
    assert right == len(rows) and len(chain.links[1][1]) == 1
    assert toxicity.fit_chain([], ["low"])(set()) == [0.5]
    assert toxicity.fit_chain(rows[:1], ["low", "tox"]) is not None


def test_folds_follow_crc32():
    assert [zlib.crc32(str(i).encode()) % 5 for i in range(3)] == [zlib.crc32(b"0") % 5, zlib.crc32(b"1") % 5, zlib.crc32(b"2") % 5]


@pytest.mark.parametrize("n", range(12, 30))
def test_masks_find_every_stretch_with_one_token_of_five_changed(n):
    """Longer stretches consist of pieces of 15 to 29 tokens, of which one has no larger share of changes."""
    places = np.array(list(combinations(range(n), min(n // 5, n - 12))), np.int64)
    same = (1 << n) - 1 - (1 << places).sum(1, dtype=np.int64)
    found = np.zeros(len(same), bool)
    for mask in decontam.MASKS:
        for at in range(n - len(mask) + 1):
            own = sum(1 << (at + i) for i, m in enumerate(mask) if m == "1")
            found |= same & own == own
    assert found.all()


def test_out_of_fold_probabilities_know_nothing_of_their_own_labels():
    # Each document has a feature of its own and labels are drawn: whatever a fold is told, its own labels do not help.
    rng = random.Random(6)
    found = [{f"own{i}", f"shared{i % 7}", *(f"noise{rng.randrange(200)}" for _ in range(10))} for i in range(400)]
    y, folds = np.array([float(rng.random() < 0.5) for _ in found]), np.array([i % toxicity.FOLDS for i in range(400)])
    before = toxicity._outside(found, y, folds, np.zeros((400, 0)))
    other = y.copy()
    other[folds == 1] = 1 - other[folds == 1]
    after = toxicity._outside(found, other, folds, np.zeros((400, 0)))
    assert (before[folds == 1] == after[folds == 1]).all() and (before[folds == 0] != after[folds == 0]).any()
    assert abs(np.corrcoef(before, y)[0, 1]) < 0.2


def test_words_met_again_stay_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(subwords, "KEPT_WORDS", 40)
    memory, asked = subwords.WordMemory(public_tokenizers.path("word_bpe_49k.json"), "<u2"), []
    library = memory.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    memory.tokenizer = Counting()
    for i in range(30):
        text = "often met, " + " ".join(f"new{i}x{j}" for j in range(15))
        ids, ends, _ = memory(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and ends[-1] == len(ids)
        assert len(memory.keys) <= 40 + 17
    assert asked.count("often") == asked.count("met,") == 1 and len(asked) == 2 + 30 * 15


def test_free_memory_of_batches_is_given_back():
    """In a process of its own, as memory that others left free would count."""
    code = """
import pyarrow as pa
from sieveworks.llm import wordhash
from pathlib import Path

def used():
    return int(Path("/proc/self/status").read_text().split("RssAnon:")[1].split()[0]) / 1024

before, kept = used(), []
for i in range(3):
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, pa.schema([("text", pa.string())])) as to:
            for _ in range(2):
                to.write_batch(pa.record_batch([pa.array(["word and more " * 300] * 10_000)], ["text"]))
        data = out.getvalue()
    for batch in pa.ipc.open_stream(pa.BufferReader(data).read_buffer()):
        parts = sum(p.num_rows for p in wordhash.slices(batch, 0))
        assert parts == batch.num_rows
    del data, out, to, batch
    for _ in wordhash.slices(pa.record_batch([pa.array(["a"])], ["text"]), 0):
        pass
print(used() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(out.stdout) < 40
