"""Alignment of two tokenizers against the libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sieveworks.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("abcdeé  \n\t▁thingTHE's0123<>|/漢字😀́\r\x00ñ\x1c\x85\xa0　Σς")
SPECIAL = ["<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", " a  b ", "  x", "!\x1c ok"]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    facts, held = [], Counter()
    for doc_id, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text or "")
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = f" {text}".encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            facts.append((doc_id, 0, 0, 0, {}, ""))
            continue
        ends = [set(), set()]
        for side, parts in enumerate((bytes_a, bytes_b)):
            at = 0
            for p in parts:
                at += len(p)
                ends[side].add(at)
        common, groups = sorted(ends[0] & ends[1]), []
        for side, (ids, parts) in enumerate(((a, bytes_a), (b, bytes_b))):
            at, k, cut = 0, 0, [[] for _ in common]
            for i, p in zip(ids, parts):
                at += len(p)
                cut[k].append(i)
                k += at == common[k]
            groups.append(cut)
        links = Counter((x, y) for left, right in zip(*groups) for x in left for y in right)
        digest = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in zip(*groups))
        held.update(links.keys())
        facts.append((doc_id, len(a), len(b), len(common), links, hashlib.sha256(digest.encode()).hexdigest()))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(((i, a, b, g, sum(k.values()), sum(n for p, n in k.items() if held[p] == most[p[0]]), sum(held[p] * n for p, n in k.items()), d) for i, a, b, g, k, d in facts), key=str)


def texts(n):
    rng = random.Random(3)
    return ["", " ", "the", "  two  spaces ", None, "▁", "word " * 3000, "x" * 5000, "9" * 400] + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) + rng.choice(["", "", *SPECIAL]) for _ in range(n)]


@pytest.mark.parametrize(("slice_bytes", "wide", "entries"), [(4 << 20, 64, 10_000_000), (300, 1, 40)])
def test_alignment_equals_the_libraries_on_whole_texts(spark, monkeypatch, slice_bytes, wide, entries):
    monkeypatch.setattr(alignment, "SLICE", slice_bytes)
    monkeypatch.setattr(alignment, "WIDE_GROUP", wide)
    monkeypatch.setattr(alignment, "PART_ENTRIES", entries)
    monkeypatch.setattr(alignment, "HELD", entries)
    rows = list(enumerate(texts(400))) + [(None, "no id"), (7, "repeated row"), (7, "repeated row")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, row long, a int, body string").repartition(3)
    got = alignment.align_tokenizers(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@pytest.mark.parametrize("wide", [64, 1])
def test_links_of_groups(monkeypatch, wide):
    monkeypatch.setattr(alignment, "WIDE_GROUP", wide)
    # One unit of a group of 3 x 2, one of 1 x 1 twice and 1 x 2.
    a, b = np.array([5, 5, 5, 5, 5, 6]), np.array([0, 1, 7, 7, 8, 8])
    pairs, times, first = alignment._links(a, b, np.array([0, 3, 4, 5, 6]), np.array([0, 2, 3, 4, 6]), np.array([0, 2, 2, 2]), 3)
    got = [{(p >> 32, p & 0xFFFF): t for p, t in zip(pairs[s:e].tolist(), times[s:e].tolist())} for s, e in zip(first, first[1:])]
    assert got == [{(5, 0): 3, (5, 1): 3}, {}, {(5, 7): 2, (6, 8): 2}]


def test_documents_give_rows_by_groups_not_by_tasks(spark, monkeypatch):
    """The rows that documents give are as many for other numbers of tasks."""
    counts, own = [], alignment._contributions

    def counted(streams):
        out = own(streams)
        counts.append((out.count(), streams.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(alignment, "_contributions", counted)
    docs = spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 80), x -> concat('w', string((id * x) % 97), 'x'))) AS text")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            assert alignment.align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert counts[0] == counts[1] and counts[0][0] <= 60 * alignment.GROUPS
