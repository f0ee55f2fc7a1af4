"""Removal of repeated passages beside a plain version."""

import random
from collections import Counter

import pytest

from reqsift.llm import suffixes


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    often = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if often[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, i = [], 0
        while i < len(r):
            j = i
            while j < len(r) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j))
            i = j
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def made(seed, count, length):
    rng = random.Random(seed)
    words = ["sun", "moon", "ä", "of", "the", "stars", "q" * 70, "\n", "and\tthen"]
    passages = [" ".join(rng.choices(words, k=rng.randint(3, 25))) for _ in range(6)]
    texts = [None, "", "a", "x" * (3 * length), "x" * length, "ab" * length, " " * (2 * length)]
    for _ in range(count):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words, k=8)) for _ in range(3)]
        text = " ".join(parts)
        texts.append(text[rng.randint(0, 9) :])
    return texts + texts[-5:] + texts[3:4]


@pytest.mark.parametrize("seed,length,runs", [(1, 200, 1000), (3, 60, 2), (4, 9, 1000), (5, 25, 1)])
def test_equals_a_plain_version(docs, monkeypatch, seed, length, runs):
    monkeypatch.setattr(suffixes, "RUNS", runs)
    texts = made(seed, 60, length)
    got = suffixes.remove_repeats(docs(list(enumerate(texts))), length).orderBy("doc_id").collect()
    want = plain(texts, length)
    assert [r.doc_id for r in got] == list(range(len(texts)))
    assert [(r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got] == want
    assert any(spans for _, spans, _ in want)


def test_a_longer_gram_settles_what_is_crowded(docs, monkeypatch):
    """Very many texts around one phrase, few of which share more."""
    monkeypatch.setattr(suffixes, "RUNS", 5)
    rng = random.Random(9)
    phrase = "the very same words that all of these texts have in their middle, so "
    words = lambda n: " ".join(rng.choices("abcdefghij", k=n))
    texts = [f"{words(40)} {phrase} {words(40)}" for _ in range(30)]
    texts += [t[20:] + " more" for t in texts[:4]]
    got = suffixes.remove_repeats(docs(list(enumerate(texts))), 100).orderBy("doc_id").collect()
    want = plain(texts, 100)
    assert [(r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got] == want
    assert sum(bool(spans) for _, spans, _ in want) == 8


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(1500):
        symbols = [rng.randint(0, rng.choice((1, 2, 5))) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.2:
            symbols = symbols[:3] * 9
        assert suffixes.suffix_order(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_odd_rows(table):
    schema = "doc_id long, text string, kept string, bytes binary, gram long, c1 long"
    long = "one two three " * 40
    rows = [(None, long, "a", None, 1, 1), (7, "z" * 100 + long, "b", None, 1, 1), (7, "short", None, None, 1, 1)]
    got = suffixes.remove_repeats(table(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in got) == [
        (0, len(long), 0), (7, 5, 5), (7, 100 + len(long), 100),
    ]
    assert suffixes.remove_repeats(table([], schema)).collect() == []
