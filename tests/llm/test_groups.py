"""Near copies, neighbours, language-model scores and the pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from reqsift.llm import graph, mixing, near


def shingles(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}


def groups(rows, size, percent):
    """Components of all rows by comparing all pairs; null ids last."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(root(i)), doc_id) if x is not None]
        least[root(i)] = min(ids, default=None)
    return sorted(((doc_id, len(sets[i]), least[root(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)), key=str)


def copies(rng, n, edits):
    """Texts and copies of copies with a few words changed."""
    out = []
    while len(out) < n:
        ws = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 120))]
        out.append(" ".join(ws))
        for _ in range(rng.randint(0, 6)):
            ws = list(ws) if rng.random() < 0.5 else out[-1].split()
            for _ in range(rng.randint(0, edits)):
                ws[rng.randrange(len(ws))] = f"v{rng.randint(0, 5000)}"
            out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("size,percent,leaf", [(3, 85, 256), (5, 80, 256), (3, 85, 4)])
def test_components_equal_brute_force(spark, docs, monkeypatch, size, percent, leaf):
    monkeypatch.setattr(near, "LEAF", leaf)
    rng = random.Random(size + leaf)
    texts = copies(rng, 150, 3)
    base = [f"b{k}" for k in range(100)]
    for _ in range(60):  # all near the base, not all near each other
        ws = list(base)
        for _ in range(3):
            ws[rng.randrange(100)] = f"v{rng.randint(0, 5000)}"
        texts.append(" ".join(ws))
    texts += [" ".join(base), "", None, "one", "ONE", "one two", "one two three", "\x0b", "x " * 40_000, texts[0], texts[0].upper()]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts)) + [(None, texts[3]), (None, "alone here"), (ids[5], texts[5]), (ids[6], "same id other text")]
    got = near.components(docs(rows), words=size, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == groups(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_leaves_of_unlike_texts_lose_no_link(spark, docs, monkeypatch):
    monkeypatch.setattr(near, "LEAF", 16)
    rng = random.Random(51)
    template = [f"t{k}" for k in range(300)]
    texts = []
    for _ in range(300):  # pairs a little above the threshold, on a template that links no two of them
        ws = template + [f"u{rng.randint(0, 10**7)}" for _ in range(120)]
        texts += [" ".join(ws), " ".join(ws[:400] + [f"v{rng.randint(0, 10**7)}" for _ in range(33)])]
    rows = list(enumerate(texts))
    got = near.components(docs(rows), words=3, percent=85).collect()
    want = groups(rows, 3, 85)
    assert len({c for _, _, c in want}) == 300
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_no_documents(spark, docs):
    assert near.components(docs([])).count() == 0


def test_blocks_of_large_leaves_meet_every_pair(spark):
    rows = spark.range(500).select(
        F.lit(7).cast("long").alias("node"), F.col("id").alias("cid"), F.lit(500).cast("long").alias("size")
    )
    cut = near._all_blocks(rows).groupBy("node").agg(F.collect_list("cid").alias("cids")).collect()
    assert max(len(r.cids) for r in cut) <= 2 * near.LEAF
    met = {(a, b) for r in cut for a in r.cids for b in r.cids if a < b}
    assert len(met) == 500 * 499 // 2


# -- neighbours ------------------------------------------------------------------------


def nearest_by_all(vectors, k):
    out = {}
    for q, v in vectors.items():
        score = {i: float(np.dot(v, w)) for i, w in vectors.items() if i != q}
        out[q] = sorted(score, key=lambda i: (-score[i], i))[:k]
    return out


def test_neighbours_are_found(spark, table):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = {i: (centres[i % 12] + rng.normal(size=16) * 0.7).astype(np.float32) * rng.uniform(0.5, 2) for i in range(900)}
    data = table([(i, v.tolist(), 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in graph.nearest(data, data.filter("vec_id % 3 = 0"), k=10, shard=300, block=120).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(vectors[r.query_id].astype(float), vectors[r.vec_id].astype(float))), abs=1e-12)
        assert r["rank"] == len(got[r.query_id])
    want = nearest_by_all({i: v.astype(float) for i, v in vectors.items()}, 10)
    assert sorted(got) == sorted(i for i in vectors if i % 3 == 0)
    assert np.mean([len({*got[q]} & {*want[q]}) / 10 for q in got]) > 0.95


def test_odd_vectors(spark, table):
    inf, nan = float("inf"), float("nan")
    rows = [(n, [1.0, 0.0]) for n in range(50)]  # one vector, many ids: ties by id
    rows += [(100, None), (101, [0.0, 0.0]), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, [None, 1.0]), (105, [1.0]), (None, [3.0, 3.0])]
    rows += [(200, [0.0, 2.0]), (200, [0.0, 2.0])]
    data = table(rows, "vec_id long, embedding array<float>")
    got = graph.nearest(data, data.filter("vec_id in (0, 7, 100, 200)"), k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [
        *[(0, i) for i in (1, 2, 3, 4, 5)], *[(7, i) for i in (0, 1, 2, 3, 4)], *[(200, i) for i in (0, 1, 2, 3, 4)]
    ]
    few = table([(20, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in graph.nearest(few, few.filter("vec_id = 20")).collect()] == [(20, 1, 1.5)]
    none = table([], "vec_id long, embedding array<float>")
    assert graph.nearest(none, none).count() == 0


# -- scores ----------------------------------------------------------------------------


def base_scores(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    count = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    return sorted(
        (
            str(i), held(i), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n,
            round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6),
        )
        for i, t in rows
    )


def test_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "FREQUENT", 0.01)
    rng = random.Random(21)
    words = ["".join(rng.choices("kalomisu", k=rng.randint(2, 9))) for _ in range(400)]
    rows = [(n, " ".join(rng.choices(words[: 200 if n % 2 else 400], k=rng.randint(1, 60))), "aa" if n % 2 else "bb") for n in range(200)]
    rows += [(900, None), (901, ""), (None, "Kala SU"), (902, "été" * 3000), (903, rows[3][1]), (3, rows[3][1], "aa")]
    got = mixing.scores(docs(rows)).collect()
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert have == base_scores([r[:2] for r in rows])
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len({round(r.score, 9) for r in got if r.doc_id in (3, 903)}) == 1


def test_long_unseen_words_cost_every_byte(spark, docs):
    rng = random.Random(23)
    held = [i for i in range(10_000, 10_200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    sizes = dict(zip(held, (100, 400, 1600, 9000)))
    rows = [(n, " ".join(rng.choices(["kalo", "misu", "loka"], k=30)), "aa") for n in range(60)]
    rows += [(i, "".join(rng.choices("0123456789abcdef", k=n)), "aa") for i, n in sizes.items()]
    got = {r.doc_id: r for r in mixing.scores(docs(rows)).collect()}
    for i, n in sizes.items():
        # Sixteen letters at random hold four bits each, and no model can know better.
        assert got[i].held_out and -got[i].score / math.log10(2) > 4 * n
        assert got[i].bits_per_byte > 3.9
    # The sum is exact where the spelling is far below what a double can hold.
    assert mixing._log10_sum(np.asarray([0.0, 1e-3, 0.25]), np.asarray([-9000.0, -9000.0, math.log10(0.25)])) == pytest.approx(
        [-9000.0, -3.0, math.log10(0.5)]
    )


def test_spelling_is_a_distribution(spark, table):
    vocabulary = table([("ab", 3), ("abc", 1), ("b", 7)], "word string, c long")
    model = mixing.train(vocabulary)
    for prefix in ("", "a", "ab"):
        total = 0.0
        spelled = mixing.Spelling([prefix + "x"])
        at = len(prefix)
        (word, slots, bits, gates, last) = next(spelled.slices())
        # The eight bits of the byte after the prefix: every path through them sums to one.
        for byte in range(256):
            raw = prefix.encode() + bytes([byte])
            own = mixing.Spelling.__new__(mixing.Spelling)
            own.__dict__.update(spelled.__dict__)
            own.bytes = np.frombuffer(raw + b" ", np.uint8)
            _, slots, bits, gates, last = next(own.slices())
            p = model.probability(model.mixed(model.inputs(slots), gates), last)
            total += np.prod(np.where(bits == 1, p, 1 - p)[at])
        assert total == pytest.approx(1.0, abs=1e-9)


def test_mixer_learns_from_every_word_however_it_is_cut(spark, table, monkeypatch):
    rng = random.Random(29)
    words = sorted({"".join(rng.choices("kalomisu", k=rng.randint(2, 9))) for _ in range(300)})
    learnt = {}
    for last in ("tilo", "q" * 300):
        for partitions in (1, 5):
            vocabulary = table([(w, 1 + len(w)) for w in [*words, last]], "word string, c long").repartition(partitions)
            learnt[last, partitions] = mixing.train(vocabulary, 50)
    for last in ("tilo", "q" * 300):
        assert np.allclose(learnt[last, 1].weights, learnt[last, 5].weights, atol=1e-4)
        assert np.allclose(learnt[last, 1].refined, learnt[last, 5].refined, atol=1e-4)
    # A word counts, however long it is; refinement is by the last byte plus one.
    small = mixing.train(table([(w, 1) for w in words], "word string, c long"), 50)
    long = mixing.train(table([(w, 1) for w in [*words, "q" * 300]], "word string, c long"), 50)
    assert (long.refined != small.refined)[ord("q") + 1].any()


def test_no_texts_to_score(spark, docs):
    assert mixing.scores(docs([])).count() == 0


# -- pipeline --------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, docs, tmp_path):
    import hashlib

    from test_texts import SYLLABLES, prose, without_repeats

    from reqsift.llm import secrets

    rng = random.Random(33)
    rows = []
    for n in range(120):
        lang = list(SYLLABLES)[n % 3]
        rows.append((n, "\n".join(prose(rng, lang, 12) for _ in range(5)), lang))
    key = hashlib.sha256(b"x").hexdigest()
    rows += [
        (200, "### 12 34", "aa"), (201, None, "bb"), (202, rows[1][1] + " end", "bb"), (203, rows[4][1], "bb"),
        (204, rows[7][1].replace("\n", " "), "bb"), (205, rows[7][1].replace("\n", " ") + " more", "bb"),
        (206, prose(rng, "aa", 30) + f'\ntoken = "{key}"\n' + prose(rng, "aa", 30), "aa"),
    ]
    data = docs(rows)
    path = str(tmp_path / "documents.parquet")
    data.write.parquet(path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "repeated lines", "near copies", "secrets", "packing"]

    kept = [(i, t) for i, t, _ in rows if i not in (200, 201)]
    now = stages["language"](spark, spark.read.parquet(path), str(tmp_path))
    assert now.columns == data.columns and {r.doc_id for r in now.collect()} == {i for i, _ in kept}
    after = {i: t for i, t in without_repeats(kept).items() if t or not dict(kept)[i]}
    now = stages["repeated lines"](spark, now, str(tmp_path))
    assert {r.doc_id: (r.text, r.n_chars) for r in now.collect()} == {i: (t, len(t)) for i, t in after.items()}
    assert 203 not in after
    first = {i for i, _, c in groups(list(after.items()), 5, 80) if i == c}
    now = stages["near copies"](spark, now, str(tmp_path))
    assert {r.doc_id for r in now.collect()} == first and 205 not in first and now.columns == data.columns
    now = stages["secrets"](spark, now, str(tmp_path))
    clean = {r.doc_id: r.text for r in now.collect()}
    assert set(clean) == first and key not in clean[206] and "[SECRET]" in clean[206]
    assert all(clean[i] == after[i] for i in first if not secrets.base_spans(after[i]))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == first


def test_documents_without_languages_are_kept(spark, docs):
    rows = [(1, "kala su", None), (2, "### 12", None), (3, None, None), (4, "été", None)]
    kept = corpus_pipeline.known_language(spark, docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_sketches_never_rule_out_similar_sets():
    rng = random.Random(41)
    shingler = near.Shingler(3)
    similar = ruled_out = 0
    for _ in range(1500):
        ws = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([5, 20, 60, 150, 500, 1500]))]
        other = list(ws)
        for _ in range(max(1, int(len(ws) * rng.choice([0.01, 0.02, 0.03, 0.1])))):
            other[rng.randrange(len(ws))] = f"v{rng.randint(0, 10**6)}"
        a, b = shingler.shingles(" ".join(ws)), shingler.shingles(" ".join(other))
        both = len(np.intersect1d(a, b))
        index = both / (len(a) + len(b) - both)
        (open_,) = near.may_be_similar(near.sketch(a), len(a), near.sketch(b)[None], np.asarray([len(b)]), 0.85)
        if index >= 0.85:
            similar += 1
            assert open_
        elif index < 0.7:
            ruled_out += not open_
    assert similar > 200 and ruled_out > 100
