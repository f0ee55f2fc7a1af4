"""Language, secrets, lines, licences and quality on small tables."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqsift.llm import language, licences, lines, quality, secrets

SYLLABLES = {"aa": "ka lo mi ne su".split(), "bb": "tra glo pfe schi wun".split(), "cc": "éa ou èi lle ntre".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_held_out_languages_are_found(spark, docs):
    rng = random.Random(1)
    rows = [(n, prose(rng, lang, rng.randint(5, 80)), lang) for n, lang in enumerate(list(SYLLABLES) * 60)]
    model = language.fit(docs(rows[:120]), sample=90, landmarks=30)
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 ### 7", "bb"), (None, prose(rng, "bb", 9), None), (903, "ka " * 90_000, "aa")]
    guess = docs(rows[120:] + odd).select("doc_id", "lang", language.predicted(F.col("text"), model).alias("g"))
    got = guess.select("doc_id", "lang", "g.*").collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[k] for k in (900, 901, 902, None, 903)] == ["und", "und", "und", "bb", "aa"]
    rest = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang == r.lang_pred for r in rest) >= 0.98 * len(rest)


def test_kernel_is_the_normalised_count_of_common_grams(spark):
    texts = ["kalomi", "tragl kalo", "x"]
    seen = np.stack([language.presence(t) for t in texts])
    model = language.Model(["a"], np.packbits(seen, axis=1), np.zeros((3, 1)))
    want = [[(a & b).sum() / math.sqrt(a.sum() * b.sum()) for b in seen] for a in seen]
    assert np.allclose(model._kernel(seen), want, atol=1e-6)


def test_without_languages_nothing_is_predicted(spark, docs):
    model = language.fit(docs([]))
    (row,) = docs([(1, "abc")]).select(language.predicted(F.col("text"), model).alias("g")).collect()
    assert (row.g.lang_pred, row.g.score) == ("und", 0.0)


# -- secrets ---------------------------------------------------------------------------


def spans_by_definition(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def secret_texts(rng, n):
    out = []
    for _ in range(n):
        ws = [prose(rng, "aa", 1) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            value = "".join(rng.choices("0123456789abcdef", k=rng.choice([5, 6, 23, 24, 40])))
            made = rng.choice([f'token = "{value}"###', f"PassWord:{value}", f"AKIA{value.upper()}", value, f"secret: token={value}", "ſecret=abcdefg"])
            ws.insert(rng.randint(0, len(ws)), made)
        out.append(rng.choice([" ", "\n"]).join(ws))
    return out


def test_base_spans_follow_their_definition():
    rng = random.Random(2)
    for text in secret_texts(rng, 400) + ["", "token", "🙂 token=abc🙂def123", "AKIA" * 9, "token=token=token=abcdef"]:
        assert secrets.base_spans(text) == spans_by_definition(text)


def best_path(model, emissions):
    """By trying every path."""
    t = model.transitions
    score = lambda p: sum(emissions[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
    return max(product(range(3), repeat=len(emissions)), key=score)


def test_decoding_by_stretches_is_viterbi_over_the_whole():
    rng = np.random.default_rng(4)
    for _ in range(200):
        model = secrets.Model({}, {}, rng.normal(size=(3, 3)))
        emissions = rng.normal(size=(rng.integers(1, 7), 3)) * 3 + [2, 0, 0]
        want = {i: y for i, y in enumerate(best_path(model, emissions)) if y}
        assert model.tags(emissions) == want


def test_the_field_learns_what_the_patterns_find(spark, docs):
    rng = random.Random(6)
    texts = secret_texts(rng, 400)
    model = secrets.fit(docs(list(enumerate(texts))))
    scanner, right, wrong = secrets.Scanner(model), 0, 0
    for text in secret_texts(rng, 100):
        labels = secrets._labels(text)
        if labels:
            ids = np.asarray([scanner.ids[w] for w, _ in labels])
            tags = model.tags(model.emissions(scanner.table, ids, text))
            for n, (_, tag) in enumerate(labels):
                right += bool(tag) and n in tags
                wrong += bool(tag) != (n in tags)
    assert right > 50 and wrong < 0.15 * right


def known_shapes(rng):
    """Keys in forms of public services, none of which the training words are made of."""
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = upper + upper.lower() + digits

    def drawn(alphabet, size):
        return "".join(rng.choices(alphabet, k=size))

    return [
        "ghp_" + drawn(every, 36),
        "sk_live_" + drawn(every, 24),
        f"xoxb-{drawn(digits, 12)}-{drawn(digits, 12)}-{drawn(every, 24)}",
        f"eyJ{drawn(every, 33)}.eyJ{drawn(every, 60)}.{drawn(every, 43)}",
        drawn(every + "/+", 40),
        drawn(every + "/+", 62) + "==",
        drawn(every, 32),
        drawn(digits + "ABCDEF", 40),
    ]


LURES = (
    "https://www.example.com/some/long/path/to/page-12345.html 550e8400-e29b-41d4-a716-446655440000 "
    "2024-03-01T10:00:00Z getUserAccountByIdentifier MAX_RETRY_COUNT_LIMIT foo.bar@mail7.example.com "
    "4720863463904856 /usr/local/lib/python3.13/site-packages v2.10.3-rc1 978-3-16-148410-0 x86_64-linux-gnu "
    "$1,234,567.89 test_that_all_rows_are_kept() 0x7fff5fbff8c0 ISO-8859-1 the&&& THLYOR!! 97.51.17.173"
).split()


def test_the_field_finds_secrets_outside_the_patterns(spark, docs):
    rng = random.Random(17)
    prose = [" ".join(rng.choices("all that one reads here was seen in some long book".split(), k=60)) for _ in range(300)]
    scanner = secrets.Scanner(secrets.fit(docs(list(enumerate(prose[:200])))))
    found = total = 0
    for text in prose[200:]:
        words = text.split()
        for key in known_shapes(rng):
            k = rng.randrange(len(words) + 1)
            now = " ".join([*words[:k], key, *words[k:]])
            assert secrets.base_spans(now) == []
            at, spans = now.index(key), scanner.spans(now)
            # A few signs at its edges may be missing, nothing else may be tagged.
            total += 1
            found += any(a <= at and b >= at + len(key.rstrip("=")) for _, a, b in spans)
            assert len(spans) <= 1
        assert scanner.spans(text) == []
        k = rng.randrange(len(words) + 1)
        assert scanner.spans(" ".join([*words[:k], rng.choice(LURES), *words[k:]])) == []
    assert found >= 0.95 * total


def test_made_words_follow_their_seed():
    first, again = ([secrets.invented.secret(random.Random(s)) for s in range(50)] for _ in range(2))
    assert first == again and len(set(first)) == 50


def test_expected_tags_are_sums_over_all_paths():
    rng = np.random.default_rng(8)
    for size in (1, 2, 5):
        scores, moves = rng.normal(size=(2, size, 3)), rng.normal(size=(3, 3))
        tags, pairs = np.zeros_like(scores), np.zeros((3, 3))
        for n in range(2):
            weight = {
                path: math.exp(
                    sum(scores[n, t, y] for t, y in enumerate(path)) + sum(moves[y, z] for y, z in zip(path, path[1:]))
                )
                for path in product(range(3), repeat=size)
            }
            for path, w in weight.items():
                for t, y in enumerate(path):
                    tags[n, t, y] += w / sum(weight.values())
                for y, z in zip(path, path[1:]):
                    pairs[y, z] += w / sum(weight.values())
        got_tags, got_pairs = secrets._expected(scores, moves)
        assert np.allclose(got_tags, tags) and np.allclose(got_pairs, pairs)


def test_spans_and_redaction_of_odd_rows(spark, docs):
    key = "0123456789abcdef" * 2
    rows = [(1, f'a token = "{key}" b'), (2, None), (3, ""), (None, key), (1, key), (1, key), (4, "x " * 200_000 + key)]
    model = secrets.fit(docs(rows))
    found = docs(rows).withColumn("s", secrets.spans(F.col("text"), model))
    got = found.select("doc_id", "text", "s", secrets.redacted(F.col("text"), F.col("s")).alias("r")).collect()
    for r in got:
        base = [tuple(s) for s in r.s if s["kind"] != "crf"]
        assert base == spans_by_definition(r.text or "")
        assert key not in (r.r or "") and (r.text is None) == (r.r is None)
    assert secrets.fit(docs([])) is None
    assert docs([]).select(secrets.spans(F.col("text"), None)).count() == 0


# -- lines -----------------------------------------------------------------------------


def without_repeats(rows):
    """One by one, in order of ids."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ls = (text or "").split("\n")
        gone = set()
        for p in range(len(ls) - 2):
            window = tuple(ls[p : p + 3])
            if any(re.search(r"[^\x20\x09-\x0D]", x) for x in window):
                if seen.setdefault(window, (i, p)) != (i, p):
                    gone |= {p, p + 1, p + 2}
        out[i] = "\n".join(x for p, x in enumerate(ls) if p not in gone) if gone else text
    return out


def test_repeated_windows_go(spark, docs):
    rng = random.Random(9)
    rows = [(n, "\n".join(rng.choices(["a", "b", "c d", "", "  "], k=rng.randint(0, 12)))) for n in range(120)]
    rows += [(200, None), (None, "a\nb\nc d\nz"), (201, "\n" * 50), (202, "q\n" * 3000)]
    got = {r.doc_id: r.text for r in lines.remove_repeats(docs(rows)).collect()}
    assert got == without_repeats(rows)


def test_line_columns(spark, table):
    data = table([(1, "a\nb\nc", 5), (2, "x\na\nb\nc\ny", 6), (2, "x\na\nb\nc\ny", 6)], "doc_id long, text string, lines_before long")
    got = sorted(lines.remove_repeats(data).collect())
    assert [(r.doc_id, r.text, r.lines_before) for r in got] == [(1, "a\nb\nc", 3), (2, "x\ny", 5), (2, "x\ny", 5)]
    assert [[tuple(x) for x in r.lines_removed] for r in got] == [[], [(1, 3)], [(1, 3)]]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in "_id _text _key _row runs hash pos n cls sig node size kept kept_id score lang_pred held_out group key path".split()
)


def test_columns_with_clashing_names(spark, table, tmp_path):
    import corpus_pipeline

    from reqsift.llm import mixing, near, packing, pieces
    from reqsift.llm.queries import PIECE_MODEL, WORD_TOKENIZER

    rng = random.Random(17)
    rows = [(n, "\n".join(prose(rng, "aa", 15) for _ in range(4)), "aa", "s", 1, *["x"] * 20) for n in range(30)]
    rows += [(40, rows[3][1], None, None, None, *[None] * 20), (41, None, "aa", "s", 0, *["y"] * 20)]
    data = table(rows, CLASHING)
    out = lines.remove_repeats(data)
    assert out.columns == [*data.columns, "lines_before", "lines_removed"]
    assert {(r.doc_id, r.runs, r._id) for r in out.collect()} == {(r[0], r[9], r[5]) for r in rows}
    assert near.components(data).count() == packing.pack(data, WORD_TOKENIZER).count() == 32
    assert pieces.encode(data, PIECE_MODEL).count() == mixing.scores(data).count() == 32
    assert quality.judged(data, table([(1, 1, "x")], "doc_id long, quality int, n_words string")).count() == 32
    assert licences.scan(data).count() == 32
    for _, stage in corpus_pipeline.STAGES[:-1]:
        data = stage(spark, data, str(tmp_path))
        assert [c for c, _ in data.dtypes] == [c.split()[0] for c in CLASHING.split(", ")]
    assert {r.doc_id for r in data.collect()} == set(range(30))


# -- licences --------------------------------------------------------------------------


def test_licences_and_their_directories(spark, table):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/x", "plain words here"), (3, "r/a/b/y", "more words\n" + gpl + "\nand words"),
        (4, "r/a/b/COPYING", gpl), (5, "r/a/b/c/z", "deep words"), (6, "other/w", None), (7, None, mit), (8, None, "words"),
        (9, "top", "words at the top"), (10, "r/a/b/c/v", ""), (None, "r/q", "the license of this is in the file above us all, said they"),
        (11, "r/long", "word " * 20_000 + "\n" + mit),
    ]
    got = {r.doc_id: (r.licence, r.origin, r.governed_by) for r in licences.scan(table(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "r"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "own", None),
        5: ("GPL-3.0", "inherited", "r/a/b"), 6: (None, "none", None), 7: ("MIT", "own", None), 8: (None, "none", None),
        9: (None, "none", None), 10: ("GPL-3.0", "inherited", "r/a/b"), None: ("MIT", "inherited", "r"), 11: ("MIT", "own", None),
    }
    assert licences.scan(table([], "doc_id long, path string, text string")).count() == 0


def test_full_texts_headers_and_tags(spark, table):
    mit = f"MIT License\n\nCopyright (c) 2020 Someone\n\n{licences._MIT}\n\n{licences._MIT_NOTICE}\n\n{licences._AS_IS}\n"
    two = f"Copyright (c) 2021, Someone\n\n{licences._BSD}\n\n{licences._BSD_TWO}\n\n{licences._BSD_AS_IS}"
    three = two.replace("\n\nTHIS", f"\n\n3. {licences._BSD_THIRD}\n\nTHIS")
    wrapped = re.sub(r"(.{40,60}) ", r"\1\n", mit)
    gpl = (
        "/*\n * One line to name the program.\n * Copyright (C) 2019 Someone\n *\n"
        " * This program is free software: you can redistribute it and/or modify\n"
        " * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n"
        " * (at your option) any later version.\n *\n * This program is distributed in the hope\n */\nint main;"
    )
    apache = (
        "# Copyright 2020 Someone\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n"
        "# you may not use this file except in compliance with the License.\n"
        "# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n\nx = 1\n"
    )
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
    plain = ["the notice of the town was read and nobody may use it without name " * 3, "copyright law is hard\n\nall the software in here", ""]
    bodies = [
        mit, wrapped, two, three, gpl, gpl.replace("version 3", "version 2"), gpl.replace("GNU General", "GNU Affero General"),
        gpl.replace("GNU General", "GNU Lesser General"), apache, mpl, licences._ISC,
        "// SPDX-License-Identifier: MIT", "x\n# SPDX-License-Identifier: (MIT OR Apache-2.0)\ny", *plain,
    ]
    files = table([(n, f"{n}/f", b) for n, b in enumerate(bodies)], "doc_id long, path string, text string")
    own = {r.doc_id: r.licence for r in licences.scan(files).collect()}
    assert [own[n] for n in range(len(bodies))] == [
        "MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "GPL-2.0", "AGPL-3.0", "LGPL-3.0", "Apache-2.0",
        "MPL-2.0", "ISC", "MIT", "MIT OR Apache-2.0", None, None, None,
    ]
    # A licence file governs its folder by its whole text.
    tree = [(1, "r/LICENSE", wrapped), (2, "r/src/a", "plain words"), (3, "r/odd", "\n" * 5000 + "words\n \n")]
    got = {r.doc_id: (r.licence, r.origin) for r in licences.scan(table(tree, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "inherited")}


def test_templates_from_a_table(spark, table):
    known = table([("House-1.0", "Used by leave of the house only"), (None, "x"), ("y", None)], "licence string, body string")
    files = table([(1, "a/b", "used by leave of the house only"), (2, "a/c", "words")], "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.origin) for r in licences.scan(files, known).collect()}
    assert got == {1: ("House-1.0", "own"), 2: ("House-1.0", "inherited")}


def test_cosines_are_those_of_the_definition(spark, table):
    texts = ["Released under the MIT license by the the team", "under the Apache License, version 2", "no licence"]
    files = table(list(enumerate(texts)), "doc_id long, text string")
    idf, unseen = licences.weights(files)
    least = 0.3
    got = {r.doc_id: [(x.score, x.licence) for x in r.l] for r in files.select(
        "doc_id", licences.unit_licences(F.col("text"), idf, unseen, least=least).alias("l")).collect()}
    n = len(texts)
    tokens = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    weight = lambda t: math.log((n + 1) / (sum(t in ts for ts in tokens) + 1)) + 1 if t in idf else math.log(n + 1) + 1
    vector = lambda ts: {t: k * weight(t) for t, k in Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, ts in enumerate(tokens):
        scores = []
        for name, body in licences.TEMPLATES:
            a, b = vector(ts), vector(re.findall("[a-z0-9]+", body.lower()))
            scores.append((round(sum(a[t] * b[t] for t in a if t in b) / norm(a) / norm(b), 6), name))
        best = max(scores)
        assert got[i] == ([best] if best[0] >= least else [])


# -- quality ---------------------------------------------------------------------------


def repeat_words(ws):
    times = Counter(zip(ws, ws[1:], ws[2:]))
    return len({p + d for p in range(len(ws) - 2) if times[tuple(ws[p : p + 3])] > 1 for d in range(3)})


def test_counts_by_definition(spark, docs):
    rng = random.Random(12)
    texts = ["".join(rng.choices("ab \n\t#|é", k=rng.randint(0, 60))) for _ in range(300)] + [None, "", "\x0b\x0c", "🙂 🙂 🙂 🙂", "w x y " * 30_000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in quality.described(docs(rows), "lang").collect()}
    for i, text in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(ws), sum(map(len, ws)), sum(map(text.count, "#*$%&|<>")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(full) - len(set(full)), repeat_words(ws))
        assert r.base_failed == (len(ws) < 50 or 100 * r.n_repeat_words > 50 * len(ws))


@pytest.mark.parametrize("n,k", [(100, 0), (1000, 7), (5000, 99), (20_000, 3)])
def test_the_binomial_tail_is_exact(spark, n, k):
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1))
    (row,) = spark.range(1).select(quality.tail(F.lit(n).cast("long"), F.lit(k).cast("long"), 0.02).alias("p")).collect()
    assert row.p == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_the_promised_rate(spark, docs, table):
    rng = random.Random(13)
    rows, labels = [], []
    for n in range(1200):
        bad = n % 4 == 0
        ws = [rng.choice(["alpha", "beta", "gamma"]) + str(rng.randint(0, 999)) for _ in range(80)]
        rows.append((n, " ".join(w + "###" if bad else w for w in ws)))
        labels.append((n, 0 if bad else 1))
    rows += [(5000, None), (None, rows[1][1]), (5001, rows[4][1])]
    labels += [(3, None), (None, 1)]
    got = {r.doc_id: r.kept for r in quality.judged(docs(rows), table(labels, "doc_id long, quality int")).collect()}
    good = [got[n] for n in range(1200) if n % 4]
    assert sum(good) >= 0.98 * len(good) and not any(got[n] for n in range(0, 1200, 4))
    assert (got[5000], got[None], got[5001]) == (False, True, False)
    few = quality.judged(docs(rows[:100]), table(labels[:100], "doc_id long, quality int"))
    assert few.filter("not kept and not base_failed").count() == 0
    assert quality.judged(docs([]), table([], "doc_id long, quality int")).count() == 0


def test_rules_together_keep_the_promised_rate(table):
    """Each rule alone may reject 1 % of the good documents, but not both."""
    good = [("en", [900 if n < 60 else 0, 900 if 60 <= n < 120 else 0, 0, 0, 0]) for n in range(6000)]
    rows = table(good, "stratum string, scores array<long>")
    proposed = quality.cutoffs(rows)
    assert {r.rule for r in proposed.collect()} == {0, 1, 2, 3, 4}
    stored = table([(r.stratum, r.rule, r.cutoff) for r in proposed.collect()], "stratum string, rule int, cutoff long")
    assert {r.rule for r in quality.together(rows, stored).collect()} == {0}
    nothing = table([], "stratum string, rule int, cutoff long")
    assert quality.together(rows, nothing).count() == 0
