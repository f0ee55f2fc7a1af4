import random
import re

import plain
from pyspark.sql import functions as F

from reqsift.functions import chunking, parsing, rules, text


def column(spark, values, expr, kind="string"):
    rows = [(n, v) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"n int, v {kind}")
    return [r.x for r in df.select("n", expr(F.col("v")).alias("x")).orderBy("n").collect()]


def test_white_space_is_that_of_unicode(spark):
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, f"a{c}b") for c in points], "c string, t string")
    split = df.filter(F.size(text.words(F.col("t"))) == 2)
    assert {r.c for r in split.collect()} == {c for c in points if len(f"a{c}b".split()) == 2}


def test_word_set_and_strip(spark):
    values = ["", "  ", "A b\tB c ", "　x\x1f", "Straße ÉTÉ été"]
    assert [set(x) for x in column(spark, values, text.word_set)] == [
        set(v.lower().split()) for v in values
    ]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_jaccard_of_empty_sets_is_zero(spark):
    df = spark.createDataFrame([("", ""), ("a", ""), ("a b", "b c"), ("A", "a")], "a string, b string")
    score = text.jaccard(text.word_set(F.col("a")), text.word_set(F.col("b")))
    assert [r.x for r in df.select(score.alias("x")).collect()] == [0.0, 0.0, 1 / 3, 1.0]


def test_set_key_ignores_order(spark):
    one, two, three = column(
        spark, ["a b c", "c a b b", "a b"], lambda v: text.set_key(text.word_set(v))
    )
    assert one == two != three


def test_answers(spark):
    values = ["Yes", " true ", "yes.", "no", None, "TRUE\n"]
    assert column(spark, values, text.is_yes) == [True, True, False, False, False, True]
    assert column(spark, values, text.starts_with_yes) == [True, False, True, False, False, False]


def test_chunks_equal_the_plain_packing(spark):
    random.seed(5)
    texts = ["", "\n\n", "a" * 70 + "\n\nb", "b\n\n" + "a" * 70, "x" * 49, "x" * 50]
    for _ in range(60):
        parts = ["p" * random.randint(0, 30) for _ in range(random.randint(1, 12))]
        texts.append("\n\n".join(parts))
    got = column(spark, texts, lambda v: chunking.pack_paragraphs(v, 50))
    assert got == [plain.chunks(t, 50, "\n\n") for t in texts]


def test_pages_up_to_the_limit_stay_whole(spark):
    page = "a" * 2999 + "\n\n" + "b" * 2999
    whole, cut = column(spark, [page, page + "c"], chunking.page_chunks)
    assert whole == [page] and len(cut) == 2


def test_short_chunks_are_marked(spark):
    pages = spark.createDataFrame(
        [("p", 1, 1, " " * 9 + "x" * 49), ("p", 2, 1, "x" * 50)],
        "project string, doc_id long, page_no int, text string",
    )
    rows = chunking.chunk_pages(pages).orderBy("doc_id").collect()
    assert [r.too_short for r in rows] == [True, False]


def test_candidates(spark):
    values = [
        '[{"title":"a","description":"d","type":"UI"}]',
        '```json\n[{"title":"z"}]\n```',
        'text ```[{"title":"z"}]``` more',
        '[{"title":null,"description":3}]',
        '[{"title":"a"}, 5]',
        '{"title":"a"}',
        '[{"title":"a"}] and more',
        '[{"title":"a"}],[{"title":"b"}]',
        "[{'title':'s'}]",
        '[{"title":"a"',
        "",
        "  ",
        None,
        "[]",
    ]
    got = [[tuple(c) for c in x] for x in column(spark, values, parsing.candidates)]
    assert got[:4] == [
        [("a", "d", "UI")],
        [("z", None, None)],
        [("z", None, None)],
        [(None, "3", None)],
    ]
    assert all(x == [] for x in got[4:])


def test_lenient_lists(spark):
    cases = {
        '["a", 1, {"x":2}, true]': ["a", "1", '{"x":2}', "true"],
        "[]": [],
        '"x"': ["x"],
        "5": ["5"],
        '{"a":1}': ['{"a":1}'],
        "plain text ": ["plain text"],
        " \n": [],
        '```json\n["q"]\n```': ["q"],
        "```\nnot json\n```": ["not json"],
        '["a"] tail': ['["a"] tail'],
        '["a"]],[["b"]': ['["a"]],[["b"]'],
        "['single']": ["['single']"],
        "[1,2": ["[1,2"],
    }
    assert column(spark, list(cases), parsing.lenient_list) == list(cases.values())


def test_lenient_steps(spark):
    raw = '[{"step_num": 1, "action": "go", "expected_result": "there"}, "look"]'
    (steps,) = column(spark, [raw], parsing.lenient_steps)
    assert [tuple(s) for s in steps] == [(1, "go", "there", None), (None, "look", None, None)]


def test_noise_and_status(spark):
    df = spark.createDataFrame(
        [
            ("The Executive", "Summary of", "yes", None),
            ("Executive Summary", "", "yes", None),
            ("impacted", "systems", "yes", None),
            ("a", None, " YES ", None),
            ("a", "b", "no", None),
            ("a", "b", None, "failed"),
        ],
        "title string, description string, verdict string, error string",
    )
    noise = rules.is_noise(F.col("title"), F.col("description"))
    got = df.select(rules.status(noise, F.col("verdict"), F.col("error")).alias("s")).collect()
    assert [r.s for r in got] == ["noise", "noise", "noise", "accepted", "rejected", "failed"]


def test_tiers(spark):
    got = column(spark, [0.3, 0.29999, 0.1, 0.09], rules.tier, "double")
    assert got == ["match", "borderline", "borderline", "reject"]


def test_strip_removes_what_the_pattern_for_blanks_names(spark):
    assert {chr(n) for n in range(0x10000) if not 0xD800 <= n < 0xE000 and re.match(text.BLANK, chr(n), re.ASCII)} == set(text.BLANKS)
    rows = [(b + "a" + b + "b" + b,) for b in text.BLANKS] + [(text.BLANKS,), ("",), (None,)]
    found = spark.createDataFrame(rows, "t string").select(text.strip(F.col("t")).alias("s"), "t")
    assert all(r.s == (r.t and r.t.strip(text.BLANKS)) for r in found.collect())
    assert "regexp" not in found._jdf.queryExecution().analyzed().toString()
