"""Encoding, decoding and packing against the libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from reqsift.llm import common, packing, pieces
from reqsift.llm.queries import PIECE_MODEL, WORD_TOKENIZER

ODD = [
    "", " ", "   a    b", "\n\n \n a", "\ta▁b ▁ c", "日本語 テスト🙂🙂 ok", "</s><s><0x0A>", "\x00a\x00", "a" * 300,
    "ab" * 200 + " " * 70 + "x" + " " * 33, "don't<|endoftext|> I'LL<|startoftext|>y", "é ́a İ ẞ ΑΣ ΑΣ.",
    "\x1cfoo\x85bar z\xa0q", " I'LL we've 12 3a½",
]


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PIECE_MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinotrsthe   ▁\nAB.,0123éñß日本🙂\t"), max_size=60))
def test_pieces_equal_the_library_on_any_text(text):
    encoder, library = _pair()
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == [1, *library.encode(text), 2]


_made = []


def _pair():
    if not _made:
        _made.extend((pieces.PieceEncoder(PIECE_MODEL), SentencePieceProcessor(model_file=PIECE_MODEL)))
    return _made


def test_pieces_equal_the_library_on_strings_of_pieces(encoder, library):
    rng, known = random.Random(5), sorted(encoder.ids)
    for _ in range(1500):
        text = "".join(rng.choice(known).replace("▁", " ") for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text, ends=False), "<u4").tolist() == library.encode(text)


def test_forgetting_changes_nothing(library):
    small = pieces.PieceEncoder(PIECE_MODEL, room=1000)
    for text in ["the same words and the same words again", "and others the words"] * 3:
        assert np.frombuffer(small.encode(text, ends=False), "<u4").tolist() == library.encode(text)
        small.forget()


def test_pairs_by_their_seam_equal_merging(encoder):
    rng, known = random.Random(7), sorted(encoder.pieces)
    short = [i for i in known if encoder.length[i] <= 3]
    for _ in range(4000):
        one, two = (rng.choice(short if rng.random() < 0.5 else known) for _ in range(2))
        names = [encoder.pieces[one], encoder.pieces[two]]
        assert encoder.is_compatible(one, two) == (encoder.merged("".join(names)) == names)
        assert encoder.is_compatible(-1, two) == (encoder.merged(names[1]) == names[1:])


def test_remembered_words_are_bounded_in_bytes():
    import tracemalloc

    tracemalloc.start()
    memo = common.Memo(lambda w: w.encode() * 4, room=1 << 20)
    rng = random.Random(2)
    for _ in range(60):
        word = "x" * rng.randint(50_000, 200_000)
        assert memo[word] == word.encode() * 4 and word not in memo
    for n in range(30_000):
        assert memo[f"word{n}"] == f"word{n}".encode() * 4
    # two generations of a megabyte, and what the estimate misses
    assert tracemalloc.get_traced_memory()[0] < 4 << 20
    memo.forget()
    assert not memo and not memo.old
    tracemalloc.stop()


def test_encode_and_decode_rows(spark, docs, library):
    rows = [(n, t) for n, t in enumerate(ODD)] + [(None, "no id"), (3, None), (3, None), (9, "word " * 50_000)]
    encoded = pieces.encode(docs(rows), PIECE_MODEL, decoded=True)
    assert encoded.columns == ["doc_id", "ids", "text"]
    again = encoded.select("doc_id", "ids", "text", pieces.decode(encoded.ids, PIECE_MODEL).alias("own")).collect()
    want = sorted((str(i), [1, *library.encode(t or ""), 2]) for i, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in again) == want
    for r in again:
        assert r.text == r.own == library.decode(np.frombuffer(r.ids, "<u4").tolist())
    assert pieces.encode(docs([]), PIECE_MODEL).count() == 0


def test_word_tokens_equal_the_library():
    words, whole = packing.WordTokens(WORD_TOKENIZER, room=10_000), Tokenizer.from_file(WORD_TOKENIZER)
    rng = random.Random(3)
    letters = "abcdeéßñ .,'\n12#*|Œ<日"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(600)] + ["x" * 500]
    for i in range(0, len(texts), 7):
        for text, ids in zip(texts[i : i + 7], words.encode(texts[i : i + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def best_fit(lengths, size):
    """By trying every open window."""
    rooms, placed = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[i]
        else:
            rooms.append(size - lengths[i])
    return sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_the_segment_tree_finds_the_tightest_window(lengths):
    window, offset, opened = packing.best_fit_decreasing(lengths, 50)
    used, spans = [0] * opened, defaultdict(list)
    for i, n in enumerate(lengths):
        used[window[i]] += n
        spans[window[i]].append((offset[i], offset[i] + n))
    assert sorted(50 - u for u in used) == best_fit(lengths, 50)
    for some in spans.values():
        some.sort()
        assert some[0][0] == 0 and all(a[1] == b[0] for a, b in zip(some, some[1:]))


def test_packed_rows_hold_every_id_once(spark, docs):
    rng = random.Random(8)
    rows = [(n, " ".join(rng.choices(["the", "token", "stream", "zyx9"], k=rng.randint(0, 90)))) for n in range(300)]
    rows += [(500, "long " * 9000), (501, None), (501, None), (None, "no id"), (7, "again")]
    got = packing.pack(docs(rows), WORD_TOKENIZER, window=256, group=100).collect()
    whole = Tokenizer.from_file(WORD_TOKENIZER)
    want = defaultdict(list)
    for i, text in rows:
        ids = np.asarray([*whole.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for start in range(0, len(ids), 256):
            piece = ids[start : start + 256]
            want[i].append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    have, windows = defaultdict(list), defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.offset + r.length, r.padded_to))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    padding = 0
    for some in windows.values():
        some.sort()
        assert some[0][0] == 0 and all(a[1] == b[0] for a, b in zip(some, some[1:]))
        end, padded = some[-1][1], some[-1][2]
        assert padded == (end if end & (end - 1) == 0 else 256)
        padding += padded - end
    assert padding < 0.15 * sum(r.length for r in got)
    assert packing.pack(docs([]), WORD_TOKENIZER).count() == 0


def test_models_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as formats

    model = formats.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceEncoder(str(path))
