"""SentencePiece BPE encoding by a prefix table of last tokens, and decoding.

The encoding of a text is the only one in which all neighbours are compatible,
two tokens being compatible if merging their joined string gives just these two.
So each prefix has one last token: of the tokens that an automaton finds to end
there, the one that is compatible with the last token of the prefix before it.
One pass stores these tokens and the ids are read off backwards, in time linear
in the text.

Whether a pair is compatible shows along its seam: while the two tokens are merged up,
each in its own order, no merge across the seam may have a better score than the next
merge on either side.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reqsift.llm.common import Memo, give_back, per_process, whole_text

#: Fixed values of the file format: the blank's stand-in and the kinds of pieces.
BLANK = "▁"
NORMAL, BYTE = 1, 6

#: Pairs of tokens that an encoder remembers from task to task.
PAIRS = 300_000


class PieceEncoder:
    """Encodes with a BPE model of byte fallback, no normalisation and a leading blank.

    No piece of such a model crosses from a word into the next blank, so texts are
    cut there, and at line ends, and equal words are encoded once while remembered.
    """

    def __init__(self, path: str, room: int = 32 << 20):
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = [i for i, p in enumerate(model.pieces) if p.type == BYTE]
        rules = model.normalizer_spec
        if (
            rules.precompiled_charsmap
            or rules.remove_extra_whitespaces
            or not (rules.add_dummy_prefix and rules.escape_whitespaces)
            or len(self.byte_ids) != 256
            or any(c not in normal for p in normal for c in p)
            or any(BLANK in p.lstrip(BLANK) or "\n" in p for p in normal)
        ):
            raise ValueError("not a model of this kind: " + path)
        self.scores = {p: model.pieces[i].score for p, i in normal.items()}
        self.pieces = {i: p for p, i in normal.items()}
        self.length = {i: len(p) for p, i in normal.items()}
        self.ids = normal
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.prefixes = {p[:k] for p in normal for k in range(len(p) + 1)}
        self.states: dict[str, tuple] = {}
        self.root = self._state("")
        self.seams: dict[int, tuple] = {}
        # Per token: which tokens before it (-1 for none) it is compatible with.
        self.compatible: list[dict[int, bool]] = [{} for _ in model.pieces]
        self.pairs = 0
        self.after_blank = Memo(lambda w: self._packed(BLANK + w), room)
        self.plain = Memo(self._packed, room // 4)

    def forget(self) -> None:
        """Drop remembered words, and remembered pairs where they are many."""
        self.after_blank.forget()
        self.plain.forget()
        if self.pairs > PAIRS:
            self.compatible = [{} for _ in self.compatible]
            self.pairs = 0

    def merged(self, text: str) -> list[str]:
        """Merge by definition: the best-scored pair first, of equals the leftmost."""
        symbols = list(text)
        while True:
            pairs = [a + b for a, b in zip(symbols, symbols[1:])]
            best = max((self.scores[p] for p in pairs if p in self.scores), default=None)
            if best is None:
                return symbols
            i = next(i for i, p in enumerate(pairs) if self.scores.get(p) == best)
            symbols[i : i + 2] = [pairs[i]]

    def _seams(self, piece: str) -> tuple[bool, list, list]:
        """Whether a piece is merged to itself, and its last and first symbols while that goes
        on, each with the score of the merge that replaces it (none for the whole piece)."""
        symbols, last, first, level = list(piece), [], [], math.inf
        while len(symbols) > 1:
            pairs = [self.scores.get(a + b, -math.inf) for a, b in zip(symbols, symbols[1:])]
            best = max(pairs)
            if best == -math.inf:
                return False, [], []
            if best > level:
                raise ValueError("a merge has a better score than one before it: " + piece)
            i, level = pairs.index(best), best
            if i == 0:
                first.append((symbols[0], best))
            if i == len(pairs) - 1:
                last.append((symbols[-1], best))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return True, [*last, (piece, -math.inf)], [*first, (piece, -math.inf)]

    def _seam(self, piece: int) -> tuple[bool, list, list]:
        if piece not in self.seams:
            self.seams[piece] = self._seams(self.pieces[piece])
        return self.seams[piece]

    def is_compatible(self, before: int, piece: int) -> bool:
        """Whether the joined string of two tokens is merged to just these two."""
        whole, _, right = self._seam(piece)
        if not whole or before < 0:
            return whole
        left = self._seam(before)[1]
        scores, i, j = self.scores, 0, 0
        while True:
            (a, up), (b, other) = left[i], right[j]
            across = scores.get(a + b)
            # Of equal scores the leftmost is merged first.
            if across is not None and across > up and across >= other:
                return False
            if up >= other:
                if up == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _state(self, suffix: str) -> tuple[dict, list, str]:
        """The automaton's state for the longest suffix read that begins a token: the states
        that follow it as far as they are known, and the tokens that end there, longest first."""
        if suffix not in self.states:
            ends = [suffix[k:] for k in range(len(suffix)) if suffix[k:] in self.ids]
            self.states[suffix] = ({}, [(self.ids[p], len(p)) for p in ends], suffix)
        return self.states[suffix]

    def _step(self, state: tuple, char: str) -> tuple:
        text = state[2] + char
        while text not in self.prefixes:
            text = text[1:]
        # Characters outside the model all lead to the root and are not remembered.
        if text:
            state[0][char] = self._state(text)
        return self._state(text)

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text whose blanks are written as stand-ins; nothing is added."""
        last = [-1] * (len(text) + 1)
        compatible = self.compatible
        state, end = self.root, 0
        for char in text:
            end += 1
            state = state[0].get(char) or self._step(state, char)
            for piece, length in state[1]:
                # -1 at the start, and after a character outside the model: no neighbour
                before = last[end - length]
                good = compatible[piece].get(before)
                if good is None:
                    good = compatible[piece][before] = self.is_compatible(before, piece)
                    self.pairs += 1
                if good:
                    last[end] = piece
                    break
        ids, end = [], len(text)
        while end:
            piece = last[end]
            if piece < 0:
                ids.extend(self.byte_ids[b] for b in reversed(text[end - 1].encode()))
                end -= 1
            else:
                ids.append(piece)
                end -= self.length[piece]
        ids.reverse()
        return ids

    def _packed(self, text: str) -> bytes:
        return np.asarray(self.encode_part(text), dtype="<u4").tobytes()

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts: list[bytes] = []
        if text:
            word, plain = self.after_blank.__getitem__, self.plain.__getitem__
            for n, line in enumerate(text.replace(BLANK, " ").split("\n")):
                if n:
                    parts.append(plain("\n"))
                words = line.split(" ")
                if "" in words:
                    line = ("" if n else BLANK) + line.replace(" ", BLANK)
                    parts.extend(map(plain, _WORDS.findall(line)))
                    continue
                parts.append(plain(words[0]) if n else word(words[0]))
                parts.extend(map(word, words[1:]))
        if ends:
            parts = [self.begin.to_bytes(4, "little"), *parts, self.end.to_bytes(4, "little")]
        return b"".join(parts)


_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


#: Characters of text in one batch of results.
_GROUP = 1 << 21


def _decoder(model: str):
    from sentencepiece import SentencePieceProcessor

    return per_process(("piece decoder", model), lambda: SentencePieceProcessor(model_file=model))


def encode(docs: DataFrame, model: str, ends: bool = True, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs(doc_id, text, …)``.

    ``ids`` holds the whole text's ids as little-endian unsigned 32-bit integers,
    with begin and end ids if ``ends``.  ``decoded`` adds ``text``, decoded from them in
    the same pass.  A null text is an empty one and has the two ends alone.  Null doc_ids
    and repeated rows are kept as they come; other columns are ignored; an empty table
    gives no rows.
    """
    schema = "doc_id long, ids binary" + (", text string" if decoded else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("pieces", model), lambda: PieceEncoder(model))
        back = _decoder(model) if decoded else None
        try:
            for batch in batches:
                rows, held = [], 0
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    ids = encoder.encode(text, ends)
                    again = (back.decode(np.frombuffer(ids, "<u4").tolist()),) if decoded else ()
                    rows.append((doc_id.as_py(), ids, *again))
                    held += len(text)
                    if held > _GROUP:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)
        finally:
            encoder.forget()
            give_back()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    return chosen.mapInArrow(work, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "ids": pa.binary(), "text": pa.string()}
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds)[: len(columns)])


def decode(ids: Column, model: str) -> Column:
    """Text of an ``ids`` column as ``encode`` writes it; null of null."""

    @F.arrow_udf("string")
    def text(packed: pa.Array) -> pa.Array:
        back, out = _decoder(model), []
        for raw in packed:
            raw = raw.as_py()
            out.append(None if raw is None else back.decode(np.frombuffer(raw, "<u4").tolist()))
        return pa.array(out, pa.string())

    return text(ids)
