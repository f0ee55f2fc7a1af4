"""Packing token sequences into fixed windows by best-fit decreasing.

Every input partition packs its own documents, so nothing is shuffled and the
work of a task is bounded by its split.  Overlong documents are first cut into
full windows; what remains of each document is placed, largest first, into the
open window with the least sufficient room, which a segment tree over the
remaining capacities finds in logarithmic time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reqsift.llm.common import Memo, give_back, per_process, whole_text
from reqsift.llm.merging import MergeTable

WINDOW = 4096
#: Pieces that one packing holds at once; a larger split is packed in several goes.
GROUP = 500_000
END_ID = 2
#: Fixed value: how the tokenizer cuts a lower-case word, for Latin-1 letters and digits.
_PARTS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
_PLAIN = re.compile(r"[!-~¡-¬®-ÿ]{1,64}")

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, padded_to long"
)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._change(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``need``: (room, window)."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.at[room].pop()
        self._change(room, -1)
        return room, window

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: Iterable[int], size: int) -> tuple[list[int], list[int], int]:
    """(window, offset) of every length, and the number of windows.

    Lengths are at most ``size``; equal lengths keep their order.
    """
    lengths = np.asarray(list(lengths), dtype=np.int64)
    window, offset = [0] * len(lengths), [0] * len(lengths)
    tree, opened = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.tightest(need)
        if found is None:
            room, at = size, opened
            opened += 1
        else:
            room, at = found
        window[i], offset[i] = at, size - room
        if room > need:
            tree.add(room - need, at)
    return window, offset, opened


class WordTokens:
    """Ids of whole texts, encoded word by word.

    The tokenizer drops white space and none of its tokens crosses it, so the ids
    of a text are those of its words one after another.  Words of Latin-1 letters,
    digits and signs are cut as the tokenizer cuts them and merged many at a time;
    the library itself encodes any other word, and whole texts that may hold one of
    its special tokens.
    """

    def __init__(self, path: str, room: int = 32 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = MergeTable(
            [(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs]
        )
        letters = _byte_letters()
        self.inner = np.asarray([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.asarray([vocab[c + "</w>"] for c in letters], dtype=np.int32)
        self.memo = Memo(self._by_library, room)
        self.other = Memo(self._by_library, room // 8)

    def forget(self) -> None:
        """Drop the remembered words."""
        self.memo.forget()
        self.other.forget()

    def _by_library(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def learn(self, missing: list[str]) -> None:
        """Put the ids of lower-case words into the memory."""
        plain = [w for w in missing if _PLAIN.fullmatch(w)]
        whole = {w for w in plain if w.isalpha()}
        ended = {w: w[:-1] for w in plain if w[-1] in ".,|" and w[:-1].isalpha()}
        other = {w: _PARTS.findall(w) for w in plain if w not in whole and w not in ended}
        parts = self._encode_parts(whole.union(ended.values(), ".,|", *other.values()))
        put = self.memo.put
        for word in whole:
            put(word, parts[word])
        for word, stem in ended.items():
            put(word, parts[stem] + parts[word[-1]])
        for word, ps in other.items():
            put(word, b"".join([parts[p] for p in ps]))

    def _encode_parts(self, parts: set[str]) -> dict[str, bytes]:
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        done: dict[str, bytes] = {}
        for part in parts:
            raw = part.encode()
            names, raws = by_length.setdefault(len(raw), ([], []))
            names.append(part)
            raws.append(raw)
        for length, (names, raws) in by_length.items():
            codes = np.frombuffer(b"".join(raws), dtype=np.uint8).reshape(-1, length)
            symbols = self.inner[codes]
            symbols[:, -1] = self.last[codes[:, -1]]
            for rows, ids in self.merges.merge(symbols):
                raw, width = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for i, row in enumerate(rows.tolist()):
                    done[names[row]] = raw[i * width : (i + 1) * width]
        return done

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split, ways = [], []
        for text in texts:
            if "<|" in text:
                split.append([text])
                ways.append(self._by_library)
                continue
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                ways.append(self.other.__getitem__)
            else:
                text = text.lower()
                ways.append(self.memo.__getitem__)
            split.append(text.replace("\n", " ").split(" "))
        plain = [ws for ws, way in zip(split, ways) if way == self.memo.__getitem__]
        missing = set().union(*plain).difference(self.memo)
        self.learn([w for w in missing if w not in self.memo.old])
        return [b"".join(map(way, ws)) for ws, way in zip(split, ways)]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def _text_groups(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch in groups of about ``size`` characters."""
    keys, texts, held = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        keys.append(key.as_py())
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= size:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP
) -> DataFrame:
    """One row per piece of a document of ``docs(doc_id, text, …)``; see ``PIECES``.

    A document is its ids, then ``end_id``; ``start`` counts its ids before the
    piece.  Pieces of one sequence are gapless from offset 0; ``padded_to`` is the
    sequence's length with padding (``window``, or its own length at a power of two).

    Null text is empty: one piece with the end id alone.  Null ids and repeated
    rows are packed like any others, each row for itself; other columns are
    ignored; an empty table gives no rows.  Equal lengths are placed in the order of
    the input.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("word tokens", tokenizer), lambda: WordTokens(tokenizer))
        end = int(end_id).to_bytes(4, "little")
        next_sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal next_sequence
            # The last piece of equal length comes last, and ties do not depend on ids.
            at, offset, opened = best_fit_decreasing((r[2] for r in rows), window)
            used = np.zeros(opened, dtype=np.int64)
            np.add.at(used, at, [r[2] for r in rows])
            full = np.where((used & (used - 1)) == 0, used, window)
            data = list(zip(*rows)) + [[next_sequence + a for a in at], offset, full[at].tolist()]
            next_sequence += opened
            rows.clear()
            names = [f.split()[0] for f in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in data], names=names)

        try:
            for batch in batches:
                for keys, texts in _text_groups(batch):
                    for key, ids in zip(keys, encoder.encode(texts)):
                        ids += end
                        total = len(ids) // 4
                        for start in range(0, total, window):
                            piece = ids[4 * start : 4 * (start + window)]
                            rows.append((key, start, len(piece) // 4, zlib.crc32(piece), total))
                        if len(rows) >= group:
                            yield packed()
            if rows:
                yield packed()
        finally:
            encoder.forget()
            rows.clear()
            give_back()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    return chosen.mapInArrow(work, PIECES)
