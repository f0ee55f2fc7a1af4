"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The field tags the words of a text as outside, begin or inside of a secret, from
their shape, their neighbours' and a few features of the whole file.  It is trained
on a bounded sample in which the patterns' finds serve as labels, so it also learns
how secrets look where no pattern applies.  Decoding is Viterbi's: words whose lead
for "outside" exceeds all that transitions could give are outside on every best path,
so only the stretches between them have to be decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reqsift.llm import invented
from reqsift.llm.common import WORD, Memo, give_back, whole_text

#: The patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Bounds of the training sample: documents looked at, and stretches of words kept of
#: each sort; words on either side of a find.  In training, words are cut to ``LONGEST``.
SAMPLE, STRETCHES, AROUND, LONGEST = 20_000, 1500, 8, 256
#: Sorts of stretches: with a find of the patterns, without, with a made secret or lure.
PATTERN, CLEAN, MADE, LURE = range(4)
OUT, BEGIN, INSIDE = 0, 1, 2
ROUNDS, RATE, PENALTY = 120, 0.25, 1e-4

SPANS = "array<struct<kind:string,start:int,end:int>>"

_WORD = re.compile(WORD)
_EDGE = "\"'`,;:()[]{}<>*#$%&|!?."
_NAMES = re.compile(r"passw|secret|token|api_?key|key|auth|bearer|credential|akia", re.I)
_RUN = re.compile(r"(.)\1+", re.S)
_PIECE = re.compile(r"[^\W_]+")
_VOWELS = set("aeiouyAEIOUY")


class _Shape(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-"
        return self[code]


_SHAPE = _Shape()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Finds of the three patterns, leftmost and non-overlapping per kind, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def word_features(word: str) -> tuple[str, ...]:
    """What a word looks like, in a fixed number of features or fewer."""
    stem = word.rstrip(".,")
    if stem.isalpha() and (stem[1:].islower() or len(stem) == 1):
        size = "n" + str(min(len(stem), 24) // 4)
        named = "name" if _NAMES.search(stem) else "word"
        return ("plain", size, named) if len(stem) == len(word) else ("plain", size, named, "stop")
    core = word.strip(_EDGE)
    if not core:
        return ("sign", "sign" + word[:2])
    shape = core.translate(_SHAPE)
    digits, upper, size = shape.count("0"), shape.count("A"), len(core)
    short = _RUN.sub(r"\1", shape)
    out = [
        f"n{min(size, 48) // 4}",
        "s" + short[:6],
        f"t{min(len(short), 12) // 2}",
        f"d{4 * digits // size}",
        f"u{4 * upper // size}",
        f"v{min(len(set(core)), 24) // 3}",
    ]
    piece = max(_PIECE.findall(core), key=len, default="")
    inside = piece.translate(_SHAPE)
    length, changes = min(len(piece), 48) // 6, min(len(_RUN.sub(r"\1", inside)), 16) // 2
    letters = max(len(inside) - inside.count("0"), 1)
    out += [
        f"p{length}c{changes}",
        f"p{length}d{6 * inside.count('0') // max(len(inside), 1)}",
        f"p{length}w{5 * len([c for c in piece if c in _VOWELS]) // letters}",
        f"signs{min(shape.count('-'), 6)}",
        f"dots{min(core.count('.'), 3)}",
    ]
    if "/" in core:
        out.append("url" if "://" in core else f"path{min(core.count('/'), 3)}")
    if size >= 8 and not core.strip("0123456789abcdefABCDEF"):
        out.append("hex")
    if digits and upper and upper + digits < size:
        out.append("mixed")
    if "=" in core or ":" in core:
        out.append("pair")
    if "@" in core:
        out.append("at")
    if word[0] in "\"'`":
        out.append("quoted")
    if _NAMES.search(core):
        out.append("name")
    return tuple(out)


def file_features(text: str) -> tuple[str, ...]:
    """A few traits of the whole text: how it is punctuated and broken into lines."""
    size = max(len(text), 1)
    signs = sum(map(text.count, "={};"))
    lines = text.count("\n") + 1
    return (f"signs{min(9, 1000 * signs // size)}", f"lines{min(9, (size // lines).bit_length())}")


_ROLES = ("own", "before", "before2", "after")


@dataclass
class Model:
    """Weights of features by role, of file features, and of transitions between tags."""

    weights: dict[str, np.ndarray]
    file_weights: dict[str, np.ndarray]
    transitions: np.ndarray

    def scores(self, features: tuple[str, ...]) -> np.ndarray:
        """4 roles x 3 tags."""
        known = [self.weights[f] for f in features if f in self.weights]
        return np.sum(known, axis=0) if known else np.zeros((len(_ROLES), 3))

    def emissions(self, table: np.ndarray, ids: np.ndarray, text: str) -> np.ndarray:
        """Score of each tag at each word; ``table`` holds the words' scores by id."""
        at = table[ids]
        out = at[:, 0].copy()
        out[1:] += at[:-1, 1]
        out[2:] += at[:-2, 2]
        out[:-1] += at[1:, 3]
        for f in file_features(text):
            if f in self.file_weights:
                out += self.file_weights[f]
        return out

    def viterbi(self, emissions: np.ndarray, before: int | None, after: int | None) -> list[int]:
        """Best tags of a stretch whose neighbours' tags, if any, are given."""
        t = self.transitions
        score = emissions[0] + (t[before] if before is not None else 0)
        back = []
        for e in emissions[1:]:
            step = score[:, None] + t
            back.append(step.argmax(0))
            score = step.max(0) + e
        if after is not None:
            score = score + t[:, after]
        tags = [int(score.argmax())]
        for pointers in reversed(back):
            tags.append(int(pointers[tags[-1]]))
        return tags[::-1]

    def tags(self, emissions: np.ndarray) -> dict[int, int]:
        """Positions that the best path tags as begin or inside."""
        t = self.transitions
        # The most that leaving "outside" can gain in the transitions on both sides.
        gain = [
            max(0.0, (t[:, y] - t[:, OUT]).max()) + max(0.0, (t[y] - t[OUT]).max())
            for y in (BEGIN, INSIDE)
        ]
        lead = emissions[:, OUT] - np.maximum(emissions[:, BEGIN] + gain[0], emissions[:, INSIDE] + gain[1])
        open_at = np.flatnonzero(lead <= 0)
        found: dict[int, int] = {}
        for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1) if len(open_at) else []:
            before = OUT if run[0] > 0 else None
            after = OUT if run[-1] < len(emissions) - 1 else None
            best = self.viterbi(emissions[run[0] : run[-1] + 1], before, after)
            found |= {int(p): y for p, y in zip(run, best) if y != OUT}
        return found


class Scanner:
    """Finds the spans of one text after another; the scores of words are remembered."""

    def __init__(self, model: Model | None, limit: int = 200_000):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.ids = Memo(self._number)
        self.rows: dict[tuple[str, ...], int] = {}
        self.table = np.zeros((1024, len(_ROLES), 3))

    def _number(self, word: str) -> int:
        """Row of the word's scores in the table; words that look alike share it."""
        features = word_features(word)
        row = self.rows.get(features)
        if row is None:
            row = self.rows[features] = len(self.rows)
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[row] = self.model.scores(features)
        return row

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans by start, then kind; those of the field touch none of the patterns'."""
        found = base_spans(text)
        words = _WORD.findall(text) if self.model else []
        if not words:
            return found
        if len(self.rows) > self.limit:
            self._forget()
        ids = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        tags = self.model.tags(self.model.emissions(self.table, ids, text))
        if tags:
            own = [s for s in _tagged(text, tags) if all(s[2] <= b or e <= s[1] for _, b, e in found)]
            found = sorted(found + own, key=lambda s: (s[1], KINDS.index(s[0])))
        return found


def _tagged(text: str, tags: dict[int, int]) -> list[tuple[str, int, int]]:
    """Spans of runs of tagged words, without the signs at their edges."""
    runs: list[list[int]] = []
    last = -2
    for n, m in enumerate(_WORD.finditer(text)):
        if n not in tags:
            continue
        left = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
        right = m.start() + len(m[0].rstrip(_EDGE))
        if left < right:
            if n == last + 1 and tags[n] == INSIDE:
                runs[-1][1] = right
            else:
                runs.append([left, right])
            last = n
    return [("crf", a, b) for a, b in runs]


def _labels(text: str) -> list[tuple[str, int]]:
    """Words of a text with their tags by the patterns' values."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    values += [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]
    values.sort()
    out, k, open_value = [], 0, None
    for m in _WORD.finditer(text):
        while k < len(values) and values[k][1] <= m.start():
            k += 1
        inside = k < len(values) and values[k][0] < m.end()
        tag = OUT if not inside else INSIDE if open_value == k else BEGIN
        open_value = k if inside else None
        out.append((m[0][:LONGEST], tag))
    return out


def _made(rng: Random, labels: list[tuple[str, int]], sort: int) -> list[tuple[str, int]] | None:
    """A stretch of a text in which a made word, with its lead, stands in place of one of the text's."""
    n = rng.randrange(len(labels))
    part = labels[max(0, n - AROUND) : n + AROUND + 1]
    if any(tag for _, tag in part):
        return None
    n -= max(0, n - AROUND)
    if sort == MADE:
        lead, word = invented.with_secret(rng)
        put = [(w, OUT) for w in lead] + [(word[:LONGEST], BEGIN)]
    else:
        plain = [w for w in (w.strip(_EDGE) for w, _ in part) if w.isalpha()] or ["name"]
        lead = [rng.choice(invented.NAMED + invented.UNNAMED)] if rng.random() < 0.4 else []
        put = [(w[:LONGEST], OUT) for w in (*lead, invented.lure(rng, plain))]
    part = part[:n] + put + part[n + 1 :]
    if base_spans(" ".join(w for w, _ in part)):
        return None
    over = len(part) - 2 * AROUND - 1
    return part[over:] if over > 0 else part


def _stretches(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[pa.RecordBatch]:
    """Training stretches of sampled documents: round finds, round other words, and ``each`` of made ones."""
    rows = []
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            key, text = key.as_py(), text.as_py()
            labels, traits, rng = _labels(text), list(file_features(text)), Random(key)
            finds = [n for n, (_, tag) in enumerate(labels) if tag == BEGIN]
            others = [n for n, (w, tag) in enumerate(labels) if tag == OUT and not w.isalpha()]
            chosen = [(n, PATTERN) for n in finds[:3]]
            for pool in (others, range(len(labels))):
                if len(pool):
                    chosen.append((pool[key % len(pool)], CLEAN))
            parts = []
            for n, sort in chosen:
                part = labels[max(0, n - AROUND) : n + AROUND + 1]
                if sort == PATTERN or not any(tag for _, tag in part):
                    parts.append((sort, part))
            for sort in (MADE, LURE) * each if labels else ():
                parts.append((sort, _made(rng, labels, sort)))
            for sort, part in parts:
                if part:
                    words, tags = zip(*part)
                    rows.append((key, sort, list(words), list(tags), traits))
    if rows:
        names = ["key", "sort", "words", "tags", "file"]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string())]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def fit(docs: DataFrame, sample: int = SAMPLE, stretches: int = STRETCHES) -> Model | None:
    """Train on a bounded sample of ``docs(text, …)``; None if no text has a word.

    The sample is drawn by a hash of the text, so copies count once.  Each text gives as
    many made stretches as it takes to fill their part of the sample.
    """
    rows = docs.select(F.xxhash64(whole_text(F.col("text"))).alias("key"), whole_text(F.col("text")).alias("text"))
    number = max(docs.count(), 1)
    rate, each = sample / number, max(1, min(2 * stretches // number, 50))
    drawn = rows.filter(F.pmod("key", F.lit(1 << 30)) < int(rate * (1 << 30))).dropDuplicates(["key"])
    schema = "key long, sort int, words array<string>, tags array<int>, file array<string>"
    found = drawn.mapInArrow(lambda batches: _stretches(batches, each), schema)
    turn = F.row_number().over(Window.partitionBy("sort").orderBy(F.xxhash64("key", "words"), "words"))
    kept = found.withColumn("turn", turn).filter(F.col("turn") <= stretches)
    drawn_rows = kept.orderBy("sort", "turn").collect()
    return train(drawn_rows) if drawn_rows else None


def train(rows: list) -> Model:
    """Maximum likelihood by adaptive gradient steps over all stretches at once."""
    size = 2 * AROUND + 1
    # Words that look alike share a row.
    words: dict[tuple[str, ...], int] = {("none",): 0}
    files: dict[str, int] = {}
    ids = np.zeros((len(rows), size), dtype=np.int64)
    tags = np.zeros((len(rows), size), dtype=np.int64)
    traits = []
    for n, row in enumerate(rows):
        ids[n, : len(row.words)] = [words.setdefault(word_features(w), len(words)) for w in row.words]
        tags[n, : len(row.tags)] = row.tags
        traits.append([files.setdefault(f, len(files)) for f in row.file])
    traits = np.asarray(traits)
    features: dict[str, int] = {}
    of_word = [[features.setdefault(f, len(features)) for f in w] for w in words]
    starts = np.cumsum([0] + [len(f) for f in of_word[:-1]])
    flat, owner = np.concatenate(of_word), np.repeat(np.arange(len(words)), [len(f) for f in of_word])
    weights = np.zeros((len(features), len(_ROLES), 3))
    file_weights, moves = np.zeros((len(files), 3)), np.zeros((3, 3))
    squares = [np.full_like(w, 1e-3) for w in (weights, file_weights, moves)]
    gold = np.eye(3)[tags]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for _ in range(ROUNDS):
        at = np.add.reduceat(weights[flat], starts)[ids]
        scores = at[:, :, 0] + file_weights[traits].sum(1)[:, None]
        scores[:, 1:] += at[:, :-1, 1]
        scores[:, 2:] += at[:, :-2, 2]
        scores[:, :-1] += at[:, 1:, 3]
        marginals, move_marginals = _expected(scores, moves)
        error = gold - marginals
        roles = [
            _summed(ids, error, len(words)),
            _summed(ids[:, :-1], error[:, 1:], len(words)),
            _summed(ids[:, :-2], error[:, 2:], len(words)),
            _summed(ids[:, 1:], error[:, :-1], len(words)),
        ]
        by_feature = [_summed(flat, r[owner], len(features)) for r in roles]
        in_file = np.repeat(error.sum(1)[:, None], traits.shape[1], axis=1)
        gradients = [
            np.stack(by_feature, axis=1),
            _summed(traits, in_file, len(files)),
            gold_moves - move_marginals,
        ]
        for w, g, s in zip((weights, file_weights, moves), gradients, squares):
            g = g / len(rows) - PENALTY * w
            s += g * g
            w += RATE * g / np.sqrt(s)
    by_name = {f: weights[i] for f, i in features.items()}
    return Model(by_name, {f: file_weights[i] for f, i in files.items()}, moves)


def _summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` (…, 3) summed by index."""
    index = index.ravel()
    columns = [np.bincount(index, values[..., k].ravel(), size) for k in range(values.shape[-1])]
    return np.stack(columns, axis=1)


def _expected(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tags and summed marginals of transitions, by forward and backward sums."""
    size = scores.shape[1]
    ahead, behind = scores.copy(), np.zeros_like(scores)
    for t in range(1, size):
        ahead[:, t] += np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1)
    for t in range(size - 2, -1, -1):
        behind[:, t] = np.logaddexp.reduce(moves + (scores + behind)[:, t + 1, None, :], axis=2)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    pairs = np.zeros((3, 3))
    for t in range(size - 1):
        pair = ahead[:, t, :, None] + moves + (scores + behind)[:, t + 1, None, :]
        pairs += np.exp(pair - total[:, None, None]).sum(0)
    return np.exp(ahead + behind - total[:, None, None]), pairs


def spans(text: Column, model: Model | None) -> Column:
    """``SPANS`` of a text column in code points, by start and then kind as in ``KINDS``.

    A null or empty text has none.  Rows are independent, so repeated rows, null ids and
    other columns do not matter.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(model)
        try:
            for texts in batches:
                rows = [
                    [{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t.as_py())] for t in texts
                ]
                yield pa.array(rows, pa.list_(kind))
        finally:
            del scanner
            give_back()

    return find(whole_text(text))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, lists):
            if text is None or some is None or not len(some):
                out.append(text)
                continue
            parts, done = [], 0
            for span in some:
                if span["start"] >= done:
                    parts += [text[done : span["start"]], mark]
                done = max(done, span["end"])
            out.append("".join(parts) + text[done:])
        return pd.Series(out, dtype=object)

    return cut(text, found)
