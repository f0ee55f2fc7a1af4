"""Repeated passages: every byte that lies in a string of some length found elsewhere too.

Strings that are equal share the least of their hashed grams, so the strings of a text
fall into runs by that gram, and all copies of a string lie in the runs of one gram.
Grams met once, in a run that does not repeat itself, are settled; so are grams whose
runs are all the same bytes.  For the others, one copy of each distinct run is sorted
with the runs of the same gram by a suffix array, in which equal strings are neighbours.

The array is built by linear grouping: suffixes are grouped by their Lyndon prefixes, the
groups being processed in descending order while each group sorts the previous smaller
suffixes of its members, and one ascending pass then emits the order of every group.  Its
symbols are words, ranked by their bytes, and bytes where words are long; a string that
starts within a word is told by the bytes before its first whole word.

A gram with more distinct runs than one task should hold has them cut into runs of a
longer gram, of which few are met twice.  Where even such a gram has too many runs, their
strings are counted one by one, with partial counts before the shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reqsift.llm.common import give_back, whole_text
from reqsift.workspace import materialize

#: Distinct runs of one gram that are sorted together, and bytes sorted in one go.
RUNS, BATCH = 20_000, 1 << 20
#: Bytes of text whose grams are hashed in one go.
CHUNK = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_WORDS = re.compile(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order, in linear time after grouping by symbol."""
    n = len(symbols)
    values = np.asarray(symbols, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if n else np.zeros(0, np.int64)
    width = np.diff(np.append(heads, n))
    start_of, place_of = np.empty(n, np.int64), np.empty(n, np.int64)
    start_of[order], place_of[order] = np.repeat(heads, width), np.arange(n)
    stops = np.zeros(n + 1, np.int64)
    stops[heads] = heads + width
    slots, start, place, stop = order.tolist(), start_of.tolist(), place_of.tolist(), stops.tolist()

    smaller = [-1] * n  # the previous smaller suffix, known once a suffix's group is done
    done = bytearray(n)
    end = n
    while end:
        first = start[slots[end - 1]]
        if end - first == 1:
            s = slots[first]
            end = first
            done[s] = 1
            p = s - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[s] = p
            # The parent moves to the top of its group, where it is a group of its own.
            if p >= 0:
                a = start[p]
                last = stop[a] - 1
                if last > a:
                    other, at = slots[last], place[p]
                    slots[at], place[other] = other, at
                    slots[last], place[p] = p, last
                    stop[a], start[p], stop[last] = last, last, last + 1
            continue
        group = slots[first:end]
        group.sort()
        end = first
        for s in group:
            done[s] = 1
        times: dict[int, int] = {}
        for s in group:
            p = s - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if len(times) == len(group):
            levels = [list(times)]
        else:
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            # The more often the group follows, the larger is the suffix.
            levels = [by_times[k] for k in sorted(by_times, reverse=True)]
        for level in levels:
            before: dict[int, int] = {}
            for p in level:
                a = start[p]
                last = stop[a]
                if a not in before:
                    before[a] = last
                last -= 1
                other, at = slots[last], place[p]
                slots[at], place[other] = other, at
                slots[last], place[p] = p, last
                stop[a] = last
            ends = {a: stop[a] for a in before}
            for p in level:
                start[p] = ends[start[p]]
            for a, new in ends.items():
                stop[new] = before[a]

    out, free, p = [-1] * n, list(range(n)), n - 1
    todo = bytearray(b"\x01") * n
    for i in range(n + 1):
        while p >= 0 and todo[p]:
            todo[p] = 0
            head = start[p]
            out[free[head]] = p
            free[head] += 1
            p = smaller[p]
        if i < n:
            p = out[i] - 1
    return out


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (a ufunc) over every window of ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def gram_lengths(length: int) -> tuple[int, int]:
    """Powers of two for strings of ``length``: up to 32 with several grams each, and the largest."""
    return 1 << min(5, max(0, (length // 2).bit_length() - 1)), 1 << (length.bit_length() - 1)


class Runs:
    """The runs of one piece of joined texts: strings of ``length`` bytes with the same least
    gram of ``size`` bytes.

    ``low`` and ``high`` are the first and last start of a run, ``gram`` its key, ``again``
    whether one of its strings may occur twice in it.
    """

    def __init__(self, joined: np.ndarray, begins: np.ndarray, length: int, size: int):
        width = length - size + 1
        grams = _mix(joined.astype(np.uint64) + _A)
        have = 1
        while have < size:
            grams = _mix(grams[:-have] * _A + grams[have:] * _B)
            have *= 2
        least = _slide(grams, width, np.minimum)
        count = len(least)
        text = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(joined))))
        inside = text[:count] == text[length - 1 :]
        new = np.ones(count, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:count] != text[: count - 1]) | ~inside[:-1]
        self.low = np.flatnonzero(new & inside)
        bounds = np.append(np.flatnonzero(new | ~inside), count)
        self.high = bounds[np.searchsorted(bounds, self.low, "right")] - 1
        self.gram = least[self.low].view(np.int64)
        self.text = text[self.low]
        # A gram that is least of a string and comes again before the run ends.
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        at = np.flatnonzero(grams == _slide(padded, width, np.maximum))
        twice = np.zeros(len(at) + 1, np.int64)
        if len(at) > 1:
            near = (grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] <= width)
            twice[1 : len(at)] = np.cumsum(near)
        begin = np.searchsorted(at, self.low)
        last = np.searchsorted(at, self.high + width) - 1
        self.again = twice[np.maximum(last, begin)] > twice[begin]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes


def repeated_starts(parts: list[bytes], several: list[bool], length: int) -> list[np.ndarray]:
    """Per part: whether the string at each of its starts is at another start of any part too.

    A part that stands for ``several`` equal ones repeats all its strings.
    """
    joined, begins = _joined(parts)
    total = len(joined)
    sizes = np.diff(np.append(begins, total))
    part = np.repeat(np.arange(len(parts)), sizes)
    stops = (begins + sizes)[part]
    words = [_WORDS.findall(p) for p in parts]
    longest = max(max(map(len, w)) for w in words)
    by_byte = longest > min(64, length // 2)
    ends_word = np.ones(total, dtype=bool) if by_byte else _BLANKS[joined]

    # One symbol 0 after each part keeps apart what follows.
    if by_byte:
        lengths = np.ones(total, np.int64)
        symbols = [c for p in parts for c in (*(b + 1 for b in p), 0)]
        per_part = sizes
    else:
        rank = {w: i for i, w in enumerate(sorted({x for w in words for x in w}), 1)}
        symbols = [c for w in words for c in (*map(rank.__getitem__, w), 0)]
        lengths = np.fromiter((len(x) for w in words for x in w), np.int64)
        per_part = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    # Symbol numbers count the separators; ``own`` is the symbol of each word.
    own = np.arange(len(starts)) + np.repeat(np.arange(len(parts)), per_part)
    at = np.full(len(symbols), -1, np.int64)
    at[own] = starts
    suffixes = at[np.asarray(suffix_order(symbols), np.int64)]
    suffixes = suffixes[suffixes >= 0]
    place = np.full(total + 1, -1, np.int64)
    place[suffixes] = np.arange(len(suffixes))

    # Bytes that neighbours in the array share, up to the ends of their parts.
    padded = np.concatenate([joined, np.zeros(length, np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, length)
    shared = np.zeros(len(suffixes), np.int64)
    for i in range(1, len(suffixes), 1 << 14):
        one, two = suffixes[i - 1 : i - 1 + (1 << 14)], suffixes[i : i + (1 << 14)]
        one = one[: len(two)]
        differ = views[one] != views[two]
        some = differ.any(1)
        common = np.where(some, differ.argmax(1), length)
        room = np.minimum(stops[one] - one, stops[two] - two)
        shared[i : i + len(two)] = np.minimum(common, room)

    # A string starting at i is told by the bytes up to its first word start and by what
    # the array has for the rest.
    bound = np.where(ends_word, np.arange(1, total + 1), total + length)
    bound = np.minimum.accumulate(bound[::-1])[::-1]
    offset = bound - np.arange(total)
    starting = np.arange(total) + length <= stops
    by_offset = np.argsort(offset, kind="stable")
    cuts = np.searchsorted(offset[by_offset], np.arange(1, length + 1))
    before = np.zeros(total + 1, np.uint64)
    rest = np.zeros(total, np.int64)
    for k in range(1, min(longest, length - 1) + 1 if not by_byte else 2):
        here = by_offset[cuts[k - 1] : cuts[k]]
        if not len(here):
            continue
        follows = before[here + 1] if k > 1 else np.uint64(0)
        before[here] = _mix(follows * _A + joined[here].astype(np.uint64) + _B)
        here = here[starting[here]]
        rest[here] = np.cumsum(shared < length - k)[place[here + k]]
    wanted = np.flatnonzero(starting)
    keys = np.stack([before[wanted], rest[wanted].astype(np.uint64), offset[wanted].astype(np.uint64)])
    order = np.lexsort(keys)
    ranked = keys[:, order]
    equal = (ranked[:, 1:] == ranked[:, :-1]).all(0)
    double = np.zeros(len(order), dtype=bool)
    double[1:] |= equal
    double[:-1] |= equal
    found = np.zeros(total, dtype=bool)
    found[wanted[order]] = double
    found |= np.asarray(several, dtype=bool)[part]
    return [found[b : b + max(0, n - length + 1)] for b, n in zip(begins.tolist(), sizes.tolist())]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each stretch of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _table(columns: dict[str, list | np.ndarray], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in kinds.items()], names=list(kinds))


def _runs(texts: DataFrame, length: int, size: int) -> DataFrame:
    """``(c1, c2, low, high, gram, run, again, times)`` of every text ``(c1, c2, bytes, times)``;
    ``run`` hashes the bytes of the run."""
    kinds = {
        "c1": pa.int64(), "c2": pa.int64(), "low": pa.int32(), "high": pa.int32(),
        "gram": pa.int64(), "run": pa.int64(), "again": pa.bool_(), "times": pa.int32(),
    }

    def found(held: list[tuple]) -> pa.RecordBatch:
        import xxhash

        joined, begins = _joined([h[2] for h in held])
        runs = Runs(joined, begins, length, size)
        buffer, digest = memoryview(joined), xxhash.xxh3_64_intdigest
        bounds = zip(runs.low.tolist(), (runs.high + length).tolist())
        hashed = np.fromiter((digest(buffer[a:b]) for a, b in bounds), np.uint64, len(runs.low))
        c1, c2, times = (np.asarray([h[k] for h in held], np.int64)[runs.text] for k in (0, 1, 3))
        begin = begins[runs.text]
        return _table(
            {
                "c1": c1, "c2": c2, "low": runs.low - begin, "high": runs.high - begin,
                "gram": runs.gram, "run": hashed.view(np.int64), "again": runs.again, "times": times,
            },
            kinds,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for c1, c2, text, times in zip(*(c.to_pylist() for c in batch.columns)):
                if len(text) >= length:
                    held.append((c1, c2, text, times))
                    total += len(text)
                if total >= CHUNK:
                    yield found(held)
                    held, total = [], 0
        if held:
            yield found(held)

    schema = "c1 long, c2 long, low int, high int, gram long, run long, again boolean, times int"
    return texts.select("c1", "c2", "bytes", "times").mapInArrow(work, schema)


def _cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(gram, run, several, part)`` with the bytes of one copy of each wanted run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = {"gram": [], "run": [], "several": [], "part": []}
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key in seen:
                    continue
                seen.add(key)
                text = batch.column(2)[i].as_py()
                for run in batch.column(3)[i].as_py():
                    out["gram"].append(run["gram"])
                    out["run"].append(run["run"])
                    out["several"].append(run["several"])
                    out["part"].append(text[run["low"] : run["stop"]])
            yield _table(out, {"gram": pa.int64(), "run": pa.int64(), "several": pa.bool_(), "part": pa.binary()})

    of = wanted.groupBy("c1", "c2").agg(
        F.collect_list(F.struct("gram", "run", "several", "low", "stop")).alias("runs")
    )
    joined = texts.join(of, ["c1", "c2"]).select("c1", "c2", "bytes", "runs", "doc_id")
    return joined.mapInArrow(work, "gram long, run long, several boolean, part binary")


def _sorted_repeats(parts: DataFrame, length: int) -> DataFrame:
    """``(gram, run, first, last)``: stretches of starts in a run whose strings occur again."""
    kinds = {"gram": pa.int64(), "run": pa.int64(), "first": pa.int32(), "last": pa.int32()}

    def found(held: list[tuple]) -> pa.RecordBatch:
        # Copies of a run that several tasks cut out are one.
        held = list({h[:2]: h for h in held}.values())
        plain = [h for h in held if max(map(len, _WORDS.findall(h[3]))) <= min(64, length // 2)]
        grams = {h[0] for h in held} - {h[0] for h in plain}
        out = {k: [] for k in kinds}
        for some in ([h for h in held if h[0] not in grams], [h for h in held if h[0] in grams]):
            if not some:
                continue
            flags = repeated_starts([h[3] for h in some], [h[2] for h in some], length)
            for (gram, run, *_), flag in zip(some, flags):
                for first, last in _ranges(flag):
                    for name, value in zip(kinds, (gram, run, first, last)):
                        out[name].append(value)
        return _table(out, kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BATCH and held[-1][0] != row[0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield found(held)
        del held
        give_back()

    grouped = parts.repartition("gram").sortWithinPartitions("gram")
    return grouped.mapInArrow(work, "gram long, run long, first int, last int")


def _counted_repeats(parts: DataFrame, length: int) -> DataFrame:
    """As ``_sorted_repeats``, by counting single strings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, run, several, part in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(part) - length + 1
                raw = b"".join(hashlib.blake2b(part[i : i + length], digest_size=16).digest() for i in range(n))
                k1, k2 = np.frombuffer(raw, "<i8").reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, gram)), pa.array(np.full(n, run)), pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(np.full(n, 2 if several else 1)), pa.array(k1.copy()), pa.array(k2.copy()),
                    ],
                    names=["gram", "run", "at", "times", "k1", "k2"],
                )

    strings = parts.select("gram", "run", "several", "part").mapInArrow(
        work, "gram long, run long, at int, times long, k1 long, k2 long"
    )
    often = strings.groupBy("k1", "k2").agg(F.sum("times").alias("all")).filter("all > 1")
    return strings.join(often, ["k1", "k2"]).select("gram", "run", F.col("at").alias("first"), F.col("at").alias("last"))


def _repeats(texts: DataFrame, length: int, sizes: tuple[int, ...]) -> DataFrame:
    """``(c1, c2, first, last)``: stretches of starts, in each of ``texts(c1, c2, bytes, times, …)``,
    whose strings occur again; ``sizes`` are the gram lengths to go through."""
    runs = materialize(_runs(texts, length, sizes[0]))
    grams = runs.groupBy("gram").agg(
        F.sum("times").alias("all"), F.min("run").alias("one"), F.max("run").alias("two"), F.max("again").alias("again"),
    ).filter("all > 1 or again")
    mixed = (F.col("one") != F.col("two")) | F.col("again")
    open_ = materialize(runs.drop("again").join(grams.select("gram", mixed.alias("mixed")), "gram"))
    settled = open_.filter(~F.col("mixed")).select("c1", "c2", F.col("low").alias("first"), F.col("high").alias("last"))
    unsettled = open_.filter("mixed").drop("mixed")

    distinct = unsettled.groupBy("gram", "run").agg(
        (F.sum("times") > 1).alias("several"), F.min(F.struct("c1", "c2", "low", "high")).alias("copy")
    )
    many = distinct.groupBy("gram").agg((F.count("*") > RUNS).alias("many"))
    wanted = materialize(
        distinct.join(many, "gram").select(
            "gram", "run", "several", "copy.c1", "copy.c2", "copy.low",
            (F.col("copy.high") + length).alias("stop"), "many",
        )
    )
    repeats = _sorted_repeats(_cut(texts, wanted.filter("not many")), length)
    crowded = wanted.filter("many")
    if not crowded.isEmpty():
        repeats = repeats.unionByName(_crowded_repeats(_cut(texts, crowded), length, sizes[1:]))
    found = unsettled.join(repeats, ["gram", "run"]).select(
        "c1", "c2", (F.col("low") + F.col("first")).alias("first"), (F.col("low") + F.col("last")).alias("last")
    )
    return settled.unionByName(found)


def _crowded_repeats(parts: DataFrame, length: int, sizes: tuple[int, ...]) -> DataFrame:
    """As ``_sorted_repeats``, for the runs of grams that have very many."""
    # Copies of a run that several tasks cut out are one.
    parts = parts.groupBy("gram", "run").agg(F.max("several").alias("several"), F.first("part").alias("part"))
    if not sizes:
        return _counted_repeats(parts, length)
    times = F.when(F.col("several"), 2).otherwise(1)
    texts = materialize(
        parts.select(
            F.col("gram").alias("c1"), F.col("run").alias("c2"), F.lit(0).cast("long").alias("doc_id"),
            F.col("part").alias("bytes"), times.alias("times"),
        )
    )
    return _repeats(texts, length, sizes).select(F.col("c1").alias("gram"), F.col("c2").alias("run"), "first", "last")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``(doc_id, n_bytes, removed, kept)`` for every row of ``docs(doc_id, text, …)``.

    Texts are UTF-8 bytes.  A byte goes if it is covered by a string of ``length`` bytes
    that also starts at another place of the table, in the same text or another; strings
    may overlap and never cross texts.  ``removed`` lists the stretches ``(start, stop)``
    that go, in order, and ``kept`` has the bytes left, joined.

    A null text is an empty one; texts shorter than ``length`` stay as they are.  Repeated
    rows are copies of each other and all go.  Null ids are kept as ids.  Other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    text = whole_text(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(1), "text").alias("c2"), "doc_id",
        F.col("text").cast("binary").alias("bytes"), F.lit(1).alias("times"),
    )
    covers = _repeats(texts, length, gram_lengths(length)).groupBy("c1", "c2").agg(
        F.collect_set(F.struct("first", "last")).alias("covers")
    )

    @F.arrow_udf("struct<removed: array<struct<start: int, stop: int>>, kept: binary>")
    def without(raw: pa.Array, covers: pa.Array) -> pa.Array:
        out = []
        for data, strings in zip(raw, covers):
            data, strings = data.as_py(), strings.as_py() or []
            spans: list[list[int]] = []
            for a, b in sorted((s["first"], s["last"] + length) for s in strings):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append({"removed": [{"start": a, "stop": b} for a, b in spans], "kept": kept})
        kind = pa.struct([
            ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.binary()),
        ])
        return pa.array(out, kind)

    done = texts.join(covers, ["c1", "c2"], "left").select(
        "doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), without("bytes", "covers").alias("done")
    )
    return done.select("doc_id", "n_bytes", "done.removed", "done.kept")
