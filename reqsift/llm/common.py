"""What the operators of this subpackage share: columns, word rules, per-process memory."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: what separates words (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_ASCII_LOWER = {ord(u): low for u, low in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda would otherwise be computed again for every
    element that the lambda visits.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(text: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; none of an empty text."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def id_text(doc_id: Column) -> Column:
    """A document id as text; a null id counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text."""
    return F.pmod(F.crc32(id_text(doc_id)), F.lit(folds))


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def per_process(key: tuple, make: Callable[[], Any], most: int = 2) -> Any:
    """``make()`` once per Python worker process, kept for its later tasks.

    Functions reach the workers by value, so their module's globals do not last
    from task to task; a module entry of the process does.  Only the ``most`` last used
    are kept, so a worker that serves one stage after another does not fill up.  What a
    value remembers of the texts it has seen, its user drops when the task ends.
    """
    home = sys.modules.get("_reqsift_process_memory")
    if home is None:
        home = sys.modules["_reqsift_process_memory"] = types.ModuleType("_reqsift_process_memory")
        home.kept = {}
    value = home.kept.pop(key) if key in home.kept else make()
    home.kept[key] = value
    while len(home.kept) > most:
        del home.kept[next(iter(home.kept))]
    return value


def give_back() -> None:
    """Hand memory that a task no longer needs back to the system, as its worker lives on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Memo(dict):
    """A memory of ``make(word)``, bounded in bytes; old entries fall out in two generations.

    It only saves time: a forgotten entry is made again with the same value.  Long words
    seldom come again and are not remembered.
    """

    #: About what an entry takes besides its letters and its value's bytes.
    ENTRY = 200

    def __init__(self, make: Callable[[str], Any], room: int = 32 << 20, longest: int = 100):
        super().__init__()
        self.make, self.room, self.longest = make, room, longest
        self.old, self.used = {}, 0

    def __missing__(self, word: str) -> Any:
        value = self.old.get(word)
        return self.put(word, self.make(word) if value is None else value)

    def put(self, word: str, value: Any) -> Any:
        if len(word) <= self.longest:
            if self.used >= self.room:
                self.old, self.used = dict(self), 0
                self.clear()
            self[word] = value
            self.used += self.ENTRY + len(word) + (len(value) if isinstance(value, bytes) else 0)
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.used = {}, 0
