"""Packing tokens into windows by minimum bin slack.

A document's ids, with the end id after them, fill whole windows as far as they go; the rest of
fewer than a window's ids is an item. A window takes the longest item left, and a subset-sum
dynamic programme over the multiset of the other items' lengths picks those that come closest to
the capacity: a Python integer is the bitset of reachable sums, a length that is held c times is
shifted in by powers of two, and the counts of each length are found by going back through the
bitsets. The programme stops as soon as the window is exactly full. If the best sum leaves a gap,
every item left is longer than the gap, and the shortest of them is cut to close it. So only the
last window of an input partition is short.

Each partition packs its own rows as they pass: no shuffle, no order of the documents, and memory
bounded by ``pool`` items. A retried task writes all its windows anew.
"""

from __future__ import annotations

import sys
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facility_insights.llm.shared import batches, worker_state

#: Bytes of one id in the packed output: little-endian unsigned 32-bit.
ID_BYTES = 4
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: ASCII marks: a run of them is one pre-token.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _byte_characters() -> list[str]:
    """How byte-level vocabularies write a byte: printable Latin-1 as itself, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [c for c in range(256) if c not in plain]
    return [chr(c) if c in plain else chr(256 + others.index(c)) for c in range(256)]


_BYTE_CHARS = _byte_characters()


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else b"".join(i.to_bytes(ID_BYTES, "little") for i in ids)


#: Whether this machine's unsigned int is the output's format.
_NATIVE = sys.byteorder == "little" and array("I").itemsize == ID_BYTES


class WordIds:
    """Ids of whole texts, word by word.

    The vocabulary's pre-tokenizer drops white space and never joins what it parts, so a text's ids
    are those of its words in order. Words are cut at blanks and line ends only, which are white
    space to every Unicode version, and each distinct word is looked up once and kept, up to a
    fixed number of words.
    """

    def __init__(self, path: str, remember: int = 700_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.remember, self.known = remember, {"": b""}

    def _word(self, word: str) -> bytes:
        if "<|" in word:  # may hold a special token's string
            return _packed(self.whole.encode(word, add_special_tokens=False).ids)
        head = word.rstrip(_MARKS)
        if word.isascii() and not head and word.isprintable():
            return self._piece(word)
        if head.isalpha() and max(head) < "\u0100":
            low, tail = head.lower(), word[len(head) :]
            ids = self.known.get(low)
            if ids is None:
                ids = self.known[low] = self._piece("".join(map(_BYTE_CHARS.__getitem__, low.encode())))
            if tail and tail not in self.known:
                self.known[tail] = self._piece(tail)
            return ids + self.known[tail] if tail else ids
        plain = self.whole.normalizer.normalize_str(word)
        return b"".join(self._piece(piece) for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(plain))

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, its bytes written as the vocabulary's byte characters."""
        return _packed([t.id for t in self.whole.model.tokenize(piece)])

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the text, without special tokens."""
        found = (text or "").replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in found])
        except KeyError:
            distinct = set(found)
            if len(known) + len(distinct) > self.remember:
                known.clear()
                known[""] = b""
            for w in distinct:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in found])


class Pool:
    """Items by length: (doc_id, start, ids, doc_tokens)."""

    def __init__(self):
        self.by_length: dict[int, deque] = {}
        self.lengths: list[int] = []
        self.items = self.ids = 0

    def put(self, item: tuple) -> None:
        size = len(item[2]) // ID_BYTES
        if size not in self.by_length:
            self.by_length[size] = deque()
            insort(self.lengths, size)
        self.by_length[size].append(item)
        self.items += 1
        self.ids += size

    def take(self, size: int) -> tuple:
        held = self.by_length[size]
        item = held.popleft()
        self.items -= 1
        self.ids -= size
        if not held:
            del self.by_length[size]
            self.lengths.pop(bisect_left(self.lengths, size))
        return item


def closest(sizes: Sequence[int], counts: Sequence[int], target: int) -> list[tuple[int, int]]:
    """(size, how many) whose sum is the largest that is reachable within the target.

    Sizes are distinct; each may be taken up to its count. Bit s of ``reach`` says that s is a sum.
    """
    mask, reach, layers = (1 << (target + 1)) - 1, 1, []
    for size, count in zip(sizes, counts, strict=True):
        if reach >> target & 1:
            break
        before, left, step = reach, min(count, target // size), 1
        while left > 0:
            now = min(step, left)
            reach |= (reach << (now * size)) & mask
            left -= now
            step *= 2
        layers.append((size, before))
    at, taken = reach.bit_length() - 1, []
    for size, before in reversed(layers):
        used = 0
        while not before >> at & 1:
            at -= size
            used += 1
        if used:
            taken.append((size, used))
    return taken


def fill(pool: Pool, capacity: int) -> list[tuple]:
    """The items of the next window, removed from the pool; the last one may be the cut-off start of an item."""
    window = [pool.take(pool.lengths[-1])]
    room = capacity - len(window[0][2]) // ID_BYTES
    if room:
        sizes = pool.lengths[: bisect_right(pool.lengths, room)][::-1]
        for size, used in closest(sizes, [len(pool.by_length[s]) for s in sizes], room):
            window += [pool.take(size) for _ in range(used)]
            room -= size * used
    if room and pool.items:
        doc, start, ids, total = pool.take(pool.lengths[0])
        window.append((doc, start, ids[: room * ID_BYTES], total))
        pool.put((doc, start + room, ids[room * ID_BYTES :], total))
    return window


def windows(documents: Iterable[tuple], capacity: int, pool_items: int) -> Iterator[list[tuple]]:
    """Windows of (doc_id, start, ids, doc_tokens) out of (doc_id, ids)."""
    pool, wide = Pool(), capacity * ID_BYTES
    for doc, ids in documents:
        total = len(ids) // ID_BYTES
        whole = len(ids) // wide
        for k in range(whole):
            yield [(doc, k * capacity, ids[k * wide : (k + 1) * wide], total)]
        if len(ids) > whole * wide:
            pool.put((doc, whole * capacity, ids[whole * wide :], total))
        if pool.items >= pool_items:
            while pool.items > pool_items // 2 and pool.ids >= capacity:  # enough to fill one to the last id
                yield fill(pool, capacity)
    while pool.items:
        yield fill(pool, capacity)


def pack(docs: DataFrame, *, path: str, capacity: int = 2048, end_id: int = 1, pool: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit integers. A sequence is at most ``capacity`` ids; its
    pieces' offsets run from 0 without gaps. Null and empty texts have the end id alone. A null
    doc_id stays null, repeated rows are packed each, other columns are not looked at, and an empty
    table gives no piece. sequence_id is the task's partition and a number in it.
    """
    of = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    end = end_id.to_bytes(ID_BYTES, "little")

    def run(rows):
        ids = worker_state("word ids", path, lambda: WordIds(path))
        first = TaskContext.get().partitionId() << 40
        documents = ((doc, ids.encode(text) + end) for b in rows for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

        def pieces():
            for number, window in enumerate(windows(documents, capacity, pool)):
                offset = 0
                for doc, start, held, total in window:
                    size = len(held) // ID_BYTES
                    yield doc, start, size, held, total, first + number, offset
                    offset += size

        yield from batches(pieces(), SCHEMA, weight=lambda p: len(p[3]) + 48, most=4 << 20)

    return of.mapInArrow(run, DDL)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids: ids_crc32, unsigned."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
