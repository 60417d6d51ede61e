"""Byte-level BPE by overlapping chunks.

A text of more than one chunk's characters is cut into chunks that overlap. Chunks are split into
pre-tokens side by side, each from its own first character, so a chunk may begin inside a pre-token.
A match depends only on what comes from its first character on; so once two neighbours have a
boundary at the same place, they agree from there on. The first such place in the overlap is where they
are stitched. The cutter makes the overlap long enough: it ends behind a character that is followed by
white space, and the pattern never matches both at once, so that place is a boundary in either chunk.
Pre-tokens between two stitches are then encoded, chunk by chunk, and a text's ids put in order.

Shorter texts are one chunk, which has nothing to be stitched to. Equal long texts are encoded once and
joined back to their rows. The distinct pre-tokens that a Python worker has met are kept with their
ids, up to a fixed number.

Null texts count as empty; empty texts have no ids. Each input row gives one row, repeated rows and rows
without an id too; other columns are left out. Decoding puts the bytes of the ids one after another.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facility_insights.llm.shared import batches, worker_state
from facility_insights.session import scratch_path

#: Characters of a chunk; its overlap with the next one comes on top.
CHUNK = 1 << 16
#: Distinct pre-tokens that a worker keeps, and the longest that it keeps.
REMEMBER, LONGEST = 300_000, 64
#: Ids of one Arrow batch, about.
BATCH_IDS = 500_000

#: A match is sure if so many characters behind it are known: the pattern looks two ahead at most.
_AHEAD = 2
_PLACE = regex.compile(r"\S\s")
#: One character for each class that the pattern names; none begins or ends a contraction.
_SAMPLES = {r"\p{L}": "é", r"\p{N}": "7", r"\s": "\t"}
_OTHER = "#"


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a line for each token, its bytes in base 64 and its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=1)
def _foreign() -> tuple[tuple[int, int, str], ...]:
    """Runs of characters (first, last, sample) whose class is another one to the tokenizer's library than to `regex`.

    The two know different Unicode versions. In such characters' place the pattern is shown a sample
    of the class that the tokenizer's library gives them.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    found: dict[int, str] = {}
    for name, sample in _SAMPLES.items():
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        found |= {ord(c): sample for c in theirs - ours}
        for c in ours - theirs:
            found.setdefault(ord(c), _OTHER)
    runs: list[tuple[int, int, str]] = []
    for c in sorted(found):
        if runs and runs[-1][1] == c - 1 and runs[-1][2] == found[c]:
            runs[-1] = (runs[-1][0], c, found[c])
        else:
            runs.append((c, c, found[c]))
    return tuple(runs)


class Splitter:
    """Pre-tokens of a text by a pattern."""

    def __init__(self, pattern: str, foreign: Iterable[tuple[int, int, str]]):
        self.pattern = regex.compile(pattern)
        self.shown = {c: sample for first, last, sample in foreign for c in range(first, last + 1)}

    def split(self, text: str) -> list[str]:
        if self.shown and not _latin(text) and not self.shown.keys().isdisjoint(map(ord, set(text))):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.shown))]
        return self.pattern.findall(text)

    def ends(self, text: str) -> np.ndarray:
        """Where the pre-tokens end."""
        return np.cumsum([len(p) for p in self.split(text)], dtype=np.int64)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pieces:
    """Ids of pre-tokens, each merged by itself."""

    def __init__(self, path: str, pattern: str, foreign: Iterable[tuple[int, int, str]]):
        import tiktoken

        self.splitter = Splitter(pattern, foreign)
        # this encoder's only match is the whole of what it is given
        self.merge = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> bytes:
        """32-bit ids in the machine's byte order."""
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            out = []
            for p in pieces:
                held = known.get(p)
                if held is None:
                    held = array("i", self.merge(p)).tobytes()
                    if len(known) >= REMEMBER:
                        known.clear()
                    if len(p) <= LONGEST:
                        known[p] = held
                out.append(held)
            return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.ids(self.splitter.split(text))


def _worker(path: str, pattern: str, foreign: tuple) -> Pieces:
    return worker_state("bpe", (path, pattern, foreign), lambda: Pieces(path, pattern, foreign))


def _lists(encoded: list[bytes]) -> pa.ListArray:
    sizes = np.array([0, *map(len, encoded)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32)))


def _slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows that hold about ``most`` ids or bytes."""
    first = held = at = 0
    for size in sizes:
        held, at = held + size, at + 1
        if held >= most:
            yield first, at - first
            first, held = at, 0
    if at > first:
        yield first, at - first


def cut(text: str, size: int) -> Iterator[tuple[int, int | None, str]]:
    """(lead, step, chunk): characters shared with the chunk before, characters to the next one's first."""
    start, lead, least, n = 0, 0, size, len(text)
    while True:
        following = start + least
        place = _PLACE.search(text, following) if following < n else None
        end = place.end() - 1 + _AHEAD if place else n + 1
        if end > n:
            yield lead, None, text[start:]
            return
        yield lead, following - start, text[start:end]
        # the next chunk must reach beyond this stitch before it is left itself
        start, lead, least = following, end - following, max(size, place.end() - following)


def boundaries(splitter: Splitter, lead: int, step: int | None, chunk: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, head, tail): places in the chunk, and its boundaries in either overlap, counted from the overlap's first character."""
    ends = splitter.ends(chunk)
    head = np.concatenate([[0], ends[ends <= lead]])
    if step is None:
        return ends, head, ends[:0]
    sure = ends[: np.searchsorted(ends, len(chunk) - _AHEAD, side="right")] if len(chunk) else ends
    return ends, head, sure[sure >= step] - step


CHUNKS = "key string, part int, step int, chunk string, ends array<int>, head array<int>, tail array<int>"


def _cut_rows(size: int):
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("lead", pa.int32()), ("step", pa.int32()), ("chunk", pa.string())])

    def run(rows):
        made = ((key, part, lead, step, chunk) for b in rows for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for part, (lead, step, chunk) in enumerate(cut(text, size)))
        yield from batches(made, schema, weight=lambda r: len(r[4]))

    return run


def _split_rows(pattern: str, foreign: tuple):
    ints = pa.list_(pa.int32())
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("step", pa.int32()), ("chunk", pa.string()), ("ends", ints), ("head", ints), ("tail", ints)])

    def run(rows):
        splitter = Splitter(pattern, foreign)
        made = ((key, part, step, chunk, *boundaries(splitter, lead, step, chunk)) for b in rows for key, part, lead, step, chunk in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from batches(made, schema, weight=lambda r: len(r[3]) + 4 * len(r[4]))

    return run


def _encode_chunks(path: str, pattern: str, foreign: tuple):
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(rows):
        pieces = _worker(path, pattern, foreign)

        def made():
            for b in rows:
                for key, part, first, last, chunk, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    at, found = first, []
                    for end in ends:
                        if first < end <= last:
                            found.append(chunk[at:end])
                            at = end
                    yield key, part, np.frombuffer(pieces.ids(found), dtype=np.int32)

        yield from batches(made(), schema, weight=lambda r: 4 * len(r[2]))

    return run


def long_ids(texts: DataFrame, path: str, pattern: str, chunk: int) -> DataFrame:
    """(key, ids) of (key, text) rows with distinct keys, through chunks."""
    spark, foreign = texts.sparkSession, _foreign()
    parts = texts.select("key", "text").mapInArrow(_cut_rows(chunk), "key string, part int, lead int, step int, chunk string")
    split = parts.repartition("key", "part").mapInArrow(_split_rows(pattern, foreign), CHUNKS)
    held = scratch_path(spark, "bpe-chunks")
    split.write.parquet(held)  # read for the stitches and for the texts
    split = spark.read.parquet(held)
    order = Window.partitionBy("key").orderBy("part")  # a few numbers for each chunk of one text
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    none = F.raise_error(F.lit("chunks without a common boundary: the pattern matches white space after other characters"))
    first = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.coalesce(common, none.cast("int")))
    stitches = split.select("key", "part", "step", first.alias("first"))
    stitches = stitches.withColumn("last", F.coalesce(F.col("step") + F.lead("first").over(order), F.lit(2**31 - 1))).select("key", "part", "first", "last")
    chosen = split.join(stitches, ["key", "part"]).select("key", "part", "first", "last", "chunk", "ends")
    ids = chosen.mapInArrow(_encode_chunks(path, pattern, foreign), "key string, part int, ids array<int>")
    inorder = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return ids.groupBy("key").agg(F.flatten(F.transform(inorder, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, *, path: str, pattern: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row: ids as an array of int, without special tokens.

    ``path`` is a file of ranks. ``pattern`` must be one that looks at most two characters beyond its
    match and matches no white space after another character.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    foreign = _foreign()

    def short(rows):
        pieces = _worker(path, pattern, foreign)
        for b in rows:
            for first, n in _slices(pc.binary_length(b.column(1)).to_pylist(), 2 * BATCH_IDS):
                part = b.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([pieces.encode(text) for text in part.column(1).to_pylist()])], names=["doc_id", "ids"])

    out = docs.select("doc_id").withColumn("ids", F.array().cast("array<int>")).schema
    whole = docs.where(F.char_length("text") <= chunk).mapInArrow(short, out)
    keyed = docs.where(F.char_length("text") > chunk).withColumn("key", F.sha2("text", 256))
    if keyed.isEmpty():
        return whole
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    return whole.unionByName(keyed.select("doc_id", "key").join(long_ids(texts, path, pattern, chunk), "key").select("doc_id", "ids"))


def _decoded(ids: pa.ListArray, vocabulary: pa.Array) -> pa.Array:
    """Each row's bytes; those of all ids lie one after another in the buffer of the taken tokens."""
    taken = vocabulary.take(ids.flatten())
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    places = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int32)
    ends = places[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), taken.buffers()[2]])


def _vocabulary(path: str) -> pa.Array:
    by_id = {rank: token for token, rank in ranks(path).items()}
    return pa.array([by_id.get(k) for k in range(max(by_id) + 1)], pa.binary())


def decode(encoded: DataFrame, *, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``, the bytes of their ids one after another; null ids count as none."""

    def run(rows):
        vocabulary, at = _vocabulary(path), names.index(ids_col)
        for part in _parts(rows, at):
            yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(at), vocabulary)], names=[*names, "decoded"])

    out = encoded.withColumn("decoded", F.lit(b"").cast("binary"))
    names = encoded.columns
    return encoded.mapInArrow(run, out.schema)


def digest(encoded: DataFrame, *, path: str) -> DataFrame:
    """The contract's columns from (doc_id, ids): the ids are decoded again, and both are hashed."""

    def run(rows):
        vocabulary = _vocabulary(path)
        for part in _parts(rows, 1):
            ids = part.column(1)
            offsets = pc.subtract(ids.offsets, ids.offsets[0])
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(ids.flatten(), pa.string())), " ")
            hashes = [[hashlib.sha256(v.as_buffer()).hexdigest() for v in column] for column in (joined, _decoded(ids, vocabulary))]
            yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.list_value_length(ids), pa.int64()), *map(pa.array, hashes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = encoded.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))
    return encoded.select("doc_id", "ids").mapInArrow(run, out.schema)


def _parts(rows: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about BATCH_IDS ids in their list column at ``at``."""
    for b in rows:
        for first, n in _slices(pc.fill_null(pc.list_value_length(b.column(at)), 0).to_pylist(), BATCH_IDS):
            yield b.slice(first, n)
