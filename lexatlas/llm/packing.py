"""Packing documents into sequences of fixed length: patterns by non-negative least squares, then best fit."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from lexatlas.llm.common import arrow_map, held, text_bytes
from lexatlas.session import cut

WORDS_KEPT, WORD_KEPT_BYTES = 1 << 19, 64
#: Words that one call to the tokenizer takes, and text that is split before it.
WORDS_AT_ONCE, LEARN_BYTES = 1 << 10, 1 << 20
#: Punctuation that ends a word of ASCII letters and digits is a piece of its own for the tokenizer, too: the classes of bytes for that.
MARKS, ALNUM, BLANKS = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?", b"abcdefghijklmnopqrstuvwxyz0123456789", b" \t\n\x0b\x0c\r"))
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class WordIds(dict):
    """Ids of the words of a text, as little-endian unsigned 32-bit numbers, from a tokenizer file.

    For tokenizers that lower-case, drop white space, never join across it and keep punctuation apart from
    letters, so that the ids of a text are those of its words and last marks in turn. Forgets all when full and
    never keeps long words.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        splitter = self.tokenizer.pre_tokenizer
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(WORD_KEPT_BYTES + 1)]
        #: The merges alone, where words of a-z reach them as they are; else None.
        self.merges = self.tokenizer.model if splitter and splitter.pre_tokenize_str(LETTERS) == [(LETTERS, (0, 26))] else None

    def __missing__(self, word: bytes) -> bytes:
        found = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= WORD_KEPT_BYTES:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids

    def words(self, texts: list[bytes]) -> list[list[bytes]]:
        """The words of each text; a mark between a word of ASCII letters and digits and white space is a word, too."""
        texts = [t if b"<|" in t else t.lower() for t in texts]  # special tokens are told apart by case
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        at = 2 + np.flatnonzero(ALNUM[data[:-2]] & MARKS[data[1:-1]] & BLANKS[data[2:]])
        marked = np.insert(data, at - 1, 32).tobytes()
        begins = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        begins += np.searchsorted(at, begins)
        return [marked[a:b].split() for a, b in zip(begins.tolist(), begins[1:].tolist())]

    def learn(self, words: Iterable[bytes]) -> None:
        """Take up the ids of many words: words of a-z from the merges, the others with one call for many.

        These stand in one line, and each token belongs to the word it begins in.
        """
        new = [w for w in dict.fromkeys(words) if w not in self and len(w) <= WORD_KEPT_BYTES]
        if len(self) + len(new) > WORDS_KEPT:
            self.clear()
        if self.merges:
            tokens_of, packers = self.merges.tokenize, self.packers
            for w in new:
                if w.isalpha() and w.islower():
                    ids = [t.id for t in tokens_of(w.decode())]
                    self[w] = packers[len(ids)](*ids)
        new = [w for w in new if w not in self and b"<" not in w]
        for at in range(0, len(new), WORDS_AT_ONCE):
            some = new[at : at + WORDS_AT_ONCE]
            shown = [w.decode("utf-8", "replace") for w in some]
            made = self.tokenizer.encode(" ".join(shown), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)) + 1)
            begins = np.fromiter((a for a, _ in made.offsets), np.int64, len(made.ids))
            cuts = 4 * np.concatenate([[0], np.searchsorted(begins, ends)])
            ids = np.array(made.ids, "<u4").tobytes()
            for w, a, b in zip(some, cuts.tolist(), cuts[1:].tolist()):
                self[w] = ids[a:b]

    def of_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text; words new to the worker are learnt for about LEARN_BYTES of text at a time."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= LEARN_BYTES):
                group.append(texts[at])
                size += len(texts[at])
                at += 1
            split = self.words(group)
            self.learn(chain.from_iterable(split))
            for words in split:
                yield b"".join(map(self.__getitem__, words))


def shared_words(path: str) -> WordIds:
    """One for all tasks of a Python worker, so that what it has met is kept from task to task."""
    return held((WordIds, path))[0]


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids), part and k.

    A document is its ids followed by ``end_id``, cut every ``capacity`` ids. k counts the pieces of equal
    length inside a task, part is the task; together they number the pieces of a length without a sort.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def start() -> Callable:
        words, part, seen = shared_words(path), TaskContext.get().partitionId(), Counter()

        def rows(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = defaultdict(list)
            of_row = []
            for i, ids in enumerate(words.of_all(text_bytes(batch.column("text")))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    one = ids[at : at + step]
                    length = len(one) // 4
                    of_row.append(i)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(one))
                    out["k"].append(seen[length])
                    seen[length] += 1
                    if with_ids:
                        out["ids"].append(np.frombuffer(one, "<u4").astype(np.int32))
            return dict(out) | {"id": batch.column("id").take(pa.array(of_row, pa.int32())), "part": [part] * len(of_row)}

        return rows

    more = ", ids array<int>" if with_ids else ""
    return arrow_map(source, None, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, k long{more}", start)


def full_patterns(histogram: dict[int, int], capacity: int, frequent: int) -> list[tuple[int, ...]]:
    """Multisets of one, two or three lengths of ``histogram`` that fill a sequence to the last token.

    All singles and pairs; triples of which two lengths are among the ``frequent`` most common ones.
    """
    out = [(capacity,)] if capacity in histogram else []
    out += [(x, capacity - x) for x in sorted(histogram) if x <= capacity - x and capacity - x in histogram]
    common = sorted(sorted(histogram, key=lambda x: (-histogram[x], x))[:frequent])
    triples = {tuple(sorted((x, y, capacity - x - y))) for x, y in combinations_with_replacement(common, 2) if capacity - x - y in histogram}
    return out + sorted(triples)


def nonnegative_least_squares(patterns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 500, tolerance: float = 0.01) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared distance of A x from the histogram.

    A has a row for each length and a column for each pattern; coordinate descent on the normal equations,
    until no count moves by more than ``tolerance``.
    """
    uses = [Counter(p) for p in patterns]
    holders: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for j, use in enumerate(uses):
        for length, n in use.items():
            holders[length].append((j, n))
    gram, x = np.zeros((len(patterns), len(patterns))), np.zeros(len(patterns))
    for held in holders.values():
        at, n = (np.array(v) for v in zip(*held))
        gram[np.ix_(at, at)] += np.outer(n, n)
    gradient = -np.array([sum(histogram[length] * n for length, n in use.items()) for use in uses], float)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            step = max(-x[j], -gradient[j] / gram[j, j])
            if abs(step) > tolerance / 100:
                x[j] += step
                gradient += step * gram[j]
                moved = max(moved, abs(step))
        if moved <= tolerance:
            break
    return x


class Plan:
    """Groups of equal sequences: each has a repeat count, the lengths it holds and the room that is left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: dict[int, list[list]] = defaultdict(list)  # room left -> [slots ((length, times), ...), repeats]
        self.order: list[int] = []

    def add(self, slots: tuple, repeats: int, room: int) -> None:
        if not self.rooms[room]:
            bisect.insort(self.order, room)
        self.rooms[room].append([slots, repeats])

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` documents of ``length`` into the smallest rooms that take them, then into new sequences."""
        while count:
            at = bisect.bisect_left(self.order, length)
            if at < len(self.order):
                room = self.order[at]
                slots, repeats = self.rooms[room].pop()
                if not self.rooms[room]:
                    self.order.pop(at)
            else:
                slots, repeats, room = (), -(-count * length // self.capacity) + count, self.capacity
            each = room // length
            whole = min(repeats, count // each)
            if whole:
                self.add((*slots, (length, each)), whole, room - each * length)
                count, repeats = count - whole * each, repeats - whole
            if count and repeats and count < each:
                self.add((*slots, (length, count)), 1, room - count * length)
                count, repeats = 0, repeats - 1
            if repeats and slots:
                self.add(slots, repeats, room)


def plan_sequences(histogram: dict[int, int], capacity: int, frequent: int = 16) -> list[tuple[tuple, int]]:
    """[(((length, times), ...), repeats), ...] that holds exactly the documents of ``histogram``.

    Patterns of few documents that fill a sequence get repeat counts by non-negative least squares against
    the histogram; the counts are rounded down and cut to what is there. All other documents, longest
    first, go where they leave the least room. The size of the plan depends on the number of different
    lengths, not on the number of documents.
    """
    left = {length: n for length, n in histogram.items() if n}
    plan = Plan(capacity)
    patterns = full_patterns(left, capacity, frequent)
    if patterns:
        repeats = np.floor(nonnegative_least_squares(patterns, left) + 1e-6).astype(int)
        # Patterns with the longest documents first: these are the hardest to place otherwise.
        for j in sorted(range(len(patterns)), key=lambda j: patterns[j][::-1], reverse=True):
            use = Counter(patterns[j])
            if n := min([int(repeats[j]), *(left[x] // t for x, t in use.items())]):
                plan.add(tuple(sorted(use.items(), reverse=True)), n, 0)
                for x, t in use.items():
                    left[x] -= n * t
    for length in sorted(left, reverse=True):
        plan.best_fit(length, left[length])
    return [(slots, n) for room in sorted(plan.rooms) for slots, n in plan.rooms[room]]


def pack_documents(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is one piece with only ``end_id``. Rows that repeat an id are packed as documents of their own; a null
    id stays null; no rows give no rows; other columns are not read.

    The driver sees only the histogram of lengths (``capacity`` numbers) and the plan made from it.
    Pieces of a length are numbered by task and order inside the task, and find their sequence in the
    plan by that number.
    """
    pieces = cut(tokenized_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids))
    counts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    rows, base = [], 0
    next_rank: Counter = Counter()
    for slots, repeats in plan_sequences(histogram, capacity):
        offset = 0
        for length, times in slots:
            rows.append((length, next_rank[length], base, times, offset))
            next_rank[length] += repeats * times
            offset += length * times
        base += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = table[:, 0] * (1 << 48) + table[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((keys, table))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batch: pa.RecordBatch) -> dict:
        keys, table = shared.value
        length = batch.column("length").to_numpy()
        rank = batch.column("first").to_numpy() + batch.column("k").to_numpy()
        slot = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
        at = rank - slot[:, 1]
        out = {c: batch.column(c) for c in batch.schema.names if c not in ("first", "k", "part")}
        return out | {"sequence_id": slot[:, 2] + at // slot[:, 3], "offset": slot[:, 4] + at % slot[:, 3] * length}

    numbered = pieces.join(starts, ["length", "part"])
    kinds = dict(numbered.dtypes)
    columns = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return arrow_map(numbered, place, schema).withColumnRenamed("id", id_col)
