"""Byte-level BPE: merges by a priority queue over a linked list of symbols; decoding by concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers.pre_tokenizers import ByteLevel

from lexatlas.llm.common import arrow_map, held

# How byte-level vocabularies split a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Scripts whose newest letters the two libraries class by different Unicode versions.
NEWER_SCRIPTS = "[԰-῿⁰-\U0010ffff]"
#: The characters outside them.
OLDER_SCRIPTS = (*range(0x0530), *range(0x2000, 0x2070))
PIECES_KEPT, PIECE_KEPT_CHARS = 1 << 18, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def older_pieces() -> re.Pattern:
    """``PIECES`` over OLDER_SCRIPTS with the classes of characters written out: the same pieces in less than half the time."""
    blank = regex.compile(r"\p{White_Space}")
    kind = {c: "W" if blank.match(chr(c)) else unicodedata.category(chr(c))[0] for c in OLDER_SCRIPTS}
    letters, numbers, blanks = ("".join(f"\\U{c:08x}" for c in OLDER_SCRIPTS if kind[c] == k) for k in "LNW")
    classes = {r"[^\p{White_Space}\p{L}\p{N}]": f"[^{blanks}{letters}{numbers}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]", r"\p{White_Space}": f"[{blanks}]", r"\P{White_Space}": f"[^{blanks}]"}
    pattern = PIECES
    for name, written in classes.items():
        pattern = pattern.replace(name, written)
    return re.compile(pattern)


class BytePairCoder:
    """Encodes and decodes with a vocabulary file of a byte-level BPE tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_letters()
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in self.id_of.items()} | {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        #: left id * size + right id -> rank, and the merged id of every rank
        self.size = 1 + max(self.bytes_of)
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks[self.id_of[a] * self.size + self.id_of[b]] = rank
            self.merged.append(self.id_of[a + b])
        self.pieces = older_pieces()
        self.newer = regex.compile(NEWER_SCRIPTS)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=True)
        #: Pieces met lately, and those met before them.
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece.

        Symbols form a list with links to both neighbours; the queue holds rank * n + place of the left symbol of every
        pair that can merge. An entry is stale, and skipped, when the pair at its place has another rank by now.
        """
        n, size = len(word), self.size
        rank_of, merged_of = self.ranks.get, self.merged
        symbol = [self.byte_ids[b] for b in word]
        queue = [rank * n + i for i in range(n - 1) if (rank := rank_of(symbol[i] * size + symbol[i + 1])) is not None]
        if not queue:
            return symbol
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            rank, left = divmod(heapq.heappop(queue), n)
            right = after[left]
            if right >= n or symbol[left] < 0 or rank_of(symbol[left] * size + symbol[right]) != rank:
                continue
            symbol[left], symbol[right] = merged_of[rank], -1
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                if (rank := rank_of(symbol[left] * size + symbol[beyond])) is not None:
                    heapq.heappush(queue, rank * n + left)
            if (place := before[left]) >= 0 and (rank := rank_of(symbol[place] * size + symbol[left])) is not None:
                heapq.heappush(queue, rank * n + place)
        return [s for s in symbol if s >= 0]

    def _piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                ids = tuple(self.merge(piece.encode()))
                found = ids, ",".join(map(str, ids))
            if len(piece) <= PIECE_KEPT_CHARS:
                if len(self.known) >= PIECES_KEPT:
                    self.known, self.older = {}, self.known
                self.known[piece] = found
        return found

    def split(self, text: str) -> list[str]:
        if not text.isascii() and self.newer.search(text):
            return [text[i:j] for _, (i, j) in self.byte_level.pre_tokenize_str(text)]
        return self.pieces.findall(text)

    def coded(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """(ids, ids as text) of the pieces, added tokens standing for themselves."""
        if self.special is None or not self.special.search(text):
            known = self.known
            return [known.get(p) or self._piece(p) for p in self.split(text)]
        out: list[tuple[tuple[int, ...], str]] = []
        for part in self.special.split(text):
            if part in self.added:
                out.append(((self.added[part],), str(self.added[part])))
            else:
                out += [self._piece(p) for p in self.split(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.coded(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def shared_coder(path: str) -> BytePairCoder:
    """One for all tasks of a Python worker, so that what it has met is kept from task to task."""
    return held((BytePairCoder, path))[0]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``id_col`` and ids (array<int>) of every whole text; with ``digests`` instead n_tokens, ids_sha256 and decoded_sha256.

    Null is the empty text, which has no ids. One row per row of ``docs``, repeated or not; a null id stays
    null; other columns are not read; no rows give no rows. ``digests`` hashes the decimal ids joined by
    commas and the UTF-8 bytes of the decoded text inside the task, so that ids need not leave it.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def start() -> Callable:
        coder = shared_coder(path)

        def rows(batch: pa.RecordBatch) -> dict:
            ids, counts, shas, decoded = [], [], [], []
            for text in batch.column("text").to_pylist():
                parts = coder.coded(text)
                one = list(chain.from_iterable(i for i, _ in parts))
                if not digests:
                    ids.append(one)
                    continue
                counts.append(len(one))
                shas.append(hashlib.sha256(",".join([s for _, s in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(one).encode()).hexdigest())
            out = {"id": batch.column("id")}
            return out | ({"n_tokens": counts, "ids_sha256": shas, "decoded_sha256": decoded} if digests else {"ids": ids})

        return rows

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return arrow_map(source, None, f"id {kind}, {made}", start).withColumnRenamed("id", id_col)


def decode_documents(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text of coded documents. Null ids decode to the empty text; bytes that are no UTF-8 become U+FFFD."""
    source = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def start() -> Callable:
        coder = shared_coder(path)
        return lambda batch: {"id": batch.column("id"), "text": [coder.decode(x or []) for x in batch.column("ids").to_pylist()]}

    return arrow_map(source, None, f"id {dict(coded.dtypes)[id_col]}, text string", start).withColumnRenamed("id", id_col)
