"""op5_packing: how words get their ids, and what workers keep."""

import re

import public_tokenizers
from tokenizers import Tokenizer

from lexatlas.llm import common, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    b"", b".", b"a", b"a.", b" a, b; c: d! e? ", b"wait... no?! yes.", b'say "so". 3.5 and 3.', "é. é. naïve, Straße!".encode(), b"it's don't. we'll",
    b"UPPER Lower.", b"A<|endoftext|>B. C", b"x\x00y.\x0bz,\x0cw.\r\nv", b"under_score. hy-phen,", "漢字. ࢏.".encode(), b"z" * 200 + b". " + b"q" * 64 + b".", b"<b>. <i>,",
]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.shown = tokenizer, []

    def encode(self, text, **more):
        self.shown.append(text)
        return self.tokenizer.encode(text, **more)


def test_ids_of_odd_texts_are_those_of_the_library():
    library = Tokenizer.from_file(WORDS)
    words = packing.WordIds(WORDS)
    for _ in range(2):  # new words, then known ones
        for text, ids in zip(ODD, words.of_all(ODD), strict=True):
            assert memoryview(ids).cast("I").tolist() == library.encode(text.decode(), add_special_tokens=False).ids, text
    assert list(words.of_all([])) == []


def test_plain_words_reach_the_merges_alone():
    words = packing.WordIds(WORDS)
    words.tokenizer = Counting(words.tokenizer)
    list(words.of_all([b"plain words of the letters a to z, and one caf\xc3\xa9."]))
    assert words.tokenizer.shown and not re.search("plain|words|letters", " ".join(words.tokenizer.shown))


def test_workers_keep_what_tasks_want_and_let_go_of_the_rest(spark):
    def kept():
        import os
        import sys

        table = getattr(sys.modules.get("lexatlas_held"), "kept", {})
        return f"{os.getpid()} {[id(x) for x in table.values()]}"

    def start():
        common.held((packing.WordIds, WORDS))
        now = kept()
        return lambda batch: {"id": batch.column("id"), "n": [now] * batch.num_rows}

    rows = spark.range(64).repartition(32)
    seen = {r["n"] for r in common.arrow_map(rows, None, "id long, n string", start).collect()}
    assert len(seen) == len({x.split()[0] for x in seen})  # one object for all tasks of a worker
    plain = common.arrow_map(rows, lambda batch: {"id": batch.column("id"), "n": [kept()] * batch.num_rows}, "id long, n string")
    assert {r["n"].split(" ", 1)[1] for r in plain.collect()} == {"[]"}
