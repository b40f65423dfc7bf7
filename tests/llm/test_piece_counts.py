"""op6_token_rollups: how pieces are counted."""

import public_tokenizers
from tokenizers import Tokenizer

from lexatlas.llm import rollups

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    b"", b".", b"a", b"a.", b" a, b; c: d! e? ", b"wait... no?! yes.", b'say "so". 3.5 and 3.', "é. é. naïve, Straße!".encode(), b"it's don't. we'll",
    b"UPPER Lower.", b"A<|endoftext|>B. C", b"x\x00y.\x0bz,\x0cw.\r\nv", b"under_score. hy-phen,", "漢字. ࢏.".encode(), b"z" * 200 + b". " + b"q" * 64 + b".", b"<b>. <i>,",
]


def test_pieces_are_counted_by_the_merges_of_the_file():
    library = Tokenizer.from_file(BYTES)
    pieces = rollups.PieceCounts(BYTES)
    pieces.coder.merge = None  # not called
    for text in (t.decode() for t in ODD):
        assert pieces.of(text) == len(library.encode(text, add_special_tokens=False).ids), text
