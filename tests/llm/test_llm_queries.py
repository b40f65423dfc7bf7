"""The registered queries: SQL where there is some, and the pipeline against what brute force leaves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import compare, duck
from conftest import SMALL
from test_llm_small import linked, prose
from tokenizers import Tokenizer

from lexatlas.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert compare(spark, duck(SMALL), name, QUERIES[name], SQL[name], SMALL) == ""


def test_numbers_of_the_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    clean = {i: prose(rng, 120) for i in range(40)}
    passage = prose(rng, 70)
    texts = dict(clean)
    texts |= {100 + i: clean[0] for i in range(5)}  # exact copies: the largest id stays
    near = clean[1].split()
    texts |= {200 + i: " ".join([*near[:50], f"extra{i}", *near[50:]]) for i in range(4)}  # near copies: the smallest id stays
    texts |= {300 + i: prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40) for i in range(3)}
    texts |= {400: None, 401: "12345 678", 402: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    docs, names = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        names.append({r.doc_id: r.text for r in docs.collect()})
    no_und = {i for i in texts if i not in (400, 401, 402)}
    assert set(names[0]) == no_und
    unique = no_und - {0, 100, 101, 102, 103}
    assert set(names[1]) == unique
    kept = {i for (i, _, _, keep) in linked(sorted((i, texts[i]) for i in unique), 5) if keep}
    assert set(names[2]) == kept == unique - {200, 201, 202, 203}
    assert all(names[3][i] == texts[i] for i in kept if i not in (301, 302)) and passage in names[3][300]
    assert all(len(names[3][i].split()) < 110 and len(names[3][i].split()) >= 80 for i in (301, 302))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in names[3].items()}
    assert {(r.doc_id, r.length, r.ids_crc32) for r in packed} == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    assert len({r.sequence_id for r in packed}) == -(-sum(map(len, want.values())) // 4096)


def test_stages_leave_one_of_repeated_rows(spark):
    """Rows equal in id and text, null ids included; an empty table; clashing column names."""
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (2, c), (None, None), (None, None), (3, ""), (None, prose(rng, 30))]
    rows += [(7, rows[-1][1]), (7, rows[-1][1])]
    schema = "doc_id long, text string, row string, kept long, count int"
    docs = spark.createDataFrame([(*r, "x", 0, i) for i, r in enumerate(rows)], schema)
    left = corpus_pipeline.exact_dedup(spark, docs, "")
    assert left.columns == docs.columns
    # The empty text of document 3 equals the null texts, whose null ids are smaller; 7 is larger than a null id.
    want = sorted([(1, a), (1, b), (2, c), (3, ""), (7, rows[-1][1])])
    assert sorted((r.doc_id, r.text) for r in left.collect()) == want
    near = corpus_pipeline.near_dedup(spark, docs.filter("doc_id in (1, 2)"), "")
    assert sorted((r.doc_id, r.text) for r in near.collect()) == sorted([(1, a), (1, b), (2, c)])
    assert corpus_pipeline.exact_dedup(spark, docs.limit(0), "").count() == 0


def test_worker_holds_one_operators_things():
    from lexatlas.llm import common

    first = common.held((list, "ab"))[0]
    assert common.held((list, "ab"))[0] is first
    both = common.held((list, "ab"), (set, "c"))
    assert both[0] is first and both[1] == {"c"}
    common.held((set, "c"))
    assert list(common._HELD) == [(set, "c")]
    common.held()
    assert not common._HELD
