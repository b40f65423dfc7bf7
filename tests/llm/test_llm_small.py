"""The corpus operators against brute force and libraries on small tables, with nulls, ties, repeats and empty input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, row string, digest string"
BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, near copies, shared passages, clashing column names."""
    rng = random.Random(5)
    base, passage = prose(rng, 200), prose(rng, 60)
    edited = [" ".join(w if i != k else "x" + w for i, w in enumerate(base.split())) for k in (3, 50, 120)]
    texts = ["", None, "word", "word", " \n\t ", "two words", base, base, *edited, prose(rng, 30) + ". " + passage + " " + prose(rng, 30), prose(rng, 10) + "\n" + passage + "\n" + prose(rng, 70)]
    texts += ["Größe straße <|endoftext|> 漢字 ࢏  x", "z" * 20000, prose(rng, 9000), "and " * 40, "a\nb\na\nb", "###*** $$$ %%%"]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", None, "k", None, "r", "d") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (3, "other text of the same id", None, None, 1, None, None, None, None), (None, base, "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_exact_duplicates(odd, none):
    from lexatlas.llm.exact import exact_duplicates

    groups = defaultdict(list)
    for i, t in listed(odd):
        groups[t].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = exact_duplicates(odd, digest=True)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    narrow = Counter(k[:4] for k in want.elements())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(odd, prefix_chars=1).collect()) == narrow
    assert exact_duplicates(none).count() == 0


def linked(rows, width):
    """Brute force: id -> (set size, smallest id that can be reached)."""
    sets = []
    for i, t in rows:
        w = t.encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, len(sets[a]), least.get(find(a)), i == least.get(find(a))) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(odd, width):
    from lexatlas.llm.setsketch import near_duplicates

    got = near_duplicates(odd, width=width)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == linked(listed(odd), width)


def test_near_duplicates_of_a_chain(spark):
    """Texts that drift word by word: neighbours are linked, the ends have nothing in common."""
    from lexatlas.llm.setsketch import near_duplicates

    rng = random.Random(2)
    words = prose(rng, 400).split()
    rows = [(1000 - k, " ".join(words[4 * k : 4 * k + 60])) for k in range(80)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == linked(rows, 2)


def test_near_duplicates_of_nothing(none):
    from lexatlas.llm.setsketch import near_duplicates

    assert near_duplicates(none).count() == 0


def test_registers_merge_and_estimate():
    from lexatlas.llm.setsketch import REGISTERS, log_likelihoods, merge, sketch

    rng = np.random.default_rng(0)
    off = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = sketch(x[:700]), sketch(x[200:])
        assert (merge(a, b) == sketch(x)).all()
        grid = np.linspace(0, 1, 201)[None, :]
        n = np.array([700.0])
        ll = log_likelihoods(np.array([(a > b).sum()], float), np.array([(a < b).sum()], float), n, n, grid)
        off.append(grid[0, ll.argmax()] - 500 / 900)
        assert abs((a == b).mean() - 500 / 900) < 6 * (0.25 / REGISTERS) ** 0.5
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_bpe_equals_the_library(odd, none):
    from lexatlas.llm.bpe import decode_documents, encode_documents

    library = Tokenizer.from_file(BYTES)
    coded = encode_documents(odd, BYTES)
    want = Counter()
    for i, t in listed(odd):
        want[i, tuple(library.encode(t, add_special_tokens=False).ids)] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == want
    assert Counter((r.doc_id, r.text) for r in decode_documents(coded, BYTES).collect()) == Counter(listed(odd))
    assert encode_documents(none, BYTES).count() == 0


def test_bpe_on_random_characters():
    from lexatlas.llm.bpe import BytePairCoder

    library, coder = Tokenizer.from_file(BYTES), BytePairCoder(BYTES)
    rng = random.Random(3)
    letters = [chr(x) for x in [*range(0x250), 0x2014, 0x2028, 0x558, 0x88F, 0x4E2D, 0x1F600, 0xFFFD]] + list("   \n\n  abc'll") + ["<|endoftext|>"]
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(50))
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_packing(odd, none):
    from lexatlas.llm.packing import pack_documents

    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in listed(odd):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            one = ids[at : at + 4096]
            want[i, p, at, len(one), zlib.crc32(np.array(one, "<u4").tobytes())] += 1
    rows = pack_documents(odd, WORDS, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(r.length for r in rows) // 4096)
    assert pack_documents(none, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_the_histogram(seed):
    from lexatlas.llm.packing import plan_sequences

    rng = np.random.default_rng(seed)
    lengths = np.minimum(512, rng.lognormal(3 + seed / 2, 1.2, 5000).astype(int) + 1)
    histogram = Counter(lengths.tolist())
    held: Counter = Counter()
    plan = plan_sequences(histogram, 512)
    for slots, repeats in plan:
        assert repeats > 0 and sum(x * t for x, t in slots) <= 512
        for x, t in slots:
            held[x] += t * repeats
    assert held == histogram
    assert sum(n for _, n in plan) <= 1.03 * max(-(-int(lengths.sum()) // 512), int((lengths > 256).sum()))


def test_quality_rules(odd, none):
    from lexatlas.llm.fertility import fertility_rules

    want = Counter()
    for i, t in listed(odd):
        w = [x.decode() for x in t.encode().split()]
        seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {j + d for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for d in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed] += 1
    rows = fertility_rules(odd, PIECES).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert all(r.kept or r.base_failed or r.rejected_by for r in rows)
    assert fertility_rules(none, PIECES).count() == 0


def test_fertility_bands_catch_what_stands_out(spark):
    from lexatlas.llm.fertility import fertility_rules

    rng = random.Random(1)
    rows = [(i, prose(rng, 80), "xx") for i in range(300)]
    rows += [(1000, "".join(chr(rng.randint(0x1400, 0x1650)) + " " * (k % 5 == 0) for k in range(400)), "xx"), (1001, " ".join(f"{prose(rng, 1)}|#|*|" for _ in range(80)), "xx")]
    got = {r.doc_id: r.kept for r in fertility_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert not got.pop(1000) and not got.pop(1001)
    assert all(got.values())


def test_fertility_bands_follow_the_length(spark):
    from lexatlas.llm.fertility import fertility_rules

    rng = random.Random(9)
    # A vocabulary with common and rare words, as texts have; copies of one text must not narrow a band.
    words = prose(rng, 600).split()
    drawn = lambda n: rng.choices(words, [1 / (k + 20) for k in range(600)], k=n)
    clean = [(i, " ".join(drawn(int(10 * 2 ** rng.uniform(0, 6)))), "xx") for i in range(1500)]
    clean += [(2000 + i, clean[0][1], "xx") for i in range(300)] + [(3000 + i, " ".join(drawn(12)), "yy") for i in range(8)]
    symbols = [(5000 + i, " ".join(w + rng.choice(["###", "$$$", "%%%", "&&&", "***"]) for w in drawn(n)), "xx") for i, n in enumerate((80, 120, 160, 242, 400))]
    tables = [(6000 + i, " | ".join(drawn(n)), "xx") for i, n in enumerate((60, 120, 200, 300))]
    rows = fertility_rules(spark.createDataFrame(clean + symbols + tables, "doc_id long, text string, lang string"), PIECES).collect()
    good = [r for r in rows if r.doc_id < 5000 and not r.base_failed]
    assert not [r for r in rows if r.doc_id >= 5000 and r.kept]
    assert all(r.rejected_by for r in rows if r.doc_id >= 5000 and not r.base_failed)
    assert sum(not r.base_failed for r in rows if r.doc_id >= 5000) == 9
    assert sum(not r.kept for r in good) <= 0.005 * len(good)
    assert not [r for r in good if r.n_words < 20 and not r.kept]


def test_language_id(spark, odd, none):
    from lexatlas.llm.langid import fit_prototypes, predict_languages

    rng = random.Random(8)
    syllables = {"aa": ["the", "ing", "and", "tion", "wh"], "bb": ["sch", "ung", "ein", "der", "ß"], "cc": ["que", "ión", "los", "ñ", "ar"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))), x) for i in range(300) for x in ["aa", "bb", "cc"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = fit_prototypes(df.filter("doc_id % 3 = 0"))
    got = predict_languages(df.filter("doc_id % 3 = 1").withColumn("want", F.col("lang")), prototypes).collect()
    want = Counter((i, x) for i, _, x in rows if i % 3 == 1)
    assert sum((Counter((r.doc_id, r.lang_pred) for r in got) & want).values()) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    placed = predict_languages(odd, prototypes).collect()
    assert len(placed) == odd.count()
    assert {r.lang_pred for r in placed if r.doc_id in (0, 1, 4, 18)} == {"und"}
    assert {(r.lang_pred, r.score) for r in predict_languages(odd, {}).collect()} == {("und", 0.0)}
    assert fit_prototypes(none) == {} and predict_languages(none, prototypes).count() == 0


def test_language_stage_drops_what_no_language_teaches(spark):
    import base64

    from corpus_pipeline import language_id

    rng = random.Random(12)
    syllables = {"aa": ["the", "ing", "and", "tion", "wh"], "bb": ["sch", "ung", "ein", "der", "ß"], "cc": ["que", "ión", "los", "ñ", "ar"]}
    clean = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randint(2, 3))) for _ in range(rng.choice([2, 3, 5, 20, 200]))), x) for i in range(300) for x in syllables]
    blocks = [(0x430, 0x450), (0x3B1, 0x3CA), (0x620, 0x64B), (0xAC00, 0xD7A3), (0x4E00, 0x9FFF), (0x20000, 0x2A6D0), (0x10428, 0x10450), (97, 123)]
    letters = ["".join(filter(str.isalpha, map(chr, range(*b)))) for b in blocks] + ["bcdfghjklmnpqrstvwxz"]
    foreign = [" ".join("".join(rng.choice(x) for _ in range(rng.randint(2, 9))) for _ in range(n)) for x in letters for n in (100, 1000) for _ in range(15)]
    foreign += [base64.b64encode(rng.randbytes(n)).decode() for n in (600, 6000) for _ in range(15)]
    rows = [(i, t, x, len(t)) for i, t, x in clean] + [(1000 + i, t, None, len(t)) for i, t in enumerate(foreign)]
    left = language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").repartition(3), "")
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, *_ in clean)


def test_letters_of_all_planes_have_symbols():
    from lexatlas.llm.langid import Profiler

    profiler = Profiler()
    for text in ("\U00020000\U00020001", "\U00010428", "\U000313a0"):
        assert profiler.vector(text) is not None
    assert profiler.vector("\U0001f600 \U0010fffd 12") is None


def test_substring_dedup(odd, none):
    from lexatlas.llm.chunks import substring_dedup

    before = {(r.doc_id, r.text): r for r in odd.collect()}
    passage = next(t for i, t in listed(odd) if i == 12).split("\n")[1]
    rows = substring_dedup(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.kept == "k" or r.doc_id in (3, None)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert passage in by_id[11][0].text and len(by_id[12][0].keep_ids) >= 1 and 11 in by_id[12][0].keep_ids
    assert len(by_id[12][0].text) < len(before[12, next(t for i, t in listed(odd) if i == 12)].text) - 0.5 * len(passage)
    for i in (0, 2, 3, 5, 13, 14, 15, 18):
        assert all(not r.removed_spans for r in by_id[i])
    # Every removed span is in the original, at least 20 words long, and present in a document that keeps it.
    originals = dict(listed(odd))
    for r in rows:
        if r.removed_spans:
            text = originals[r.doc_id].encode()
            kept = b"".join(text[a:b] for a, b in zip([0, *[x.end for x in r.removed_spans]], [*[x.start for x in r.removed_spans], len(text)]))
            assert kept.decode() == r.text
            assert all(len(text[x.start : x.end].split()) >= 20 for x in r.removed_spans)
    assert substring_dedup(none).count() == 0


def test_chunks_resist_insertions():
    from lexatlas.llm.chunks import chunk_spans

    rng = random.Random(4)
    text = prose(rng, 500).encode()
    cut = lambda t: {t[a:b] for a, b in zip(*chunk_spans(t))}
    moved = b"some inserted words " + text
    assert len(cut(text) & cut(moved)) >= len(cut(text)) - 8
    assert all(len(c.split()) >= 20 for c in cut(text))


def page_rows():
    rng = random.Random(6)
    pages = [(i, f"http://h/{i}", prose(rng, rng.randint(1, 300))) for i in range(60)]
    pages += [(100 + i, None, "same é payload") for i in range(40)] + [(200, "u", None), (201, "u", ""), (202, None, "")]
    return pages + [(300, "u", rng.randbytes(3000).decode("latin-1")), (301, "u", "\x1f\x8b\x08" * 50 + "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 20])
def test_warc_round_trip(spark, tmp_path, least):
    from lexatlas.llm.warc import page_of, payload_digest, read_archives, write_archives

    pages = page_rows()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash")).repartition(4)
    manifest = write_archives(df, f"file:{tmp_path}/a", least_bytes=least)
    first = defaultdict(int)
    for i, _, h in pages:
        first[h or ""] = max(first[h or ""], i)
    want = set()
    for i, u, h in pages:
        body = (h or "").encode()
        keep = first[h or ""] if len(body) >= least else i
        want.add((i, len(body), payload_digest(body), "response" if keep == i else "revisit", keep if keep != i else None, body if keep == i else b""))
    for split in (16 << 20, 700, 97):
        rows = read_archives(spark, manifest, split).select(page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("r"), "payload").collect()
        assert len(rows) == len(pages)
        assert {(r.p, r.payload_bytes, r.payload_digest, r.record_type, r.r, bytes(r.payload)) for r in rows} == want
    assert write_archives(df.limit(0), f"file:{tmp_path}/b").count() == 0


def test_warc_ignores_false_magic(tmp_path):
    import gzip
    import io

    import pyarrow as pa

    from lexatlas.llm.warc import record, records_in

    noise = b"\x1f\x8b\x08" + b"junk" * 10 + gzip.compress(b"not a record") + b"\x1f\x8b"
    members = [record("response", i, "u", b"x" * i * 50, None) for i in range(20)]
    data = noise + noise.join(members) + noise
    found = [f[b"warc-record-id"] for a in range(0, len(data), 61) for _, f, _ in records_in(pa.PythonFile(io.BytesIO(data), "r"), a, a + 61)]
    assert found == [f"<urn:x-page:{i}>".encode() for i in range(20)]


def test_warc_headers_of_any_length(spark, tmp_path):
    """Urls beyond 65,536 bytes, which zip well or not at all; a manifest that says more than is there."""
    from lexatlas.llm.warc import checked, page_of, read_archives, write_archives

    rng = random.Random(11)
    urls = {1: "http://h/" + "a" * 70000, 2: "data:text/html;base64," + rng.randbytes(200000).hex(), 3: "http://h/" + "b" * 3000000, 4: "http://h/4"}
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string").coalesce(1)
    manifest = write_archives(df, f"file:{tmp_path}/a")
    for split in (16 << 20, 5000):
        rows = checked(read_archives(spark, manifest, split).withColumn("p", page_of("record_id")), manifest).collect()
        assert sorted((r.p, r.target_uri, bytes(r.payload).decode()) for r in rows) == [(i, u, f"page {i}") for i, u in urls.items()]
    with pytest.raises(ValueError, match="holds 5, read 4"):
        checked(read_archives(spark, manifest, payloads=False), manifest.withColumn("records", F.col("records") + 1))


def test_weak_quality(spark, odd, none):
    from lexatlas.llm.weak import em_posteriors, weak_quality

    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    accuracy = [0.9, 0.8, 0.75, 0.6, 0.85]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth).astype(int) for a in accuracy], axis=1)
    votes[rng.random(votes.shape) < 0.3] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, chances, share = em_posteriors(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03
    for k, a in enumerate(accuracy):
        assert abs(chances[k, 1, 1] - a) < 0.04
    rows = weak_quality(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in listed(odd))
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert weak_quality(none).count() == 0


def test_rollups(spark, tmp_path, odd):
    from lexatlas.llm.rollups import TokenRollups, deletes, inserts, revisions, token_counts

    words, pieces = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    counts = token_counts(odd, WORDS, BYTES)
    want = Counter((i, len(t), len(words.encode(t, add_special_tokens=False).ids), len(pieces.encode(t, add_special_tokens=False).ids)) for i, t in listed(odd))
    assert Counter((r.doc_id, r.chars, r.word_tokens, r.byte_tokens) for r in counts.collect()) == want
    rows = [(1, "a", "en", 10, 100, 4), (2, "a", "en", 20, 200, 5), (3, None, "de", 7, 70, 6), (4, "b", None, 1, 10, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long, chars long, more long")
    store = TokenRollups(spark, f"file:{tmp_path}/r")
    assert store.totals().count() == 0
    assert store.commit("in", inserts(df, "v1", "tokens")) and not store.commit("in", inserts(df, "v1", "tokens"))
    assert store.commit("new", revisions(df.filter("doc_id = 2"), "v1", "tokens", "more"))
    assert store.commit("out/1", deletes(df.filter("doc_id in (1, 4)"), "v1", "tokens"))
    assert not store.commit("out/1", deletes(df, "v1", "tokens"))
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 1, 5, 200), (None, "de", "v1", 1, 7, 70)}
