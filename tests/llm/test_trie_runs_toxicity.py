"""The prefix trie, periodic runs and toxicity against brute force, with nulls, ties, repeats and empty input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, part string, depth string"
DOCS = "doc_id long, text string, lang string, score string, runs string"


def trie(conversations):
    """Nodes of {id: [(role, text), ...]} as the contract states them."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def below(k):
        leaves, saved = (0, 0) if children[k] else (1, 0)
        for child in children[k]:
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + ((len(members[k]) - 1) * len(WORDS.findall(k[-1][1])) if k else 0)

    made = Counter()
    for k, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(k))
        made[min(convs), len(k), min(members[k[:-1]]) if k else None, len(convs), len(children[k]), *below(k), hashlib.sha256(ends.encode()).hexdigest()] += 1
    return made


def nodes(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def grouped(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in by.items()}


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(8)
    rows = []
    for c in [*range(60), -7, 1 << 40]:
        for i in range(rng.randint(1, 6)):
            rows.append((c, i, rng.choice(["user", "assistant"]), rng.choice(["a b", "hello there now", "x"]) if rng.random() < 0.8 else f"own {c} {i}", "p", "d"))
    # A conversation of a third of the rows, twice; copies; turn numbers that repeat or are null; rows that repeat; nulls.
    for c in (100, 101):
        rows += [(c, i, "user", f"line {i % 7}", None, None) for i in range(90)]
    for c in range(200, 260):
        rows += [(c, i, "user", f"the same {i}", None, None) for i in range(3)]
    rows += [(300, 1, "user", "b", None, None), (300, 1, "user", "a", None, None), (300, None, None, "later", None, None), (300, None, "a", None, None, None), (300, 0, None, None, None, None)]
    rows += [(301, 5, "r", "t", None, None)] * 2 + [(None, 1, "user", "no conversation", None, None)] * 3
    return rows


def test_trie(spark, talk):
    from lexatlas.llm.trie import prefix_trie

    turns = spark.createDataFrame(talk, TURNS).repartition(5)
    got = nodes(prefix_trie(turns))
    assert got == trie(grouped(talk))
    assert prefix_trie(turns.filter("conv_id is null")).count() == 0
    assert prefix_trie(turns.limit(0)).count() == 0
    one = nodes(prefix_trie(turns.filter("conv_id = 301")))
    assert one == trie({301: [("r", "t"), ("r", "t")]})


def test_trie_where_the_screen_lets_all_through(spark, talk, monkeypatch):
    """A sketch that is much too small proves nothing, and the nodes are the same."""
    from lexatlas.llm import trie as module

    monkeypatch.setattr(module.Sketch, "estimate", lambda self, x, y: np.full(len(x), 2, np.uint8))
    turns = spark.createDataFrame([r for r in talk if r[0] is not None and r[0] < 40], TURNS)
    made = module._screened(module._prefixes(turns.sparkSession.range(0).selectExpr("id conv", "0 part", "id depth", "id len", "id words", "id a", "id b")), module.Sketch(14))
    assert made.count() == 0
    assert module.Sketch(14).estimate(np.arange(3), np.arange(3)).tolist() == [2, 2, 2]


def test_sketch_never_calls_a_repeated_name_single():
    from lexatlas.llm.trie import Sketch

    rng = np.random.default_rng(1)
    x, y = rng.integers(-(1 << 62), 1 << 62, (2, 3000))
    made = Sketch(14)
    made.add(x, y)
    made.add(x[:1000], y[:1000])
    assert (made.estimate(x[:1000], y[:1000]) == 2).all()
    assert (made.estimate(x[1000:], y[1000:]) == 1).mean() > 0.95


def runs(words):
    """Every (start, length, period) by trying all periods at all places."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(words[i : i + n - p] == words[i + p : i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def summary(words):
    found = runs(words)
    inside = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in inside)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    return found, best, kept


def periodic(rng):
    kind = rng.randint(0, 4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 80))]
    if kind == 1:
        cell = [rng.choice("abc") for _ in range(rng.randint(1, 45))]
        return (cell * 9)[: rng.randint(0, 300)] + [rng.choice("abcd") for _ in range(rng.randint(0, 50))]
    if kind == 2:
        return [rng.choice("abcdefgh") for _ in range(rng.randint(0, 200))]
    if kind == 3:
        return list("ababababac") * rng.randint(1, 20)
    return [str(k) for k in range(40)] + [w for w in "one two three four five six seven eight".split()] * rng.randint(1, 9)


def test_runs_of_random_texts():
    from lexatlas.llm import runs as module

    assert (module._MEET >= 0).all()
    rng = random.Random(21)
    for _ in range(60):
        texts = [" ".join(periodic(rng)).encode() for _ in range(rng.randint(1, 12))]
        assert [r for _, r in module.text_runs(texts)] == [runs(t.decode().split()) for t in texts]


def test_extensions_are_exact():
    from lexatlas.llm.runs import Extensions

    rng = np.random.default_rng(4)
    numbers = np.concatenate([np.tile(rng.integers(0, 5, 50), 8), rng.integers(0, 2, 300)])
    extend = Extensions(numbers, len(numbers))
    i = rng.integers(0, len(numbers) - 1, 500)
    j = np.minimum(i + rng.integers(1, 200, 500), len(numbers))
    i, j = i[i < j], j[i < j]
    want = [next((k for k in range(len(numbers) - b) if numbers[a + k] != numbers[b + k]), len(numbers) - b) for a, b in zip(i, j)]
    assert extend(i, j).tolist() == want


def test_periodic_runs(spark, monkeypatch):
    from lexatlas.llm import runs as module

    rng = random.Random(2)
    texts = [" ".join(periodic(rng)) for _ in range(40)] + [None, "", " \t\n", "Größe ü" * 3, "a\x0bb\x0ca\x0bb a b\ta b  a b", "w " * 30000, "x y z " * 2000]
    rows = [(i, t, None, "s", "r") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (3, "other text of the id", None, None, None), (None, "q q q q q q", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)

    def wanted(t):
        words = WORDS.findall(t or "")
        if len(words) < 10000 and len(words) > 1000:
            return (((0, 6000, 3),), (0, 6000, 3), "x y z")
        if len(words) >= 10000:
            return (((0, 30000, 1),), (0, 30000, 1), "w")
        found, best, kept = summary(words)
        return tuple(found), best, kept

    want = Counter((i, len(WORDS.findall(t or "")), *wanted(t)) for i, t, *_ in rows)
    got = module.periodic_runs(docs).collect()
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), tuple(r.strongest) if r.strongest else None, r.collapsed) for r in got) == want
    assert module.periodic_runs(docs.limit(0)).count() == 0


def test_op12(spark):
    """The query on all documents against the definition."""
    from lexatlas.llm.queries import QUERIES

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, most = {}, 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        words = WORDS.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found, best, kept = summary(words)
        most = max(most, len(found))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want[r.doc_id] = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(kept))
    got = QUERIES["op12_periodic_runs"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got} == want
    assert most and len(got) == len(want)


def best_segments(scores, at=0):
    """The segment of the largest sum, then those to its left and right."""
    if not any(s > 0 for s in scores):
        return []
    total, i, j = max((sum(scores[i : j + 1]), i, j) for i in range(len(scores)) for j in range(i, len(scores)))
    return best_segments(scores[:i], at) + [(at + i, at + j, total)] + best_segments(scores[j + 1 :], at + j + 1)


def test_maximal_segments():
    from lexatlas.llm.toxicity import maximal_segments

    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.uniform(-3, 2) for _ in range(rng.randint(0, 25))]
        got, want = maximal_segments(scores), best_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


@pytest.fixture(scope="module")
def judged(spark):
    """Invented prose; toxic documents have some of four words, one of which is inflected."""
    rng = random.Random(13)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if toxic := i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["Vilekk!", "(blarg", "BLARG", "zumpf" + rng.choice(plain)]))
        docs.append((i, " ".join(words), None, "own", None))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark, judged):
    from lexatlas.llm.toxicity import fit_toxicity, score_toxicity

    docs, labels = judged
    long = "le " * 3000 + "blarg vilekk zumpfo " + "le " * 3000
    odd = [(1000, None, None, None, None), (1001, "", None, None, None), (1002, long, None, None, None), (None, "blarg vilekk blarg", None, None, None), docs[0], docs[0], (1003, "İ" * 50 + " blarg vilekk", None, None, None)]
    both = spark.createDataFrame(docs + odd, DOCS).repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (7, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(both, marks)
    got = score_toxicity(both, model).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 0]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in unseen]) > 0.97
    texts = {i: t for i, t, *_ in docs + odd}
    for r in got:
        for p in r.passages:
            found = re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "")[p.start : p.end].lower())
            assert found and re.search("blarg|vilekk|zumpf", " ".join(found)) and len(found) == p.last_word - p.first_word + 1
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1000][0].predicted == by[1001][0].predicted == 0 and by[1000][0].passages == []
    assert by[1002][0].predicted == by[None][0].predicted == 1 and by[1002][0].passages[0].first_word == 3000
    assert len(by[0]) == 3 and len({r.score for r in by[0]}) == 1


def test_toxicity_without_labels(spark, judged):
    from lexatlas.llm.toxicity import fit_toxicity, score_toxicity

    docs = spark.createDataFrame(judged[0][:5], DOCS)
    for rows, share in (([], 0.5), ([(0, 0), (1, 0), (2, None)], 0.25)):
        model = fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        scores = {r.score for r in score_toxicity(docs, model).collect()}
        assert len(scores) == 1 and abs(scores.pop() - share) < 0.02
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_op13_on_held_out_documents(spark):
    from lexatlas.llm.queries import QUERIES

    folder = SMALL.replace("sf0.001", "sf0.1")
    got = QUERIES["op13_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.005
