"""The operators with production parameters on their whole tables, with SQL where SQL states the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op4_exact_dedup",
    """SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))) AS t""",
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), digest=True).drop("row")


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexatlas.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexatlas.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.langid import fit_prototypes, predict_languages

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    prototypes = fit_prototypes(docs.filter(~held_out))
    return predict_languages(docs, prototypes).withColumn("held_out", held_out)


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexatlas.llm.fertility import fertility_rules

    return fertility_rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.chunks import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", "removed_spans", "keep_ids", (F.size("removed_spans") > 0).alias("has_repeat")
    )


@query(
    "op1_warc",
    """WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, sha1(coalesce(html, '')) AS hex FROM pages),
  b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
    4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), '') AS bits FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6),
    lambda k: CASE WHEN substr(bits, 5 * i + k, 1) = '1' THEN (2 ** (5 - k))::INTEGER ELSE 0 END))::INTEGER, 1)), '') AS payload_digest
FROM b""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.warc import checked, fresh_folder, page_of, read_archives, write_archives

    manifest = write_archives(table(spark, sf_dir, "pages"), fresh_folder(spark), least_bytes=0)
    rows = read_archives(spark, manifest, payloads=False).select(
        "path", page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to")
    )
    return checked(rows, manifest).drop("path")


@query("op2_weak_quality")
def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.weak import weak_quality

    return weak_quality(table(spark, sf_dir, "documents"))


@query("op6_token_rollups")
def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document enters with two vocabularies; counts are revised to include an end token; exact copies leave; batches come twice."""
    import uuid

    import public_tokenizers

    from lexatlas.llm.exact import exact_duplicates
    from lexatlas.llm.rollups import TokenRollups, deletes, inserts, revisions, token_counts
    from lexatlas.session import cut, shared_dir

    docs = table(spark, sf_dir, "documents").withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    counts = cut(token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json"), keep=("source", "lang", "row")))
    counts = counts.withColumn("word_tokens_end", F.col("word_tokens") + 1)
    gone = exact_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    copies = counts.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left_semi")
    totals = TokenRollups(spark, f"{shared_dir(spark)}/rollups-{uuid.uuid4().hex}")
    batches = {
        "load": [inserts(counts, "word_bpe_49k", "word_tokens"), inserts(counts, "byte_bpe_50k", "byte_tokens")],
        "end-token": [revisions(counts, "word_bpe_49k", "word_tokens", "word_tokens_end")],
        "copies": [deletes(copies, "word_bpe_49k", "word_tokens_end"), deletes(copies, "byte_bpe_50k", "byte_tokens")],
    }
    for name in ("load", "end-token", "copies", "end-token", "load"):
        totals.commit(name, *batches[name])
    return totals.totals()


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tenth document by digest the end repeats: word i from a on is word a + (i - a) % p."""
    from lexatlas.llm.runs import periodic_runs

    h = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"))
    docs = docs.withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    docs = docs.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    place = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    docs = docs.select("doc_id", F.when(F.col("n").isNotNull(), F.concat_ws(" ", place)).otherwise(F.col("text")).alias("text"))
    best = F.col("strongest")
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexatlas.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = fit_toxicity(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).withColumn("held_out", held_out)


@query(
    "op11_prefix_trie",
    r"""WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
      coalesce(role, '') AS r, coalesce(text, '') AS x
    FROM conversations WHERE conv_id IS NOT NULL),
  h AS (SELECT c, c - c % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''),
      lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
  rebuilt AS (
    SELECT h.c, 0 AS own, t.i, t.r, t.x FROM h JOIN t ON t.c = h.base AND t.i <= h.h
    UNION ALL SELECT h.c, 1, t.i, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.i > h.h),
  seq AS (SELECT h.c, coalesce(list({'r': b.r, 'x': b.x} ORDER BY b.own, b.i) FILTER (b.c IS NOT NULL), []) AS l FROM h LEFT JOIN rebuilt AS b USING (c) GROUP BY h.c),
  member AS (SELECT c, d, l[1:d] AS k, len(l) AS n, l[d].x AS last FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM seq)),
  node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(n) AS deepest, any_value(last) AS last,
      sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM member GROUP BY k, d),
  up AS (SELECT k[1:e] AS k, e, leaf, worth FROM (
    SELECT k, unnest(range(0, d + 1)) AS e, (deepest = d)::BIGINT AS leaf,
      CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(last, '[^\x20\x09-\x0D]+')) END AS worth FROM node)),
  below AS (SELECT k, e, sum(leaf) AS n_leaves, sum(worth) AS saved_tokens FROM up GROUP BY k, e),
  child AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(child.n_children, 0) AS n_children,
  below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM node AS a JOIN below ON below.k = a.k AND below.e = a.d LEFT JOIN child ON child.k = a.k AND child.d = a.d
  LEFT JOIN node AS p ON a.d > 0 AND p.d = a.d - 1 AND p.k = a.k[1:a.d - 1]""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first h turns of c - c % 20, h being a digest of c modulo 4; its own follow from h on."""
    from lexatlas.llm.common import spread_join
    from lexatlas.llm.trie import numbered_turns, trie_of
    from lexatlas.session import cut

    turns = numbered_turns(table(spark, sf_dir, "conversations"))
    c = F.col("conv")
    convs = turns.groupBy("conv").agg(F.count("*").alias("weight"), F.min("part").alias("part"))
    convs = cut(convs.select("conv", "weight", "part", (c - c % 20).alias("base"), (F.crc32(c.cast("string")) % 4).alias("h")))
    sizes = convs.select(F.col("conv").alias("base"), F.col("weight").alias("base_turns"))
    convs = convs.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = cut(convs.withColumn("len", F.col("k") + F.greatest(F.col("weight") - F.col("h"), F.lit(0))).drop("base_turns"))
    shown = turns.filter("place <= 3 and conv % 20 = 0").select(F.col("conv").alias("base"), F.col("place").alias("depth"), "a", "b", "words")
    begun = shown.join(convs, "base").filter("depth <= k").select("conv", "part", "depth", "len", "a", "b", "words")
    own = spread_join(turns, convs.select("conv", "weight", "h", "k", "len"), ["conv"], ["place"], "weight").filter("place > h")
    own = own.select("conv", "part", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "len", "a", "b", "words")
    return trie_of(cut(begun.unionByName(own)), convs.select("conv", "len", "part"))
