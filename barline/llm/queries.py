"""The registered queries of the operators, over whole tables, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import edits, fingerprints, langid, mixing, neardup, ngrams, packing, phrases, recount, secrets, shards, simhash, spelling, topk
from barline.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_fingerprints")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = fingerprints.add_fingerprint(docs, F.col("text"), "own")
    pairs = edits.with_next(prints, ["text", "own"])
    tail = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), tail))
    both = fingerprints.add_fingerprint(pairs.withColumn("edited", edited), F.col("edited"), "other")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprints.as_text("own").alias("fingerprint"),
        fingerprints.as_text("other").alias("edited_fingerprint"),
        fingerprints.likeness("own", "other").alias("near_edited"),
        fingerprints.likeness("own", "next_own").alias("near_next"),
    )


@query("op2_near_duplicates")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), percent=85)


@query("op3_hilbert_shards")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.hilbert_shards(table(spark, sf, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_backoff_scores")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    scored = ngrams.score(table(spark, sf, "documents"), folds=5, fold=1)
    # to six places: both engines add the tokens' logarithms in an order of their own
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@query("op5_poisson_mix")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.poisson_mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "source", "lang", "copy", "copies", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op6_best_two_fit")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op7_blob_ledger")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.ledger_scan(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = secrets.listed(F.col("spans"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


@query("op8_threshold_top_k")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k_search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op9_language_codes")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "second", "margin", "ambiguous")


@query("op10_edit_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Three edits a document: a cut at a third, its own first 40 code points in the middle, a replaced end."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text").cast("long")
    edit = lambda at, drop, put: F.struct(at.cast("long").alias("at"), F.lit(drop).cast("long").alias("drop"), put.alias("put"))
    steps = F.array(edit(F.floor(n / 3), 25, F.lit("")), edit(F.floor(n / 2), 0, F.substring("text", 1, 40)), edit(F.greatest(n - 10, F.lit(0)), 5, F.lit(" revised")))
    trees = recount.with_trees(docs).withColumn("edits", steps).withColumn("before", F.col("n_tokens"))
    done = recount.recount(trees)
    return done.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), "reencoded", F.sha2(F.col("text"), 256).alias("edited_sha256"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"), slips_every=97)


@query("op12_collocations")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"), threshold=100, top=2000)


@query("op13_simhash_duplicates")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf, "documents"), radius=4)


# ---- SQL --------------------------------------------------------------------------------------------------------

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD_LIST = rf"list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: crc32 of the id as text, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

ORACLES["op2_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORD_LIST} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.v = b.v AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""

ORACLES["op4_backoff_scores"] = f"""
WITH d AS (SELECT doc_id, {CRC} % 5 = 1 AS held_out, list_append({WORD_LIST}, '') AS t FROM documents),
tok AS (SELECT doc_id, held_out, unnest(t) AS w, unnest(list_prepend('', t[1:len(t) - 1])) AS h FROM d),
uni AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w), bi AS (SELECT h, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY h, w),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM uni),
p AS (SELECT t.doc_id, t.held_out, coalesce(u.c, 0) AS c, coalesce(b.c, 0) AS cb, coalesce(s.c, 0) AS ch, n.n, (coalesce(u.c, 0) + 0.5::DOUBLE) / (n.n + 0.5::DOUBLE * (n.v + 1)) AS q
  FROM tok t LEFT JOIN uni u ON t.w = u.w LEFT JOIN bi b ON t.h = b.h AND t.w = b.w LEFT JOIN uni s ON t.h = s.w, n)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, n AS train_tokens, round(sum(log10(q)), 6) AS base_score,
  round(sum(log10((cb + {ngrams.STRENGTH}::DOUBLE * q) / (ch + {ngrams.STRENGTH}::DOUBLE))), 6) AS score FROM p GROUP BY doc_id, held_out, n
"""

ASSIGN = secrets.RULES[0].pattern.replace("'", "''")


def _found(rank: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d"""


ORACLES["op7_blob_ledger"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_found(i, r) for i, r in enumerate(secrets.RULES))}),
u AS (SELECT doc_id, rank, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM u),
f AS (SELECT doc_id, rank, kind, stop - length(hit) AS start, stop FROM s WHERE kind <> 'assign' OR length(regexp_extract(hit, '{ASSIGN}', 2)) >= 8),
g AS (SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id)
SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans FROM g
"""

ORACLES["op5_poisson_mix"] = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(CAST(n AS DOUBLE)) / (SELECT CAST(sum(CAST(sqrt(CAST(n AS DOUBLE)) AS DECIMAL(28, 10))) AS DOUBLE) FROM counts)
  * (SELECT CAST(sum(n) AS DOUBLE) FROM counts) / n AS rate FROM counts),
cdf AS (SELECT source, rate, 0 AS k, -rate AS term, exp(-rate) AS total FROM rates
  UNION ALL SELECT source, rate, k + 1, term + ln(rate) - ln(CAST(k + 1 AS DOUBLE)), total + exp(term + ln(rate) - ln(CAST(k + 1 AS DOUBLE)))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (SELECT *, CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.total <= d.u) AS copies FROM drawn d)
SELECT doc_id, source, lang, CAST(copy AS INTEGER) AS copy, CAST(copies AS INTEGER) AS copies, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5
FROM counted, generate_series(1, copies) AS g(copy)
"""

ORACLES["op8_threshold_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

#: crc32 of `<doc_id>:<w>` over UTF-8 bytes; letters beyond ASCII are U+00C0 to U+00FF, two bytes each.
WORD_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY doc_id, w), h AS (SELECT w, c, {WORD_CRC} AS h FROM g),
x AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, v.word FROM less l JOIN v ON l.rest = v.word UNION SELECT v.word, l.word FROM less l JOIN v ON l.rest = v.word),
r AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM near JOIN v ON b = word),
f AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN b END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n FROM v LEFT JOIN r ON v.word = r.a AND place = 1),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON w.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk w ON f.word = w.word JOIN f e ON w.at = e.word AND e.form IS NULL
"""

ORACLES["op12_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?
-
]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[ 	]+'), lambda x: x <> '') AS w FROM p), t AS MATERIALIZED (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS o(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM u JOIN f x ON u.lang = x.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON u.lang = y.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN t ON u.lang = t.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM s),
k AS (SELECT * FROM b WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.phrase <> b.phrase AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a)),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k)
SELECT * FROM o WHERE rank <= 2000
"""
