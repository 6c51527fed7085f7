"""Retrieval queries: benchmark items search the documents.

Two stand-ins, since no text encoder is at hand: vector ``v`` belongs to document ``v``, and
the query vector of item ``i`` is the mean vector of label ``i mod 10``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import retrieval as rt
from tidewright.operators import scripts as sc
from tidewright.operators import term_index as ti
from tidewright.operators import vector_index as vi
from tidewright.plans.registry import query
from tidewright.plans.scripts import _JOIN_TYPES, IR_SQL, ir, sql_strip
from tidewright.session import scratch_path, spread, stored_once, table
from tidewright.sources import writers

TOP_K = 5
FETCH_K = 3 * TOP_K
LABELS = 10

_indexes: dict[tuple[str, str], rt.KeywordIndex] = {}


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def keyword_index(spark, sf):
    """The index of the documents, built once and shared by the queries below."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = rt.keyword_index(_documents(spark, sf), "doc_id")
    return _indexes[key]


@query(
    "j51_chunks",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk, md5(piece) AS digest FROM
        (SELECT doc_id, {sql_strip('p')} AS piece, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE length(piece) > 30""",
)
def j51(spark, sf):
    pieces = rt.chunks(_documents(spark, sf), ["doc_id"], separator="\n")
    return pieces.select("doc_id", "chunk", F.md5("chunk_text").alias("digest"))


_TOKENS = "list_filter(regexp_extract_all(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9_]+'), lambda t: length(t) > 1)"


@query(
    "j52_tokens",
    f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
)
def j52(spark, sf):
    words = _documents(spark, sf).select("doc_id", rt.tokens(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    "j53_keyword_index",
    f"""WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM w GROUP BY 1""",
)
def j53(spark, sf):
    return keyword_index(spark, sf).vocabulary


@query(
    "j53_corpus_stats",
    f"""WITH d AS (SELECT len({_TOKENS}) AS n FROM documents) SELECT count(*) AS documents, CAST(sum(n) AS DOUBLE) / count(*) AS mean_length FROM d""",
)
def j53_stats(spark, sf):
    sizes = _documents(spark, sf).select(F.size(rt.tokens(F.col("text"))).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("documents"), (F.sum("n") / F.count(F.lit(1))).alias("mean_length"))


_BM25 = f"""d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), n AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS mean FROM d),
  tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, n),
  idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
  q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, doc_id, round(sum(repeats * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 9) AS score
        FROM q JOIN idf USING (term) JOIN tf USING (term), n GROUP BY ALL),
  kw AS (SELECT item_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s
         WHERE score > 0 QUALIFY rank <= {FETCH_K})"""

_COSINE = f"""c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
  qv AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY 1),
  vs AS (SELECT qv.label, vec_id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 9) AS score FROM qv, embeddings),
  vt AS (SELECT label, vec_id, round(score, 4) AS score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM vs QUALIFY rank <= {FETCH_K})"""


def keyword_hits(spark, sf, k=FETCH_K):
    return rt.keyword_top_k(keyword_index(spark, sf), "doc_id", table(spark, sf, "benchmark"), "item_id", k)


def vector_hits(spark, sf, k=FETCH_K):
    vectors = table(spark, sf, "embeddings")
    centres = rt.mean_vectors(vectors, "label")
    return rt.vector_top_k(vectors, "vec_id", centres, "label", k)


@query("j54_bm25_top_k", f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM kw WHERE rank <= {TOP_K}")
def j54(spark, sf):
    return keyword_hits(spark, sf, TOP_K)


@query("j55_cosine_top_k", f"WITH {_COSINE} SELECT label, vec_id, score, rank FROM vt")
def j55(spark, sf):
    return vector_hits(spark, sf)


_term_indexes: dict[tuple[str, str], str] = {}


def term_index(spark, sf):
    """The term-ordered index of the documents, written once and opened by its path."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _term_indexes:
        base = scratch_path(spark, "term-index")
        ti.build_index(_documents(spark, sf), "doc_id", base)
        _term_indexes[key] = base
    return ti.open_index(spark, _term_indexes[key])


@query("j54_indexed_top_k", f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM kw WHERE rank <= {TOP_K}")
def j54_indexed(spark, sf):
    return ti.indexed_top_k(term_index(spark, sf), "doc_id", table(spark, sf, "benchmark"), "item_id", TOP_K)


@query(
    "j53_term_index",
    f"""WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL)
        SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences, md5(string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id)) AS digest FROM p GROUP BY 1""",
)
def j53_term_index(spark, sf):
    """What the blocks hold, opened by another session than the one that wrote them."""
    blocks = ti.entries(term_index(spark, sf).blocks, "term")
    cells = F.array_sort(F.collect_list(F.struct("doc", "tf")))
    spelled = F.array_join(F.transform(cells, lambda c: F.concat(c["doc"].cast("string"), F.lit(":"), c["tf"].cast("string"))), ",")
    return blocks.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"), F.md5(spelled).alias("digest"))


_vector_indexes: dict[tuple[str, str], str] = {}


def vector_index(spark, sf):
    """The bucket tables of the vectors, written once and opened by the queries below."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _vector_indexes:
        base = scratch_path(spark, "vector-index")
        vi.build_index(table(spark, sf, "embeddings"), "vec_id", base)
        _vector_indexes[key] = base
    return vi.open_index(spark, _vector_indexes[key])


def bucketed_hits(spark, sf, k=FETCH_K):
    centres = rt.mean_vectors(table(spark, sf, "embeddings"), "label")
    return vi.probed_top_k(vector_index(spark, sf), centres, "label", k, doc_id="vec_id")


# The same buckets by plain sums: a side is the sign of a sum of whole numbers.
_BUCKETS = f"""pl AS (SELECT t, b, i, CASE WHEN substr(md5(t || ':' || b || ':' || (i - 1)), 1, 1) < '8' THEN -1 ELSE 1 END AS s
    FROM (SELECT unnest(range({vi.TABLES})) AS t), (SELECT unnest(range({vi.BITS})) AS b), (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS i)),
  cv AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  vm AS (SELECT vec_id, t, b, sum(s * CAST(floor(CAST(x AS DOUBLE) * {vi.SCALE}) AS BIGINT)) AS m FROM cv JOIN pl USING (i) GROUP BY ALL),
  vb AS (SELECT vec_id, t, CAST(sum(CASE WHEN m >= 0 THEN 1 << b ELSE 0 END) AS INTEGER) AS bucket FROM vm GROUP BY ALL),
  qm AS (SELECT label, t, b, sum(s * CAST(floor(m * {vi.SCALE}) AS BIGINT)) AS m FROM c JOIN pl USING (i) GROUP BY ALL),
  qe AS (SELECT label, t, mask, CAST(sum(CASE WHEN m >= 0 THEN 1 << b ELSE 0 END) AS INTEGER) AS own, sum(CASE WHEN (mask >> b) & 1 = 1 THEN abs(m) ELSE 0 END) AS effort
         FROM qm, (SELECT CAST(unnest(range({1 << vi.BITS})) AS INTEGER) AS mask) GROUP BY ALL),
  qp AS (SELECT label, t, xor(own, mask) AS bucket FROM qe QUALIFY row_number() OVER (PARTITION BY label, t ORDER BY effort, mask) <= {vi.PROBES}),
  met AS (SELECT DISTINCT label, vec_id FROM qp JOIN vb USING (t, bucket)),
  bt AS (SELECT label, vec_id, round(vs.score, 4) AS score, row_number() OVER (PARTITION BY label ORDER BY vs.score DESC, vec_id) AS rank
         FROM met JOIN vs USING (label, vec_id) QUALIFY rank <= {FETCH_K})"""


@query("j55_bucketed", f"WITH {_COSINE}, {_BUCKETS} SELECT label, vec_id, score, rank FROM bt")
def j55_bucketed(spark, sf):
    return bucketed_hits(spark, sf)


@query(
    "j55_bucketed_recall",
    f"""WITH {_COSINE}, {_BUCKETS} SELECT count(*) AS asked, count(bt.vec_id) AS hits, round(count(bt.vec_id) / count(*), 6) AS recall
        FROM vt LEFT JOIN bt USING (label, vec_id)""",
)
def j55_bucketed_recall(spark, sf):
    return vi.recall(bucketed_hits(spark, sf), vector_hits(spark, sf), "label", "vec_id")


def _hit_lists(spark, sf):
    """The two ranked lists with the texts they point at, stored once for the queries below."""

    def with_text(hits):
        # The lists hold a few hits per query; the documents are looked up by a join on the id.
        return hits.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")

    def by_vector():
        labelled = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % LABELS).cast("int").alias("label"))
        near = vector_hits(spark, sf).withColumnRenamed("vec_id", "doc_id")
        return with_text(labelled.join(near, "label").select("item_id", "doc_id", "score", "rank"))

    vectors = stored_once(by_vector, spark, "vector-hits", sf)
    words = stored_once(lambda: with_text(keyword_hits(spark, sf)), spark, "keyword-hits", sf)
    return vectors, words


_LISTS = f"""{_BM25}, {_COSINE},
  vl AS (SELECT item_id, vec_id AS doc_id, rank, text FROM benchmark b JOIN vt ON b.item_id % 10 = vt.label JOIN (SELECT doc_id, text FROM documents) x ON x.doc_id = vec_id),
  kl AS (SELECT item_id, doc_id, rank, text FROM kw JOIN (SELECT doc_id, text FROM documents) x USING (doc_id))"""
_LISTS = _LISTS.replace("SELECT item_id, vec_id AS doc_id, rank, text FROM benchmark b", "SELECT item_id, vec_id AS doc_id, rank, x.text FROM benchmark b")


def _fusion_sql(k: str) -> str:
    return f"""u AS (SELECT item_id, doc_id, substr(text, 1, 100) AS key, 0 AS list, rank, 0.6::DOUBLE / (60 + rank) AS part FROM vl
      UNION ALL SELECT item_id, doc_id, substr(text, 1, 100), 1, rank, 0.4::DOUBLE / (60 + rank) FROM kl),
      m AS (SELECT item_id, key, round(sum(part), 12) AS score, arg_max(doc_id, list * 1000 + rank) AS doc_id, min(list * 1000 + rank) AS first FROM u GROUP BY ALL),
      fused AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM m {k})"""


@query("j56_rank_fusion", f"WITH {_LISTS}, {_fusion_sql('')} SELECT * FROM fused")
def j56(spark, sf):
    return rt.fuse(*_hit_lists(spark, sf), "item_id", "doc_id")


@query("j57_hybrid_search", f"WITH {_LISTS}, {_fusion_sql(f'QUALIFY rank <= {TOP_K}')} SELECT * FROM fused")
def j57(spark, sf):
    return rt.fuse(*_hit_lists(spark, sf), "item_id", "doc_id", k=TOP_K)


@query(
    "j58_query_text",
    f"""WITH {IR_SQL} SELECT script_id, concat_ws(' ', 'migrate ' || source_language || ' to pyspark',
        CASE WHEN len(joins) > 0 THEN array_to_string({_JOIN_TYPES}, ' ') || ' join' END, CASE WHEN len(aggregations) > 0 THEN 'aggregations ' || array_to_string(aggregations, ' ') END,
        CASE WHEN len(window_functions) > 0 THEN 'window functions ' || array_to_string(window_functions, ' ') END, CASE WHEN len(ctes) > 0 THEN 'CTE with clause pyspark' END,
        CASE WHEN len(procedural_flags) > 0 THEN 'procedural cursor loop exception handler' END, 'complexity ' || complexity_label) AS query_text FROM ir""",
)
def j58(spark, sf):
    return ir(spark, sf).select("script_id", sc.retrieval_query().alias("query_text"))


@query(
    "j59_second_query",
    f"""WITH {_LISTS}, {_fusion_sql(f'QUALIFY rank <= {TOP_K}')}, p AS (SELECT f.item_id, f.doc_id, f.rank, substr(x.text, 1, 80) AS key FROM fused f
          JOIN (SELECT doc_id, text FROM documents) x USING (doc_id)),
        e AS (SELECT item_id - 1 AS item_id, doc_id, rank, substr(text, 1, 80) AS key FROM kl WHERE rank <= 3 AND item_id - 1 IN (SELECT item_id FROM benchmark)),
        fresh AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.item_id = e.item_id AND p.key = e.key) QUALIFY row_number() OVER (PARTITION BY item_id, key ORDER BY rank) = 1),
        l AS (SELECT item_id, doc_id, 0 AS list, rank AS r FROM p UNION ALL SELECT item_id, doc_id, 1, rank FROM fresh)
        SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY list, r) AS rank FROM l""",
)
def j59(spark, sf):
    vectors, words = _hit_lists(spark, sf)
    texts = table(spark, sf, "documents").select("doc_id", "text")
    primary = rt.fuse(vectors, words, "item_id", "doc_id", k=TOP_K).join(texts, "doc_id")
    # Every item gets a second query: the top three keyword hits of its neighbour.
    second = words.filter(F.col("rank") <= 3).withColumn("item_id", F.col("item_id") - 1)
    second = second.join(table(spark, sf, "benchmark").select("item_id"), "item_id", "left_semi")
    return rt.append_unseen(primary, second, "item_id", "doc_id")


@query(
    "j60_rebuild_index",
    f"""WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT 2 AS version, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS words FROM
        (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL)""",
)
def j60(spark, sf):
    # A first index over one language is replaced by one over all of them.
    base = scratch_path(spark, "index")
    docs = _documents(spark, sf)
    english = table(spark, sf, "documents").filter(F.col("lang") == "en")
    writers.write_version(rt.postings(english, "doc_id"), base)
    version = writers.write_version(rt.postings(docs, "doc_id"), base)
    index = writers.read_version(spark, base)
    return index.agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("words"))
