"""Sensitive-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import masks, rules, sql_functions
from tidewright.plans import corpus
from tidewright.plans.registry import query, quote
from tidewright.session import spread, table

_WORDS = rf"\b(?:{'|'.join(fv.SENSITIVE_NAMES)})\b"


@query(
    "j01_sensitive_names",
    f"""WITH scr AS ({corpus.SCRIPTS_SQL}), w AS (SELECT DISTINCT script_id, unnest(regexp_extract_all(lower(source), {quote(_WORDS)})) AS name FROM scr)
        SELECT name, count(*) AS scripts FROM w GROUP BY 1""",
)
def j01(spark, sf):
    words = rules.unnest(corpus.scripts(spark, sf), [], masks.sensitive_words(F.col("source")), "name")
    return words.groupBy("name").agg(F.count(F.lit(1)).alias("scripts"))


# The documents hold no PAN or IFSC values: every tenth gets one of each.
_DOC_TEXT = "CASE WHEN doc_id % 10 = 0 THEN text || ' PAN ABCDE1234F IFSC HDFC0001234' ELSE text END"


def _documents(spark, sf):
    marked = F.concat("text", F.lit(" PAN ABCDE1234F IFSC HDFC0001234"))
    text = F.when(F.col("doc_id") % 10 == 0, marked).otherwise(F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", "lang", text.alias("text"))


def _hits_sql(source: str, bound: str) -> str:
    parts = [
        f"SELECT grp, '{kind}' AS kind, CAST(sum(len(regexp_extract_all(text, {quote(bound + p + bound)}))) AS BIGINT) AS hits FROM s GROUP BY grp"
        for kind, p in fv.VALUE_PATTERNS.items()
    ]
    return f"WITH s AS ({source}) " + " UNION ALL ".join(parts)


_ALL_TEXTS = f"SELECT 'doc ' || lang AS grp, {_DOC_TEXT} AS text FROM documents UNION ALL SELECT 'turn ' || role, text FROM conversations"


def _value_hits(spark, sf, bounded):
    docs = _documents(spark, sf).select(F.concat(F.lit("doc "), "lang").alias("grp"), "text")
    turns = spread(table(spark, sf, "conversations")).select(F.concat(F.lit("turn "), "role").alias("grp"), "text")
    counted = docs.unionByName(turns).select("grp", F.inline(masks.value_counts(F.col("text"), bounded)))
    return counted.groupBy("grp", "kind").agg(F.sum("hits").alias("hits"))


@query("j02_value_scan", _hits_sql(_ALL_TEXTS, ""))
def j02(spark, sf):
    return _value_hits(spark, sf, bounded=False)


@query("j02_value_scan_bounded", _hits_sql(_ALL_TEXTS, r"\b"))
def j02_bounded(spark, sf):
    return _value_hits(spark, sf, bounded=True)


_MASKED_SQL = (
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', '****@\1', 'g'),
    '[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?([0-9]{4})', '****-****-****-\1', 'g'),
    '[2-9][0-9]{7}([0-9]{4})', '********\1', 'g'), '[6-9][0-9]{5}([0-9]{4})', '****\1', 'g'), '[A-Z]{5}[0-9]{4}', 'XXXXX0000', 'g')"""
)


@query(
    "j03_mask_text",
    f"SELECT doc_id, md5({_MASKED_SQL}) AS masked FROM (SELECT doc_id, {_DOC_TEXT} AS text FROM documents)",
)
def j03_text(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(masks.mask_text(F.col("text"))).alias("masked"))


@query(
    "j03_mask_columns",
    """SELECT c_custkey, 'XXXXX0000' || 'F' AS pan, '****@mail.example.com' AS email, '****' || right(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 4) AS phone,
       '****-****-****-' || right(lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 4) AS card FROM customer""",
)
def j03_columns(spark, sf):
    digits = F.col("c_custkey").cast("string")
    people = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("ABCDE"), F.lpad(F.pmod("c_custkey", F.lit(10000)).cast("string"), 4, "0"), F.lit("F")).alias("pan"),
        F.concat(F.lit("user"), digits, F.lit("@mail.example.com")).alias("email"),
        F.concat(F.lit("9"), F.lpad(digits, 9, "0")).alias("phone"),
        F.concat(F.lit("4111"), F.lpad(digits, 12, "0")).alias("card"),
    )
    return people.select(
        "c_custkey",
        masks.mask_pan(F.col("pan")).alias("pan"),
        masks.mask_email(F.col("email")).alias("email"),
        masks.mask_phone(F.col("phone")).alias("phone"),
        masks.mask_card(F.col("card")).alias("card"),
    )


@query(
    "j03_sql_functions",
    """SELECT c_custkey, '****-****-****-' || right(lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 4) AS card, '****@mail.example.com' AS email,
       '****' || right(c_name, 4) AS phone, sha256(CAST(c_custkey AS VARCHAR)) AS id_hash, upper(c_mktsegment) AS label FROM customer""",
)
def j03_sql(spark, sf):
    sql_functions.register(spark)
    return spark.sql(
        """SELECT c_custkey, mask_card('4111' || lpad(c_custkey, 12, '0')) AS card, mask_email('user' || c_custkey || '@mail.example.com') AS email,
                  mask_phone(c_name) AS phone, hash_id(CAST(c_custkey AS STRING)) AS id_hash, flag_label(c_mktsegment || ' loop') AS label
           FROM {customer}""",
        customer=table(spark, sf, "customer"),
    )


@query(
    "j04_hashed_join",
    """SELECT sha256('s7' || c_custkey) AS customer_hash, c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
       GROUP BY ALL""",
)
def j04(spark, sf):
    orders = table(spark, sf, "orders").select(masks.hash_id(F.col("o_custkey"), "s7").alias("customer_hash"))
    customers = table(spark, sf, "customer").select(masks.hash_id(F.col("c_custkey"), "s7").alias("customer_hash"), "c_mktsegment")
    counts = orders.groupBy("customer_hash").agg(F.count(F.lit(1)).alias("orders"))
    return counts.join(customers, "customer_hash").select("customer_hash", "c_mktsegment", "orders")


@query(
    "j05_key_profile",
    """WITH o AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0),
       p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P')
       SELECT 'orders.o_custkey' AS key_name, count(*) AS row_count, count(*) - count(k) AS null_rows, count(DISTINCT k) AS distinct_keys,
              count(*) FILTER (k IS NOT NULL AND k NOT IN (SELECT k FROM c)) AS orphan_rows FROM o
       UNION ALL SELECT 'lineitem.l_orderkey', count(*), 0, count(DISTINCT l_orderkey), count(*) FILTER (l_orderkey NOT IN (SELECT k FROM p)) FROM lineitem""",
)
def j05(spark, sf):
    no_key = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))
    orders = table(spark, sf, "orders")
    holders = table(spark, sf, "customer").filter("c_acctbal > 0")
    settled = orders.filter(F.col("o_orderstatus") != "P")
    by_customer = masks.key_profile(orders.select(no_key.alias("k")), "k", holders, "c_custkey")
    by_order = masks.key_profile(table(spark, sf, "lineitem"), "l_orderkey", settled, "o_orderkey")
    named = F.lit("orders.o_custkey").alias("key_name"), F.lit("lineitem.l_orderkey").alias("key_name")
    return by_customer.select(named[0], "*").unionByName(by_order.select(named[1], "*"))
