"""Inputs for the registered queries, derived by Spark from the whole given tables.

The SQL is plain enough to run unchanged in any engine; ``{name}`` marks a source table.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.mentions import extract_mentions
from pairlens.plans.evaluate import orient_on_passive
from pairlens.sources.catalogue import argument_types, relation_catalogue

# One sentence per order line: a supplier and a nation.
PLACE_SENTENCES = """
SELECT l_orderkey * 10 + l_linenumber AS sent_id,
       'has-installations' AS rel_type,
       'Report : <ORG>Supplier ' || CAST(s_suppkey AS STRING) || '</ORG> ' ||
       CASE WHEN s_suppkey % 4 = 1 THEN 'is based in'
            WHEN s_suppkey % 4 = 2 AND l_partkey % 2 = 0 THEN 'sold goods to'
            WHEN l_partkey % 8 = 0 THEN 'is based in'
            WHEN l_partkey % 8 = 1 THEN 'headquarters'
            WHEN l_partkey % 8 = 2 THEN 'has offices in'
            WHEN l_partkey % 8 = 3 THEN 'sold goods to'
            WHEN l_partkey % 8 = 4 THEN ', and'
            WHEN l_partkey % 8 = 5 THEN 'keeps head office in'
            WHEN l_partkey % 8 = 6 THEN 'opened offices in'
            ELSE 'ships a very large number of boxes to' END ||
       ' <LOC>NATION_' || CAST((s_nationkey + CASE WHEN (l_orderkey + l_linenumber) % 5 = 0
                                                   THEN 1 + l_partkey % 3 ELSE 0 END) % 25 AS STRING) ||
       '</LOC> this year .' AS text,
       l_quantity / 50 AS score,
       l_orderkey % 4 = 0 AND s_suppkey % 5 <> 0 AS in_s,
       false AS passive
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""

# One sentence per order: a customer and one or two firms, in both argument orders.
PEOPLE_SENTENCES = """
SELECT 1000000000000 + o_orderkey AS sent_id,
       CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'founder' ELSE 'founder2' END
            WHEN o_orderkey % 6 IN (0, 5) THEN 'founder2'
            WHEN o_orderkey % 6 = 1 THEN 'studied'
            ELSE 'affiliation2' END AS rel_type,
       CASE WHEN o_orderkey % 7 = 0
            THEN 'Today <ORG>Firm ' || CAST(c_nationkey * 7 + o_orderkey % 3 AS STRING) || ' Inc.</ORG> was founded by <PER>Customer '
                 || CAST(c_custkey AS STRING) || '</PER> alone .'
            ELSE '<PER>Customer ' || CAST(c_custkey AS STRING) || '</PER> ' ||
                 CASE WHEN o_orderkey % 6 = 0 THEN 'founded'
                      WHEN o_orderkey % 6 = 1 THEN 'graduated from'
                      WHEN o_orderkey % 6 = 2 THEN 'is the chairman of'
                      WHEN o_orderkey % 6 = 3 THEN 'works for'
                      WHEN o_orderkey % 6 = 4 THEN ', and'
                      ELSE 'co-founded' END ||
                 ' <ORG>Firm ' || CAST(c_nationkey * 7 + o_orderkey % 3 AS STRING) || ' Inc.</ORG> ' ||
                 CASE WHEN o_orderkey % 5 = 0 THEN 'which acquired <ORG>Firm '
                           || CAST(c_nationkey * 7 + 3 + o_orderkey % 4 AS STRING) || ' Ltd</ORG> ' ELSE '' END ||
                 'last month .' END AS text,
       o_totalprice / 500000 AS score,
       o_orderkey % 4 <> 1 AS in_s,
       o_orderkey % 7 = 0 AS passive
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

KB = """
SELECT 'has-installations' AS rel_type, 'Supplier ' || CAST(s_suppkey AS STRING) AS e1,
       'NATION_' || CAST(s_nationkey AS STRING) AS e2
FROM {supplier} WHERE s_suppkey % 3 <> 0
UNION ALL
SELECT 'founder2' AS rel_type, 'Customer ' || CAST(c_custkey AS STRING) AS e1,
       'Firm ' || CAST(c_nationkey * 7 AS STRING) || ' Inc.' AS e2
FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL
SELECT 'founder' AS rel_type, 'Firm ' || CAST(c_nationkey * 7 AS STRING) || ' Inc.' AS e1,
       'Customer ' || CAST(c_custkey AS STRING) AS e2
FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL
SELECT 'studied' AS rel_type, 'Customer ' || CAST(c_custkey AS STRING) AS e1,
       'Firm ' || CAST(c_nationkey * 7 + 1 AS STRING) || ' Inc.' AS e2
FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL
SELECT 'affiliation2' AS rel_type, 'Customer ' || CAST(c_custkey AS STRING) AS e1,
       'Firm ' || CAST(c_nationkey * 7 + 2 AS STRING) || ' Inc.' AS e2
FROM {customer} WHERE c_custkey % 3 = 1
"""

# Text records and lines in the formats the readers take, one per row of a table.
ORDER_FACTS = """
SELECT o_orderkey, 'Customer ' || CAST(c_custkey AS STRING) AS e1,
       'Firm ' || CAST(c_nationkey * 7 + o_orderkey % 3 AS STRING) || ' Inc.' AS e2,
       o_totalprice / 500000 AS score, o_orderkey % 7 = 0 AS passive,
       CASE WHEN o_orderkey % 2 = 0 THEN 'founded' ELSE 'is the chairman of' END AS bet,
       CASE WHEN o_orderkey % 3 = 0 THEN 'founder2' ELSE 'affiliation2' END AS rel_type
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
SYSTEM_RECORDS = f"""
SELECT 'instance: ' || e1 || CHR(9) || e2 || ' score:' || CAST(score AS STRING) || CHR(10) ||
       'sentence: Today ' || e1 || ' ' || bet || ' ' || e2 || CHR(10) ||
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'pattern_bef: Today' || CHR(10) END ||
       'pattern_bet: ' || bet || CHR(10) ||
       'passive voice: ' || CASE WHEN passive THEN 'True' ELSE 'False' END AS value
FROM ({ORDER_FACTS})
"""
CLASSIFIED_RECORDS = f"""
SELECT 'instance: ' || e1 || CHR(9) || e2 || CHR(10) ||
       'sentence: <PER>' || e1 || '</PER> ' || bet || ' <ORG>' || e2 || '</ORG> last month .' || CHR(10) ||
       'rel_type: ' || rel_type AS value
FROM ({ORDER_FACTS})
"""
POSITIVE_RECORDS = f"""
SELECT rel_type || '_positive.txt' AS file_name,
       'instance : ' || e1 || CHR(9) || e2 || CHR(9) || CAST(score AS STRING) || CHR(10) ||
       'sentence : <PER>' || e1 || '</PER> ' || bet || ' <ORG>' || e2 || '</ORG> last month .' || CHR(10) ||
       'bef_words: ' || CHR(10) || 'bet_words: ' || bet || CHR(10) || 'aft_words: ' || CHR(10) ||
       'passive voice: ' || CASE WHEN passive THEN 'True' ELSE 'False' END AS value
FROM ({ORDER_FACTS})
"""
TRAINING_LINES = f"""
SELECT 'id:' || CAST(o_orderkey AS STRING) || CHR(9) || rel_type || CHR(9) || e1 || CHR(9) || e2 || CHR(9) ||
       '<PER>' || e1 || '</PER> ' || bet || ' <ORG>' || e2 || '</ORG> last month .' AS value
FROM ({ORDER_FACTS})
UNION ALL SELECT '# order ' || CAST(o_orderkey AS STRING) AS value FROM {{orders}} WHERE o_orderkey % 10 = 0
UNION ALL SELECT '' AS value FROM {{orders}} WHERE o_orderkey % 10 = 1
"""
# Labelled sentences with the phrases of the derived corpus in varied surroundings; a share has the label of another phrase.
LABELLED_ROWS = """
SELECT id, CASE WHEN id % 11 = 3 THEN other ELSE rel_type END AS rel_type, t1, e1, bet, t2, e2,
       CASE WHEN v % 4 = 0 THEN '' WHEN v % 4 = 1 THEN 'Today ' WHEN v % 4 = 2 THEN 'In ' || place || ' ' ELSE 'Report : ' END AS bef,
       CASE WHEN v % 5 = 0 THEN 'last month .' WHEN v % 5 = 1 THEN 'this year .' WHEN v % 5 = 2 THEN 'in ' || year || ' .'
            WHEN v % 5 = 3 THEN 'since ' || year || ' .' ELSE 'before ' || place || ' did so .' END AS aft
FROM (
  SELECT o_orderkey AS id, 'PER' AS t1, 'Customer ' || CAST(c_custkey AS STRING) AS e1,
         'ORG' AS t2, 'Firm ' || CAST(c_nationkey * 7 + o_orderkey % 3 AS STRING) || ' Inc.' AS e2,
         CASE WHEN o_orderkey % 5 = 0 THEN 'founded' WHEN o_orderkey % 5 = 1 THEN 'graduated from'
              WHEN o_orderkey % 5 = 2 THEN 'is the chairman of' WHEN o_orderkey % 5 = 3 THEN 'works for' ELSE 'co-founded' END AS bet,
         CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'founder2' WHEN o_orderkey % 5 = 1 THEN 'studied' ELSE 'affiliation2' END AS rel_type,
         CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'affiliation2' ELSE 'founder2' END AS other,
         o_custkey % 97 AS v, CAST(1990 + o_custkey % 13 AS STRING) AS year, n_name AS place
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  UNION ALL
  SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, 'ORG' AS t1, 'Supplier ' || CAST(s_suppkey AS STRING) AS e1,
         'LOC' AS t2, 'NATION_' || CAST(s_nationkey AS STRING) AS e2,
         CASE WHEN l_partkey % 6 = 0 THEN 'is based in' WHEN l_partkey % 6 = 1 THEN 'headquarters'
              WHEN l_partkey % 6 = 2 THEN 'has offices in' WHEN l_partkey % 6 = 3 THEN 'sold goods to'
              WHEN l_partkey % 6 = 4 THEN 'keeps head office in' ELSE 'opened offices in' END AS bet,
         CASE WHEN l_partkey % 6 = 3 THEN 'owns' ELSE 'has-installations' END AS rel_type,
         CASE WHEN l_partkey % 6 = 3 THEN 'has-installations' ELSE 'owns' END AS other,
         l_suppkey % 89 AS v, CAST(1990 + l_partkey % 13 AS STRING) AS year, n_name AS place
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
)
"""
LABELLED_LINES = f"""
SELECT 'id:' || CAST(id AS STRING) || CHR(9) || rel_type || CHR(9) || e1 || CHR(9) || e2 || CHR(9) || bef ||
       '<' || t1 || '>' || e1 || '</' || t1 || '> ' || bet || ' <' || t2 || '>' || e2 || '</' || t2 || '> ' || aft AS value
FROM ({LABELLED_ROWS})
"""
FEATURE_LINES = """
SELECT CAST(p_partkey AS STRING) || CHR(9) || p_type || CHR(9) || p_name || '  ' || p_brand || ' ' AS value FROM {part}
"""
SHINGLE_RECORDS = """
SELECT 'e1: ' || p_brand || CHR(10) || 'e2: ' || p_type || CHR(10) || 'sentence: ' || p_name || CHR(10) ||
       'shingles: ' || p_name || '  ' || CAST(p_size AS STRING) || '_SIZE' AS value
FROM {part}
"""
COMMENTED_LINES = """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN '# ' || CAST(o_orderkey AS STRING)
            WHEN o_orderkey % 10 = 1 THEN '' ELSE ' order ' || CAST(o_orderkey AS STRING) || ' ' END AS value
FROM {orders}
"""
NTRIPLE_LINES = """
SELECT '<http://dbpedia.org/resource/Supplier_' || CAST(s_suppkey AS STRING) || '_(firm)> <location> ' ||
       '<http://dbpedia.org/resource/NATION_' || CAST(s_nationkey AS STRING) || ',_City_' || CAST(s_suppkey % 5 AS STRING)
       || '> .' AS value
FROM {supplier}
UNION ALL SELECT 'broken line ' || CAST(s_suppkey AS STRING) AS value FROM {supplier} WHERE s_suppkey % 9 = 0
"""
YAGO_LINES = """
SELECT '<en/Supplier_' || CAST(s_suppkey AS STRING) || '_(firm)>' || CHR(9) || 'isLocatedIn' || CHR(9) ||
       '<NATION_' || CAST(s_nationkey AS STRING) || '.,_City_' || CAST(s_suppkey % 5 AS STRING) || '>' AS value
FROM {supplier}
"""
FREEBASE_LINES = """
SELECT 'Supplier ' || CAST(s_suppkey AS STRING) || CHR(9) || 'place_founded' || CHR(9) ||
       ' NATION ' || CAST(s_nationkey AS STRING) AS value
FROM {supplier}
UNION ALL SELECT '# supplier ' || CAST(s_suppkey AS STRING) AS value FROM {supplier} WHERE s_suppkey % 4 = 0
"""
MANUAL_LINES = """
SELECT 'Supplier ' || CAST(s_suppkey AS STRING) || CHR(9) || 'Town ' || CAST(s_suppkey % 3 AS STRING) AS value
FROM {supplier}
UNION ALL SELECT '# none' AS value FROM {supplier} WHERE s_suppkey % 4 = 0
"""

# Lines and records that the readers of their format must set aside.
BAD_TRAINING_LINES = """
SELECT 'id:x' || CAST(o_orderkey AS STRING) || CHR(9) || 'owns' || CHR(9) || 'A' || CHR(9) || 'B' || CHR(9) || 's' AS value FROM {orders}
UNION ALL SELECT 'id:' || CAST(o_orderkey AS STRING) || CHR(9) || 'owns' AS value FROM {orders} WHERE o_orderkey % 3 = 0
"""
BAD_FEATURE_LINES = """
SELECT 'p' || CAST(p_partkey AS STRING) || CHR(9) || p_type || CHR(9) || p_name AS value FROM {part}
UNION ALL SELECT CAST(p_partkey AS STRING) || CHR(9) || p_name AS value FROM {part}
"""
BAD_CLASSIFIED_RECORDS = "SELECT 'instance: ' || p_brand || CHR(10) || 'sentence: ' || p_name AS value FROM {part}"
BAD_SHINGLE_RECORDS = "SELECT 'e1: ' || p_brand || CHR(10) || 'sentence: ' || p_name || CHR(10) || 'shingles: a b' AS value FROM {part}"
BAD_POSITIVE_RECORDS = """
SELECT 'instance: ' || p_brand || CHR(9) || p_type || CHR(10) || 'sentence: ' || p_name AS value, 'owns_positives.txt' AS file_name
FROM {part}
"""

# Labelled and unlabelled texts for similarity classification: whole documents.
PASSAGES = """
SELECT d.doc_id AS rel_id, d.text AS text, 'q' || CAST(quality AS STRING) || 't' || CAST(toxic AS STRING) AS rel_type
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

SENTENCES = f"SELECT * FROM ({PLACE_SENTENCES}) UNION ALL SELECT * FROM ({PEOPLE_SENTENCES})"

# Fixed value: the relations the derived sentences can state.
RELATIONS_IN_USE = [
    "has-installations", "founder", "founder2", "owns", "affiliation", "affiliation2", "studied", "studied2",
]
TABLES = ["lineitem", "supplier", "orders", "customer", "documents", "labels", "nation", "benchmark", "part"]

#: The tables that work grows with.
DEALT = {"lineitem", "orders", "documents"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that Spark's reader cuts into few parts, as a row group is never cut, is dealt over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = 2 * spark.sparkContext.defaultParallelism
    return rows.repartition(parts) if name in DEALT and rows.rdd.getNumPartitions() < parts else rows


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SENTENCES)


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, KB)


def catalogue(spark: SparkSession) -> DataFrame:
    return relation_catalogue(spark, RELATIONS_IN_USE)


def types() -> list[tuple[str, str]]:
    return argument_types(RELATIONS_IN_USE)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_mentions(sentences(spark, sf_dir), types=types())


def facts_from(found: DataFrame, cat: DataFrame) -> DataFrame:
    """System facts: the mentions the system reports, with the argument types of their relation."""
    kinds = cat.select("rel_type", F.col("e1_type").alias("k1"), F.col("e2_type").alias("k2"))
    same = (F.col("e1_type") == F.col("k1")) & (F.col("e2_type") == F.col("k2"))
    turned = F.col("passive") & (F.col("e1_type") == F.col("k2")) & (F.col("e2_type") == F.col("k1"))
    rows = found.filter("in_s AND score >= 0.5").join(F.broadcast(kinds), "rel_type").filter(same | turned)
    rows = rows.select(
        "rel_type", "e1", "e2", "score",
        *[F.array_join(c, " ").alias(c) for c in ("bef", "bet", "aft")],
        F.col("text").alias("sentence"), "passive",
    )
    return orient_on_passive(rows)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_from(mentions(spark, sf_dir), catalogue(spark))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, PASSAGES)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
