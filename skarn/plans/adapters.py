"""Canonical tables (cells, expr, genes, embeddings, predictions, metrics, catalog) from the driver's tables, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame and the SQL for the same rows; `WITH` parts are named in {braces}."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def registered() -> tuple[dict, dict]:
    return _QUERIES, _SQL


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark, d) -> DataFrame:
    """Customers as cells: batch = segment, sample = nation, label 1 for the first two regions."""
    nation = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").cast("string").alias("cell_id"), F.col("c_mktsegment").alias("batch"), F.concat(F.lit("S"), F.col("c_nationkey")).alias("sample_id"),
        F.when(F.col("n_regionkey") < 2, "pos").otherwise("neg").alias("label_raw"), (F.col("n_regionkey") < 2).cast("int").alias("label"),
        F.concat(F.lit("T"), F.col("c_custkey") % 6).alias("cell_type"), F.col("c_acctbal").alias("score"))


CELLS = """cells AS (SELECT CAST(c_custkey AS VARCHAR) AS cell_id, c_mktsegment AS batch, 'S' || c_nationkey AS sample_id,
  CASE WHEN n_regionkey < 2 THEN 'pos' ELSE 'neg' END AS label_raw, CAST(n_regionkey < 2 AS INTEGER) AS label,
  'T' || (c_custkey % 6) AS cell_type, c_acctbal AS score FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def expr(spark, d, gene: str = "kind") -> DataFrame:
    """Line items as expression: cell = customer, gene = brand and type of the part (or the part), value = quantity."""
    li, o = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    if gene == "kind":
        x = x.join(read(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        g = F.concat("p_brand", F.lit("/"), "p_type")
    else:
        g = F.col("l_partkey").cast("string")
    return x.groupBy(F.col("o_custkey").cast("string").alias("cell_id"), g.alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


EXPR = """expr AS (SELECT CAST(o_custkey AS VARCHAR) AS cell_id, p_brand || '/' || p_type AS gene_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
PARTEXPR = """pexpr AS (SELECT CAST(o_custkey AS VARCHAR) AS cell_id, CAST(l_partkey AS VARCHAR) AS gene_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def genes(spark, d) -> DataFrame:
    """Parts as genes: some with versioned identifiers, some with lower-case symbols, some repeated."""
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    ens = F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0"))
    return p.select(
        k.cast("string").alias("gene_id"), F.when(k % 3 == 0, F.concat(ens, F.lit(".3_2"))).when(k % 3 == 1, F.lower(F.regexp_replace("p_brand", "#", ""))).otherwise(F.col("p_name")).alias("gene_name"),
        ens.alias("ensembl_id"), F.concat(F.lit("sym"), k % 150).alias("symbol"), k.cast("int").alias("pos"))


GENES = """genes AS (SELECT CAST(p_partkey AS VARCHAR) AS gene_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') || '.3_2' WHEN p_partkey % 3 = 1 THEN lower(replace(p_brand, '#', '')) ELSE p_name END AS gene_name,
  'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS ensembl_id, 'sym' || (p_partkey % 150) AS symbol, CAST(p_partkey AS INTEGER) AS pos FROM part)"""


def embeddings(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
                    F.concat(F.lit("L"), F.col("label")).alias("label"), F.concat(F.lit("B"), F.col("vec_id") % 4).alias("batch"))


EMB = """emb AS (SELECT CAST(vec_id AS VARCHAR) AS cell_id, [x::DOUBLE FOR x IN embedding] AS embedding, 'L' || label AS label, 'B' || (vec_id % 4) AS batch FROM embeddings)"""


def predictions(spark, d) -> DataFrame:
    """Documents with labels as scored rows; the score is a function of the length."""
    p = read(spark, d, "documents").select("doc_id", "source", "n_chars").join(read(spark, d, "labels"), "doc_id")
    s = F.col("n_chars") / (F.col("n_chars") + 1000)
    return p.select(F.concat(F.lit("run"), F.col("doc_id") % 3).alias("run_id"), (F.col("doc_id") % 5).cast("int").alias("fold"), F.col("source").alias("sample_id"), F.col("doc_id").cast("string").alias("row_id"),
                    F.col("quality").alias("label"), (s > 0.6).cast("int").alias("pred"), F.round(s, 3).alias("pred_score"))


PREDS = """preds AS (SELECT 'run' || (doc_id % 3) AS run_id, CAST(doc_id % 5 AS INTEGER) AS fold, source AS sample_id, CAST(doc_id AS VARCHAR) AS row_id, quality AS label,
  CAST(n_chars / (n_chars + 1000) > 0.6 AS INTEGER) AS pred, round(n_chars / (n_chars + 1000), 3) AS pred_score FROM documents JOIN labels USING (doc_id))"""


def metrics(spark, d) -> DataFrame:
    """Events as metric rows: model = user modulo 12, exp = user modulo 7, metric = event type, fold = event modulo 5."""
    e = read(spark, d, "events")
    return e.select(
        F.concat(F.lit("r"), F.col("user_id")).alias("run_id"), F.concat(F.lit("exp"), F.col("user_id") % 7).alias("exp"),
        F.element_at(F.array(*map(F.lit, MODELS)), (F.col("user_id") % 12 + 1).cast("int")).alias("model"),
        F.when(F.col("event_id") % 2 == 0, "avg").otherwise("vote").alias("strategy"), (F.col("event_id") % 5).cast("int").alias("fold"), F.col("event_type").alias("metric"), F.col("value"))


MODELS = ("hvg", "pca_n20", "pca_n100", "scVI", "GF-V1", "gf_v2_ft", "scGPT_cancer", "scgpt_bc", "SCimilarity", "CellPLM", "state_se", "random")
METRICS = f"""metrics AS (SELECT 'r' || user_id AS run_id, 'exp' || (user_id % 7) AS exp, {list(MODELS)}[CAST(user_id % 12 + 1 AS INTEGER)] AS model,
  CASE WHEN event_id % 2 = 0 THEN 'avg' ELSE 'vote' END AS strategy, CAST(event_id % 5 AS INTEGER) AS fold, event_type AS metric, value FROM events)"""


def catalog(spark, d) -> DataFrame:
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    names = F.when(k % 4 == 0, F.array(F.lit("rna"))).when(k % 4 == 1, F.array(F.lit("rna"), F.lit("atac"))).when(k % 4 == 2, F.array(F.lit("protein"))).otherwise(F.array().cast("array<string>"))
    return s.select(F.col("s_name").alias("model_name"), (2015 + k % 10).cast("int").alias("year"), F.when(k % 3 == 0, "published").otherwise("preprint").alias("status"),
                    F.when(k % 2 == 0, "foundation").otherwise("baseline").alias("category"), names.alias("modalities"), F.when(k % 5 != 0, F.concat(F.lit("https://host/"), k)).alias("github_url"), (k % 7 == 0).alias("benchmarked"), F.col("s_acctbal").alias("size"))


CATALOG = """catalog AS (SELECT s_name AS model_name, CAST(2015 + s_suppkey % 10 AS INTEGER) AS year, CASE WHEN s_suppkey % 3 = 0 THEN 'published' ELSE 'preprint' END AS status,
  CASE WHEN s_suppkey % 2 = 0 THEN 'foundation' ELSE 'baseline' END AS category,
  CASE s_suppkey % 4 WHEN 0 THEN ['rna'] WHEN 1 THEN ['rna', 'atac'] WHEN 2 THEN ['protein'] ELSE []::VARCHAR[] END AS modalities,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'https://host/' || s_suppkey END AS github_url, s_suppkey % 7 = 0 AS benchmarked, s_acctbal AS size FROM supplier)"""
