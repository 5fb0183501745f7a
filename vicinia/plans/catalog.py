"""Registry of the similarity engine's queries and their SQL twins.

Random choices are drawn once from fixed seeds and stand as constants in both. Searches
ask with every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinia.functions import encoding, sampling
from vicinia.functions.stable import stable_column
from vicinia.operators import metrics, pairs
from vicinia.operators.alignment import string_distance
from vicinia.operators.ordered import as_of
from vicinia.plans import search
from vicinia.plans.families import Cosine, Family, Stable, Voronoi
from vicinia.plans.tree import MedoidTree
from vicinia.sources import arrays, vectors
from vicinia.sources.bucketed import BucketedStore
from vicinia.sources.buckets import BucketStore
from vicinia.sources.workspace import Workspace
from vicinia.streaming.as_of import as_of_stream, timers

DIM, Q, PLACES = 64, 5, 6
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.parquet(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding")


def asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") % 100 == 0)


def rounded(df: DataFrame, column: str = "distance") -> DataFrame:
    return df.withColumn(column, F.round(column, PLACES) + 0.0)  # no negative zero


E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
TRUE = "e AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vec FROM embeddings)"
Z = "list_zip(a.vec, b.vec)"


def total(f: str, over: str = Z) -> str:
    return f"list_sum(list_transform({over}, lambda z: CAST({f} AS DOUBLE)))"


def matrix_sql(formula: str, source: str = E, extra: str = "", more: str = "") -> str:
    return f"WITH {source}{extra} SELECT a.id AS id_a, b.id AS id_b, round({formula}, 6) + 0.0 AS distance FROM e a CROSS JOIN e b{more} WHERE a.id % 100 = 0"


P, W = 1.23, [round(0.5 + (i % 7) / 4, 2) for i in range(DIM)]
_w = "[" + ",".join(f"{x}::DOUBLE" for x in W) + "]"
_both, _first, _second, _none = (total(f"CASE WHEN {c} THEN 1 ELSE 0 END") for c in ("z[1]=1 AND z[2]=1", "z[1]=1 AND z[2]=0", "z[1]=0 AND z[2]=1", "z[1]=0 AND z[2]=0"))
_dot, _aa, _bb = total("z[1]*z[2]"), total("z[1]*z[1]"), total("z[2]*z[2]")
NUMERIC_SQL = {
    "euclidean": f"sqrt({total('(z[1]-z[2])*(z[1]-z[2])')})",
    "sqeuclidean": total("(z[1]-z[2])*(z[1]-z[2])"),
    "cityblock": total("abs(z[1]-z[2])"),
    "chebyshev": f"list_max(list_transform({Z}, lambda z: abs(z[1]-z[2])))",
    "minkowski": f"pow({total(f'pow(abs(z[1]-z[2]), {P})')}, 1/{P}::DOUBLE)",
    "wminkowski": f"pow({total(f'pow(z[3]*abs(z[1]-z[2]), {P})', f'list_zip(a.vec, b.vec, {_w})')}, 1/{P}::DOUBLE)",
    "cosine": f"1 - {_dot} / (sqrt({_aa}) * sqrt({_bb}))",
    "canberra": total("CASE WHEN abs(z[1])+abs(z[2]) > 0 THEN abs(z[1]-z[2])/(abs(z[1])+abs(z[2])) ELSE 0 END"),
    "braycurtis": f"{total('abs(z[1]-z[2])')} / {total('abs(z[1]+z[2])')}",
}
BOOLEAN_SQL = {
    "hamming": f"({_first}+{_second}) / {DIM}",
    "jaccard": f"({_first}+{_second}) / ({_both}+{_first}+{_second})",
    "dice": f"({_first}+{_second}) / (2*{_both}+{_first}+{_second})",
    "kulsinski": f"({_first}+{_second}-{_both}+{DIM}) / ({_first}+{_second}+{DIM})",
    "rogerstanimoto": f"2*({_first}+{_second}) / ({_both}+{_none}+2*({_first}+{_second}))",
    "russellrao": f"({DIM}-{_both}) / {DIM}",
    "sokalmichener": f"2*({_first}+{_second}) / ({_both}+{_none}+2*({_first}+{_second}))",
    "sokalsneath": f"2*({_first}+{_second}) / ({_both}+2*({_first}+{_second}))",
    "yule": f"2*{_first}*{_second} / ({_both}*{_none}+{_first}*{_second})",
}


def _numeric(name: str) -> Query:
    parameters = {"minkowski": {"p": P}, "wminkowski": {"p": P, "w": W}}.get(name, {})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = points(spark, sf_dir)
        return pairs.pairwise(asked(x), x, name, dim=DIM, places=PLACES, **parameters)

    return run


def _boolean(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = points(spark, sf_dir).select("id", F.transform("vec", lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("vec"))
        return pairs.pairwise(asked(x), x, name, places=PLACES)  # unrolled, the tests of each place outgrow what the JVM compiles

    return run


# centred first, in two passes
_centred = "r AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS raw FROM embeddings), e AS (SELECT id, list_transform(raw, lambda x: x - list_avg(raw)) AS vec FROM r)"
query("dist_correlation", matrix_sql(f"1 - {_dot} / (sqrt({_aa}) * sqrt({_bb}))", _centred))(_numeric("correlation"))
for _name, _sql in NUMERIC_SQL.items():
    query(f"dist_{_name}", matrix_sql(_sql))(_numeric(_name))
for _name, _sql in BOOLEAN_SQL.items():
    query(f"dist_{_name}", matrix_sql(_sql, TRUE))(_boolean(_name))


@query(
    "dist_seuclidean",
    f"""WITH {E}, v AS (SELECT list(s ORDER BY i) AS var FROM (SELECT i, var_samp(x) AS s FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM e) GROUP BY i))
    SELECT a.id AS id_a, b.id AS id_b, round(sqrt({total("(z[1]-z[2])*(z[1]-z[2])/z[3]", "list_zip(a.vec, b.vec, v.var)")}), 6) AS distance FROM e a CROSS JOIN e b CROSS JOIN v WHERE a.id % 100 = 0""",
)
def dist_seuclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir)
    return pairs.pairwise(asked(x), x, "seuclidean", dim=DIM, places=PLACES, **metrics.fit("seuclidean", x))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-dimensional vectors at volume."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey").cast("double"), "s_acctbal").alias("vec"))


S = "s AS (SELECT s_suppkey AS id, s_nationkey::DOUBLE AS x, s_acctbal AS y FROM supplier)"


@query(
    "dist_mahalanobis",
    f"""WITH {S}, c AS (SELECT var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM s)
    SELECT a.id AS id_a, b.id AS id_b, round(sqrt(greatest(((a.x-b.x)*(a.x-b.x)*yy - 2*(a.x-b.x)*(a.y-b.y)*xy + (a.y-b.y)*(a.y-b.y)*xx) / (xx*yy - xy*xy), 0)), 6) AS distance FROM s a JOIN s b ON a.id < b.id CROSS JOIN c""",
)
def dist_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = supplies(spark, sf_dir)
    return pairs.condensed(x, "mahalanobis", dim=2, places=PLACES, **metrics.fit("mahalanobis", x))


@query("dist_aitchison", matrix_sql(f"sqrt({total('(z[1]-z[2])*(z[1]-z[2])')})", "c AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: exp(x)) AS raw FROM embeddings), l AS (SELECT id, list_transform(raw, lambda x: ln(x / list_sum(raw))) AS logs FROM c), e AS (SELECT id, list_transform(logs, lambda x: x - list_avg(logs)) AS vec FROM l)"))
def dist_aitchison(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir).select("id", F.transform("vec", F.exp).alias("vec"))
    return pairs.pairwise(asked(x), x, "aitchison", places=PLACES)


@query(
    "hausdorff",
    f"""WITH {E}, d AS (SELECT a.label AS label_a, b.label AS label_b, a.id AS id_a, b.id AS id_b, sqrt({total("(z[1]-z[2])*(z[1]-z[2])")}) AS d FROM e a CROSS JOIN e b),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label_a, label_b, id_a ORDER BY d, id_b) AS r FROM d) WHERE r = 1)
    SELECT label_a, label_b, round(d, 6) AS distance, id_a, id_b FROM (SELECT *, row_number() OVER (PARTITION BY label_a, label_b ORDER BY d DESC, id_a) AS f FROM n) WHERE f = 1""",
)
def hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return rounded(pairs.directed_hausdorff(x, x, "euclidean", by=["label"], dim=DIM))


@pairs.broadcasting
def _cubes(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = np.abs(u - v)
    return (d * d * d).sum(-1)


@query("pairwise_callable", matrix_sql(total("pow(abs(z[1]-z[2]), 3)")))
def pairwise_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir)
    return pairs.pairwise(asked(x), x, _cubes, places=PLACES)


@query("listed_pairs", f"WITH {E} SELECT a.id AS id_a, b.id AS id_b, round(sqrt({total('(z[1]-z[2])*(z[1]-z[2])')}), 6) AS distance FROM e a JOIN e b ON b.id = a.id + 1")
def listed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir)
    return rounded(pairs.listed(x.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b")), x, x, "euclidean", dim=DIM))


@query("condensed_pairs", f"WITH {S} SELECT a.id AS id_a, b.id AS id_b, round(abs(a.x-b.x)+abs(a.y-b.y), 6) AS distance FROM s a JOIN s b ON a.id < b.id")
def condensed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.condensed(supplies(spark, sf_dir), "cityblock", dim=2, places=PLACES)


@query("square_matrix", f"WITH {S} SELECT a.id AS id_a, b.id AS id_b, round(greatest(abs(a.x-b.x), abs(a.y-b.y)), 6) AS distance FROM s a CROSS JOIN s b")
def square_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = supplies(spark, sf_dir)
    return pairs.square(pairs.condensed(x, "chebyshev", dim=2, places=PLACES), x)


@query("fit_variances", "SELECT i - 1 AS place, round(var_samp(x), 6) AS variance FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def fit_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    V = metrics.fit("seuclidean", points(spark, sf_dir))["V"]
    return rounded(spark.createDataFrame(list(enumerate(V)), "place long, variance double"), "variance")


# strings

_names = "n AS (SELECT DISTINCT p_name AS s FROM part)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("u")).crossJoin(names.select(F.col("p_name").alias("v")))


#: A small score matrix by rule: vowels are alike, consonants are alike.
@cache
def letters() -> dict[str, float]:
    from string import ascii_lowercase as az

    kind = {c: c in "aeiou" for c in az} | {" ": None, "-": None}
    return {a + b: 4.0 if a == b else 1.0 if kind[a] == kind[b] and kind[a] is not None else -2.0 for a in kind for b in kind}


def _aligned(**parameters) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = parameters.get("name", "levenshtein")
        rest = {k: v for k, v in parameters.items() if k not in ("name", "letters")} | ({"mat": letters()} if parameters.get("letters") else {})
        u, v = (F.lower(F.regexp_replace(c, "[^A-Za-z]", " ")) if parameters.get("letters") else F.col(c) for c in "uv")
        return rounded(_named(spark, sf_dir).select("u", "v", string_distance(name, u, v, **rest).alias("distance")))

    return run


query("levenshtein", f"WITH {_names} SELECT a.s AS u, b.s AS v, levenshtein(a.s, b.s)::DOUBLE AS distance FROM n a CROSS JOIN n b")(_aligned())


def _alignment_sql(symbols: str, score: str, most: str, gap_open: float, gap_extend: float) -> str:
    """The affine-gap recursion, a cell a step: rows of the second string over the first one's symbols."""
    row = f"list_transform(range(length(x) + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE -({gap_open} + (j - 1) * {gap_extend})::DOUBLE END)"
    return f"""WITH RECURSIVE {_names}, m AS (SELECT s, {symbols} AS x FROM n), p AS (SELECT a.s AS u, b.s AS v, a.x AS x, b.x AS y FROM m a CROSS JOIN m b),
    g AS (SELECT u, v, x, y, 0 AS k, NULL::DOUBLE[] AS above, {row} AS own, NULL::DOUBLE[] AS down_above, list_transform(range(length(x) + 1), lambda j: '-inf'::DOUBLE) AS down, '-inf'::DOUBLE AS along FROM p
    UNION ALL SELECT u, v, x, y, k, above, list_append(own, greatest(above[j] + {score}, along, d)), down_above, list_append(down, d), along FROM (
      SELECT *, greatest(own[j] - {gap_open}, was - {gap_extend})::DOUBLE AS along, greatest(above[j + 1] - {gap_open}, down_above[j + 1] - {gap_extend})::DOUBLE AS d, x[j] AS a, y[i] AS b FROM (
        SELECT u, v, x, y, k + 1 AS k, i, j, CASE WHEN j = 1 THEN own ELSE above END AS above, CASE WHEN j = 1 THEN [-({gap_open} + (i - 1) * {gap_extend})::DOUBLE] ELSE own END AS own,
          CASE WHEN j = 1 THEN down ELSE down_above END AS down_above, CASE WHEN j = 1 THEN ['-inf'::DOUBLE] ELSE down END AS down, CASE WHEN j = 1 THEN '-inf'::DOUBLE ELSE along END AS was
        FROM (SELECT *, k // length(x) + 1 AS i, k % length(x) + 1 AS j FROM g WHERE k < length(x) * length(y)))))
    SELECT u, v, round({most} - own[-1], 6) + 0.0 AS distance FROM g WHERE k = length(x) * length(y)"""


_kind = lambda c: f"(CASE WHEN {c} IN ('a','e','i','o','u') THEN 1 WHEN {c} = ' ' THEN NULL ELSE 0 END)"
query("levenshtein_affine", _alignment_sql("s", "CASE WHEN a = b THEN 0 ELSE -1 END", "0", 2.0, 0.5))(_aligned(gap_open=2.0, gap_extend=0.5))
query("levenshtein_normalized")(_aligned(normalized=True))
query("needleman_wunsch", _alignment_sql("lower(regexp_replace(s, '[^A-Za-z]', ' ', 'g'))", f"CASE WHEN a = b THEN 4 WHEN {_kind('a')} = {_kind('b')} THEN 1 ELSE -2 END", "4 * greatest(length(x), length(y))", 3.0, 1.0))(_aligned(name="nw", letters=True, gap_open=3.0, gap_extend=1.0))
query("needleman_wunsch_normalized")(_aligned(name="align", letters=True, gap_open=3.0, gap_extend=1.0, normalized=True))



@query("levenshtein_listed", f"WITH {_names}, k AS (SELECT s, row_number() OVER (ORDER BY s) AS id FROM n) SELECT a.id AS id_a, b.id AS id_b, levenshtein(a.s, b.s)::DOUBLE AS distance FROM k a JOIN k b ON b.id = a.id + 1")
def levenshtein_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = numbered_names(spark, sf_dir)
    return rounded(pairs.listed(x.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b")), x, x, "levenshtein"))


@query("levenshtein_condensed", f"WITH {_names}, k AS (SELECT s, row_number() OVER (ORDER BY s) AS id FROM n) SELECT a.id AS id_a, b.id AS id_b, levenshtein(a.s, b.s)::DOUBLE AS distance FROM k a JOIN k b ON a.id < b.id")
def levenshtein_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.condensed(numbered_names(spark, sf_dir), "levenshtein"))


def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("vec")).distinct()
    return vectors.with_ids(names, F.col("vec")).withColumn("id", F.col("id") + 1)


# encoders and code distances

_codes = "c AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS c0, l_partkey % 4 AS c1, l_suppkey % 4 AS c2, l_orderkey % 4 AS c3 FROM lineitem)"
_packed = "(c0 | (c1 << 2) | (c2 << 4) | (c3 << 6))"


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.array(*[(F.col(c) % 4).cast("int") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_orderkey")]).alias("codes"))


@query("encode_by_bits", f"WITH {_codes} SELECT l_orderkey, l_linenumber, {_packed}::BIGINT AS key FROM c")
def encode_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("l_orderkey", "l_linenumber", encoding.encode_by_bits(F.col("codes"), 4, 2).alias("key"))


@query("decode_by_bits", f"WITH {_codes} SELECT l_orderkey, l_linenumber, concat_ws(',', c0, c1, c2, c3) AS codes FROM c")
def decode_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = encoding.encode_by_bits(F.col("codes"), 4, 2)
    return coded(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(encoding.decode_by_bits(key, 4, 2).cast("array<string>"), ",").alias("codes"))


_signed = "s AS (SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey AS x, l_linenumber - 4 AS y FROM lineitem), z AS (SELECT *, CASE WHEN x > 0 THEN 2*x WHEN x < 0 THEN -2*x-1 ELSE 0 END AS zx, CASE WHEN y > 0 THEN 2*y WHEN y < 0 THEN -2*y-1 ELSE 0 END AS zy FROM s)"


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_partkey") - F.col("l_suppkey"), F.col("l_linenumber").cast("long") - 4).alias("codes"))


@query("encode_by_place", f"WITH {_signed} SELECT l_orderkey, l_linenumber, ((zx % 10000) + (zy % 10000)::HUGEINT * 10000)::VARCHAR AS key FROM z")
def encode_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(spark, sf_dir).select("l_orderkey", "l_linenumber", encoding.encode_by_place(F.col("codes"), 2, 4).cast("string").alias("key"))


@query("decode_by_place", f"WITH {_signed} SELECT l_orderkey, l_linenumber, concat_ws(',', x, y) AS codes FROM z")
def decode_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = encoding.encode_by_place(F.col("codes"), 2)
    return signed(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(encoding.decode_by_place(key, 2).cast("array<string>"), ",").alias("codes"))


@query("hash_distance", f"WITH {_codes} SELECT l_orderkey, l_linenumber, ((c0 <> 2)::INT + (c1 <> 1)::INT + (c2 <> 3)::INT + (c3 <> 0)::INT) AS far FROM c")
def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.lit(2 | 1 << 2 | 3 << 4).cast("long")
    return coded(spark, sf_dir).select("l_orderkey", "l_linenumber", encoding.key_distance(encoding.encode_by_bits(F.col("codes"), 4, 2), other, 4, 2).alias("far"))


# samples and variates

_draw = "((e.vec_id * 7919 + sample * 104729) % 10007)"


@query("sample_rows", f"SELECT sample, vec_id AS id FROM (SELECT s.sample, e.vec_id, row_number() OVER (PARTITION BY s.sample ORDER BY {_draw}, e.vec_id) AS r FROM embeddings e CROSS JOIN (SELECT unnest(range(4))::INT AS sample) s) WHERE r <= 10")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_rows(points(spark, sf_dir), 4, 10, order=(F.col("id") * 7919 + F.col("sample") * 104729) % 10007)


@query("sample_strata", f"SELECT stratum, sample, vec_id AS id FROM (SELECT e.vec_id // 100 AS stratum, s.sample, e.vec_id, row_number() OVER (PARTITION BY e.vec_id // 100, s.sample ORDER BY {_draw}, e.vec_id) AS r FROM embeddings e CROSS JOIN (SELECT unnest(range(3))::INT AS sample) s) WHERE r <= 5")
def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_strata(points(spark, sf_dir), 100, 3, 5, order=(F.col("id") * 7919 + F.col("sample") * 104729) % 10007)


_uniform = "(('0x' || substr(md5('7:' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"
_n = "(SELECT count(*) FROM embeddings)"


@query("sample_rows_hashed", "SELECT sample, vec_id AS id FROM (SELECT s.sample, e.vec_id, row_number() OVER (PARTITION BY s.sample ORDER BY md5(e.vec_id || ':' || s.sample || ':7'), e.vec_id) AS r FROM embeddings e CROSS JOIN (SELECT unnest(range(4))::INT AS sample) s) WHERE r <= 10")
def sample_rows_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_rows(points(spark, sf_dir), 4, 10, order=F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("sample").cast("string"), F.lit("7"))))


@query("sample_draws", f"SELECT i // 10 AS sample, i % 10 AS draw, floor({_uniform} * {_n})::BIGINT AS id FROM (SELECT unnest(range(40)) AS i)")
def sample_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draws(spark, points(spark, sf_dir).count(), 4, 10, seed=7)


@query("sample_interval_draws", f"SELECT i // 15 AS stratum, (i // 5) % 3 AS sample, i % 5 AS draw, floor({_uniform} * least(100, {_n} - (i // 15) * 100))::BIGINT + (i // 15) * 100 AS id FROM (SELECT unnest(range(15 * (({_n} + 99) // 100))) AS i)")
def sample_interval_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.interval_draws(spark, points(spark, sf_dir).count(), 100, 3, 5, seed=7)


@query("sample_lines", "SELECT event_id FROM events ORDER BY md5('7:' || event_id) LIMIT 100")
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.line_sample(table(spark, sf_dir, "events").select("event_id"), 100, seed=7)


_u1, _u2 = "(((event_id * 7919) % 10007 + 1) / 10009.0::DOUBLE)", "(((event_id * 104729) % 10007 + 1) / 10009.0::DOUBLE)"


def _stable_sql(alpha: float, beta: float) -> str:
    angle, wait = f"(({_u1} - 0.5) * pi())", f"(-ln({_u2}))"
    if alpha == 2:
        x = f"2 * sqrt({wait}) * sin({angle})"
    elif alpha == 1 and not beta:
        x = f"tan({angle})"
    elif alpha == 1:
        tilt = f"(pi()/2 + {beta} * {angle})"
        x = f"2/pi() * ({tilt} * tan({angle}) - {beta} * ln(pi()/2 * {wait} * cos({angle}) / {tilt}))"
    else:
        skew = f"({beta} * tan(pi() * {alpha} / 2))"
        turn = f"(atan({skew}) / {alpha})"
        x = f"pow(1 + {skew}*{skew}, 1/(2*{alpha}::DOUBLE)) * sin({alpha} * ({angle} + {turn})) / pow(cos({angle}), 1/{alpha}::DOUBLE) * pow(cos({angle} - {alpha} * ({angle} + {turn})) / {wait}, (1-{alpha})/{alpha}::DOUBLE)"
    return f"SELECT event_id, round(atan({x}), 6) AS x FROM events"


def _variates(alpha: float, beta: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = [((F.col("event_id") * f) % 10007 + 1) / F.lit(10009.0) for f in (7919, 104729)]
        # the arc tangent keeps the law's far tails comparable
        return table(spark, sf_dir, "events").select("event_id", F.round(F.atan(stable_column(*u, alpha, beta)), 6).alias("x"))

    return run


for _label, _alpha, _beta in (("cauchy", 1.0, 0.0), ("skewed_1", 1.0, 0.5), ("general", 1.5, 0.5), ("half", 0.5, -0.5), ("normal", 2.0, 0.0)):
    query(f"stable_{_label}", _stable_sql(_alpha, _beta))(_variates(_alpha, _beta))

# hash indexes and searches

#: Parameters by family; ``probes``: keys that a query asks for in each table. ``*_long``: long codes, under which some queries are short of neighbours and look at neighbouring codes. ``*_all``: as many tables as a search without probing needs.
FAMILIES = {
    "voronoi": {"spill": 12, "probes": 16},
    "cosine": {"L": 16, "k": 8, "probes": 8},
    "stable": {"L": 16, "k": 6, "r": 1.0, "width": 6, "probes": 200},
    "voronoi_flat": {"L": 4, "k": 2, "m": 20, "w": 8, "probes": 16},
    "voronoi_long": {"L": 4, "k": 6, "m": 40, "w": 4},
    "cosine_long": {"L": 4, "k": 16},
    "stable_long": {"L": 4, "k": 8, "r": 1.0, "width": 4},
    "voronoi_all": {"L": 32, "k": 1, "m": 200, "w": 200},
    "cosine_all": {"L": 128, "k": 8},
    "stable_all": {"L": 112, "k": 7, "r": 2.0, "width": 5},
}
#: Queries that list an index, whole, by the tables that it had before searches probed it.
LISTS = {"cosine": "cosine_all", "stable": "stable_all"}
#: Searches that ask for more keys.
MORE = {"voronoi": 24, "cosine": 16, "stable": 320, "voronoi_flat": 24}
_medoid_draw = "((id * 7919 + sample * 104729) % 10007)"
_tree_draw = "((id * 7919) % 10007)"


@cache
def _chosen(name: str) -> np.ndarray:
    """For each table, function and place the rank of its medoid in the table's draw: constants."""
    p, rng = FAMILIES[name], np.random.default_rng(11)
    if p["w"] == p["m"]:
        return np.broadcast_to(np.arange(p["m"]), (p["L"], p["k"], p["m"]))
    return np.array([[rng.choice(p["m"], p["w"], replace=False) for _ in range(p["k"])] for _ in range(p["L"])])


@cache
def cosine_family(name: str = "cosine") -> Cosine:
    return Cosine.draw(DIM, FAMILIES[name]["L"], FAMILIES[name]["k"], seed=12)


@cache
def stable_family(name: str = "stable") -> Stable:
    """The projections have four decimal places, as they stand in the SQL twin."""
    p = FAMILIES[name]
    drawn = Stable.draw(DIM, p["L"], p["k"], p["r"], seed=13)
    return Stable(drawn.projections.round(4), drawn.shifts.round(4), p["r"], width=p["width"])


def voronoi_family(x: DataFrame, name: str = "voronoi") -> Voronoi:
    """Medoids by table: m rows of the whole table in an arithmetic order, L * m vectors at most."""
    p = FAMILIES[name]
    draw = sampling.sample_rows(x, p["L"], p["m"], order=F.expr(_medoid_draw))
    found = x.join(F.broadcast(draw), "id").select("sample", F.expr(_medoid_draw).alias("place"), "id", "vec").toArrow().sort_by([("sample", "ascending"), ("place", "ascending"), ("id", "ascending")])
    if found.num_rows != p["L"] * p["m"]:
        raise ValueError(f"a draw needs {p['m']} rows")
    ids, at = np.unique(found["id"].to_numpy(), return_inverse=True)
    vec = np.zeros((len(ids), DIM))
    vec[at] = found["vec"].combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    drawn = at.reshape(p["L"], p["m"])
    return Voronoi(vec, np.stack([row[places] for row, places in zip(drawn, _chosen(name), strict=True)]), "euclidean")


def family(name: str, x: DataFrame) -> Family:
    if name == "voronoi":
        return MedoidTree.draw(x, F.expr(_tree_draw), spill=FAMILIES[name]["spill"], probes=FAMILIES[name]["probes"])
    return voronoi_family(x, name) if name.startswith("voronoi") else cosine_family(name) if name.startswith("cosine") else stable_family(name)


def _list(v: np.ndarray) -> str:
    return f"string_split('{','.join(f'{float(a):g}' for a in v)}', ',')::DOUBLE[]"


@cache
def codes_sql(name: str) -> str:
    """CTEs that end in codes(id, t, j, code) and keys(id, t, codes, bucket)."""
    p = FAMILIES[name]
    if name == "voronoi":
        return tree_sql(p["probes"])
    if name.startswith("voronoi"):
        if p["w"] == p["m"]:
            f = "f(t, j, p, m) AS (SELECT t, 0, r, id FROM med)"
        else:
            rows = ",".join(f"({t},{j},{place},{r})" for (t, j, place), r in np.ndenumerate(_chosen(name)))
            f = f"f(t, j, p, m) AS (SELECT t, j, p, id FROM (VALUES {rows}) c(t, j, p, r) JOIN med USING (t, r))"
        codes = f"""med(t, id, r) AS (SELECT sample, id, r - 1 FROM (SELECT sample, id, row_number() OVER (PARTITION BY sample ORDER BY {_medoid_draw}, id) AS r FROM e CROSS JOIN (SELECT unnest(range({p["L"]}))::INT AS sample)) WHERE r <= {p["m"]}),
        {f}, near AS (SELECT a.id, b.id AS m, sqrt({total("(z[1]-z[2])*(z[1]-z[2])")}) AS d FROM e a CROSS JOIN e b WHERE b.id IN (SELECT m FROM f)),
        codes AS (SELECT near.id, t, j, arg_min(p, (d, p)) AS code FROM near JOIN f USING (m) GROUP BY near.id, t, j)"""
        bucket = f"sum(code << ({(p['w'] - 1).bit_length()}*j))::BIGINT"
    elif name.startswith("cosine"):
        signs = cosine_family(name).signs
        rows = ",".join(f"({t},{j},'{''.join('+' if x > 0 else '-' for x in signs[t, j])}')" for t in range(p["L"]) for j in range(p["k"]))
        codes = f"s(t, j, v) AS (VALUES {rows}), f(t, j, v) AS (SELECT t, j, list_transform(string_split(v, ''), lambda x: CASE x WHEN '+' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) FROM s), codes AS (SELECT id, t, j, (list_inner_product(vec, v) > 0)::INT AS code FROM e CROSS JOIN f)"
        bucket = "sum(code << j)::BIGINT"
    else:
        g = stable_family(name)
        rows = ",".join(f"({t},{j},{_list(g.projections[t, j])},{float(g.shifts[t, j])!r}::DOUBLE)" for t in range(p["L"]) for j in range(p["k"]))
        codes = f"f(t, j, v, b) AS (VALUES {rows}), codes AS (SELECT id, t, j, floor((list_inner_product(vec, v) + b) / {p['r']})::BIGINT AS code FROM e CROSS JOIN f)"
        place = " ".join(f"WHEN {j} THEN {10 ** (p['width'] * j)}::HUGEINT" for j in range(p["k"]))
        bucket = f"sum((CASE WHEN code > 0 THEN 2*code WHEN code < 0 THEN -2*code-1 ELSE 0 END)::HUGEINT * (CASE j {place} END))::HUGEINT"
    return f"WITH {E}, {codes}, keys AS (SELECT id, t, list(code ORDER BY j) AS codes, {bucket} AS bucket FROM codes GROUP BY id, t)"


def tree_sql(probes: int) -> str:
    """CTEs that end in keys(id, t, codes, bucket) of rows and asks(id, t, bucket) of queries."""
    p = FAMILIES["voronoi"]
    return f"""WITH {E}, size AS (SELECT *, ceil(sqrt(m))::BIGINT AS g, floor({p["spill"]} * {p["probes"]} / m + 1.1::DOUBLE)::BIGINT AS votes FROM (SELECT greatest(2, least(count(*) // 20, floor(2 * sqrt(count(*)))::BIGINT, 65536)) AS m FROM e)),
        med(r, id) AS (SELECT r, id FROM (SELECT id, row_number() OVER (ORDER BY {_tree_draw}, id) - 1 AS r FROM e) CROSS JOIN size WHERE r < m),
        near AS MATERIALIZED (SELECT a.id, med.r, med.r < g AS coarse, {total("(z[1]-z[2])*(z[1]-z[2])")} AS d FROM e a CROSS JOIN med JOIN e b ON b.id = med.id CROSS JOIN size),
        top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r) AS nth FROM near WHERE coarse),
        under AS (SELECT med.r, top.r AS c FROM top JOIN med USING (id) WHERE nth <= 2),
        seen AS (SELECT DISTINCT top.id, under.r FROM top JOIN under ON under.c = top.r CROSS JOIN size WHERE nth <= (2 * g + 2) // 3),
        lists AS (SELECT id, r, row_number() OVER (PARTITION BY id ORDER BY d, r) AS nth FROM seen JOIN near USING (id, r)),
        keys AS (SELECT id, 0 AS t, [r] AS codes, r AS bucket FROM lists WHERE nth <= {p["spill"]}),
        asks AS (SELECT id, 0 AS t, r AS bucket FROM lists WHERE nth <= {probes} AND id % 100 = 0)"""


@cache
def asks_sql(name: str, probes: int) -> str:
    """CTEs that end in keys(id, t, codes, bucket) of rows and asks(id, t, codes) of queries: the keys of least cost."""
    p, prefix = FAMILIES[name], codes_sql(name)
    if name == "voronoi_flat":
        combos = " CROSS JOIN ".join(f"(SELECT p AS p{j}, g AS g{j}, id, t FROM gaps WHERE j = {j}) a{j}" if not j else f"(SELECT p AS p{j}, g AS g{j}, id AS id{j}, t AS t{j} FROM gaps WHERE j = {j}) a{j}" for j in range(p["k"]))
        same = " AND ".join(f"id = id{j} AND t = t{j}" for j in range(1, p["k"]))
        costs = f"gaps AS (SELECT n.id, t, j, p, d * d - min(d * d) OVER (PARTITION BY n.id, t, j) AS g FROM near n JOIN f USING (m) WHERE n.id % 100 = 0), costs AS (SELECT id, t, [{', '.join(f'p{j}' for j in range(p['k']))}] AS codes, {' + '.join(f'g{j}' for j in range(p['k']))} AS cost FROM {combos} WHERE {same})"
    else:
        dot = "list_inner_product(vec, v)"
        at = f"spot AS (SELECT id, t, list({dot if name == 'cosine' else f'({dot} + b) / ' + str(p['r'])} ORDER BY j) AS y FROM e CROSS JOIN f WHERE id % 100 = 0 GROUP BY id, t)"
        if name == "cosine":
            code, cost, values = "CASE WHEN x // (1 << (j - 1)) % 2 = 1 THEN (y[j] <= 0)::INT ELSE (y[j] > 0)::INT END", "CASE WHEN x // (1 << (j - 1)) % 2 = 1 THEN y[j] * y[j] ELSE 0 END", 2 ** p["k"]
        else:
            powers = f"[{', '.join(str(3**j) for j in range(p['k']))}]"
            step = f"(x // {powers}[j] % 3)"
            code = f"(floor(y[j]) + CASE {step} WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END)::BIGINT"
            cost, values = f"CASE {step} WHEN 1 THEN pow(y[j] - floor(y[j]), 2) WHEN 2 THEN pow(1 - (y[j] - floor(y[j])), 2) ELSE 0 END", 3 ** p["k"]
        costs = f"{at}, costs AS (SELECT id, t, list_transform(range(1, {p['k'] + 1}), lambda j: {code}) AS codes, list_sum(list_transform(range(1, {p['k'] + 1}), lambda j: {cost})) AS cost FROM spot CROSS JOIN range({values}) r(x))"
    return f"{prefix}, {costs}, asks AS (SELECT id, t, codes FROM costs QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY cost, codes) <= {probes})"


def search_sql(name: str, probes: int | None = None) -> str:
    """CTEs that end in own(query_id, id): the pairs that meet."""
    probes = probes or FAMILIES[name]["probes"]
    if name == "voronoi":
        return f"{tree_sql(probes)}, own AS (SELECT q.id AS query_id, k.id FROM asks q JOIN keys k USING (t, bucket) GROUP BY q.id, k.id HAVING count(*) >= (SELECT votes FROM size))"
    return f"{asks_sql(name, probes)}, own AS (SELECT DISTINCT q.id AS query_id, k.id FROM asks q JOIN keys k USING (t, codes))"


METRIC_SQL = {name: NUMERIC_SQL["cosine" if name.startswith("cosine") else "euclidean"] for name in FAMILIES}
_own = ", own AS (SELECT DISTINCT q.id AS query_id, k.id FROM keys q JOIN keys k ON q.t = k.t AND q.bucket = k.bucket WHERE q.id % 100 = 0)"


def _ranked_sql(name: str, candidates: str) -> str:
    return f", ranked AS (SELECT c.query_id, row_number() OVER (PARTITION BY c.query_id ORDER BY {METRIC_SQL[name]}, c.id) AS rank, c.id, round({METRIC_SQL[name]}, 6) + 0.0 AS distance FROM {candidates} c JOIN e a ON a.id = c.query_id JOIN e b ON b.id = c.id)"


_probing = f"""{_own}, short AS (SELECT q.id FROM (SELECT DISTINCT id FROM keys WHERE id % 100 = 0) q LEFT JOIN own ON own.query_id = q.id GROUP BY q.id HAVING count(own.id) < {Q}),
    far AS (SELECT q.id AS query_id, k.id, min(list_sum(list_transform(list_zip(q.codes, k.codes), lambda z: (z[1] <> z[2])::INT))) AS far FROM keys q JOIN short USING (id) JOIN keys k ON q.t = k.t GROUP BY q.id, k.id),
    reached AS (SELECT a.query_id, a.id FROM far a WHERE a.far <= 2 AND (SELECT count(*) FROM far b WHERE b.query_id = a.query_id AND b.far < a.far) < {Q}),
    probed AS (SELECT query_id, id FROM own UNION SELECT query_id, id FROM reached)"""
_wide = f"SELECT q.id AS query_id, concat_ws(',', {', '.join(f'coalesce(max(CASE WHEN r.rank = {k} THEN r.id END), -1)' for k in range(1, Q + 1))}) AS neighbors FROM (SELECT id FROM e WHERE id % 100 = 0) q LEFT JOIN ranked r ON r.query_id = q.id AND r.rank <= {Q} GROUP BY q.id"


def index(spark: SparkSession, sf_dir: str, name: str) -> search.Index:
    x = points(spark, sf_dir)
    return search.Index(family(name, x), x)


def _searches(name: str) -> None:
    found, probes = search_sql(name), FAMILIES[name]["probes"]
    top = f" SELECT query_id, rank, id, distance FROM ranked WHERE rank <= {Q}"
    nearest = found + _ranked_sql(name, "own") + top

    listed = LISTS.get(name, name)

    @query(f"lsh_{name}_index", codes_sql(listed) + " SELECT id, t AS table_id, array_to_string(codes, ',') AS codes, bucket::VARCHAR AS bucket FROM keys")
    def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index(spark, sf_dir, listed).hashes.select("id", "table_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), F.col("bucket").cast("string").alias("bucket"))

    @query(f"lsh_{name}_candidates", found + " SELECT * FROM own")
    def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index(spark, sf_dir, name).candidates(asked(points(spark, sf_dir)), probes)

    @query(f"lsh_{name}_knn", nearest)
    def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(index(spark, sf_dir, name).query(asked(points(spark, sf_dir)), Q, probe=False, probes=probes))

    @query(f"lsh_{name}_multiprobe", search_sql(name, MORE[name]) + _ranked_sql(name, "own") + top)
    def multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(index(spark, sf_dir, name).query(asked(points(spark, sf_dir)), Q, probe=False, probes=MORE[name]))

    @query(f"lsh_{name}_by_id", nearest)
    def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(index(spark, sf_dir, name).query_by_id(asked(points(spark, sf_dir)).select("id"), Q, probe=False, probes=probes))

    @query(f"lsh_{name}_stored", nearest)
    def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Written once, opened again by its folder, then asked."""
        x = points(spark, sf_dir)
        written = search.Index.write(family(name, x), x, f"{Workspace(spark, 'index').root}/{name}")
        return rounded(search.Index.open(x, written.store.path).query(asked(x), Q, probe=False, probes=probes))

    @query(f"lsh_{name}_wide", found + _ranked_sql(name, "own") + " " + _wide)
    def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = asked(points(spark, sf_dir))
        out = search.wide(index(spark, sf_dir, name).query(x, Q, probe=False, probes=probes), x, Q)
        return out.select("query_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


def _close(name: str) -> None:
    """Searches in which queries that are short look at neighbouring codes."""
    far = f"{name}_long"

    @query(f"lsh_{name}_close", codes_sql(far) + _probing + _ranked_sql(far, "probed") + f" SELECT query_id, rank, id, distance FROM ranked WHERE rank <= {Q}")
    def close(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(index(spark, sf_dir, far).query(asked(points(spark, sf_dir)), Q))


for _name in ("voronoi", "cosine", "stable"):
    _searches(_name)
    _close(_name)
_searches("voronoi_flat")

_exact = f"WITH {E}, truth AS (SELECT * FROM (SELECT a.id AS query_id, row_number() OVER (PARTITION BY a.id ORDER BY {NUMERIC_SQL['euclidean']}, b.id) AS rank, b.id, round({NUMERIC_SQL['euclidean']}, 6) AS distance FROM e a CROSS JOIN e b WHERE a.id % 100 = 0) WHERE rank <= {Q})"


@query("knn_exact", _exact + " SELECT query_id, rank, id, distance FROM truth")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir)
    return rounded(search.nearest_exact(asked(x), x, Q, dim=DIM))


def _recalls(label: str, name: str, probes: int) -> None:
    truth = f"truth AS (SELECT * FROM (SELECT a.id AS query_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {METRIC_SQL[name]}, b.id) AS rank FROM e a CROSS JOIN e b WHERE a.id % 100 = 0) WHERE rank <= {Q})"

    @query(label, search_sql(name, probes) + f", {truth} SELECT count(*) AS n_true, count(own.id) AS n_found, round(count(own.id) / count(*), 6) AS recall FROM truth LEFT JOIN own USING (query_id, id)")
    def of_family(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, ix = points(spark, sf_dir), index(spark, sf_dir, name)
        found = ix.query(asked(x), Q, probe=False, probes=probes)
        return rounded(search.recall(found, search.nearest_exact(asked(x), x, Q, metric=ix.family.metric, dim=DIM)), "recall")


_recalls("recall", "voronoi", FAMILIES["voronoi"]["probes"])
for _name in ("cosine", "stable", "voronoi_flat"):
    _recalls(f"recall_{_name}", _name, FAMILIES[_name]["probes"])
for _name in ("voronoi", "cosine", "stable"):
    _recalls(f"recall_{_name}_multiprobe", _name, MORE[_name])

SHARED = ("voronoi", "cosine", "stable", "voronoi_flat")


@query(
    "lsh_candidate_share",
    " UNION ALL ".join(f"SELECT * FROM ({search_sql(name)} SELECT '{name}' AS family, count(*) AS n, round(count(*) / (SELECT count(*) * count(*) FILTER (WHERE id % 100 = 0) FROM e), 6) AS share FROM own)" for name in SHARED),
)
def lsh_candidate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all (query, row) pairs each index looks at."""
    x = points(spark, sf_dir)
    pairs_ = x.count() * asked(x).count()
    found = [index(spark, sf_dir, name).candidates(asked(x), FAMILIES[name]["probes"]).agg(F.lit(name).alias("family"), F.count("*").alias("n")) for name in SHARED]
    return reduce(DataFrame.union, found).select("family", "n", F.round(F.col("n") / pairs_, 6).alias("share"))


# bucket store


@query("store_keys", codes_sql("voronoi_all") + " SELECT DISTINCT t AS table_id, bucket FROM keys")
def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "voronoi_all").store.keys()


@query("store_bucket", codes_sql("voronoi_flat") + " SELECT id FROM keys WHERE t = 0 AND bucket = 5")
def store_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "voronoi_flat").store.bucket(0, 5)


@query("store_clear", codes_sql("voronoi_all") + " SELECT t AS table_id, count(*) AS n FROM keys WHERE t <> 1 GROUP BY t")
def store_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "voronoi_all").store.clear(1).rows().groupBy("table_id").agg(F.count("*").alias("n"))


@query("store_counts", codes_sql("voronoi_all") + _own + " SELECT query_id, count(*) AS n FROM own GROUP BY query_id")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = index(spark, sf_dir, "voronoi_all")
    return ix.store.candidate_counts(ix.hash_queries(asked(points(spark, sf_dir))))


@query("store_pack", "SELECT event_id AS id, k AS table_id, (event_id * (k + 1)) % 97 AS bucket FROM events CROSS JOIN (SELECT unnest(range(3))::INT AS k)")
def store_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array(*[(F.col("event_id") * (k + 1)) % 97 for k in range(3)]).alias("keys"))
    return BucketStore(spark).pack(rows).rows().select("id", "table_id", "bucket")


def events_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array(*[(F.col("event_id") * (k + 1)) % 97 for k in range(3)]).alias("keys"))


def stored(spark: SparkSession, sf_dir: str) -> BucketStore:
    """Events' buckets in a Parquet store."""
    return BucketStore(spark, "parquet", f"{Workspace(spark, 'store').root}/index").pack(events_keys(spark, sf_dir))


_events = "WITH k AS (SELECT event_id AS id, k AS table_id, (event_id * (k + 1)) % 97 AS bucket FROM events CROSS JOIN (SELECT unnest(range(3))::INT AS k))"


@query("store_parquet", f"{_events} SELECT id, table_id, bucket FROM k WHERE bucket % 10 = 3")
def store_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is opened again by its version folder."""
    return BucketStore.open(spark, stored(spark, sf_dir).path).rows().where("bucket % 10 = 3").select("id", "table_id", "bucket")


@query("store_parquet_bucket", f"{_events} SELECT id FROM k WHERE table_id = 2 AND bucket = 11")
def store_parquet_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).bucket(2, 11)


@query("store_copy", f"{_events} SELECT 'copy' AS store, table_id, count(*) AS n FROM k GROUP BY table_id UNION ALL SELECT 'own', table_id, count(*) FROM k WHERE table_id <> 1 GROUP BY table_id")
def store_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy keeps what the store itself clears."""
    own = stored(spark, sf_dir)
    copy = own.copy()
    own.clear(1)
    count = lambda store, name: store.rows().groupBy("table_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "table_id", "n")
    return count(copy, "copy").union(count(own, "own"))


@query("store_bucketed", f"{_events}, n AS (SELECT table_id, bucket, count(*) AS n FROM k GROUP BY ALL) SELECT id AS query_id, sum(n)::BIGINT AS n FROM k JOIN n USING (table_id, bucket) GROUP BY id")
def store_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each event's buckets, over a bucketed table that is opened again; buckets of 500 rows and more lie in parts."""
    keys = events_keys(spark, sf_dir)
    store = BucketedStore(spark, f"{Workspace(spark, 'store').root}/index", least=500).pack(keys)
    sizes = BucketStore.open(spark, store.path).met(store.rows().select("table_id", "bucket").distinct()).groupBy("table_id", "bucket").agg(F.count("*").alias("n"))
    asked_ = keys.select(F.col("id").alias("query_id"), F.posexplode("keys").alias("table_id", "bucket"))
    return asked_.join(sizes, ["table_id", "bucket"]).groupBy("query_id").agg(F.sum("n").alias("n"))


# places in an order


@query(
    "as_of_events",
    """WITH met AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'click', event_id) AS click_id FROM events)
    SELECT event_id, click_id FROM met WHERE event_type = 'error'""",
)
def as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the last click of its user at or before it."""
    events = table(spark, sf_dir, "events")
    met = as_of(events.where("event_type = 'error'").select("event_id", "user_id", "ts"), events.where("event_type = 'click'").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id")
    return met.select("event_id", F.col("met.event_id").alias("click_id"))


@query(
    "as_of_orders",
    """WITH met AS (SELECT o.o_orderkey, arg_max(struct_pack(id := e.event_id, ts := e.ts), struct_pack(ts := e.ts, id := e.event_id)) AS e
        FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 26 YEAR AS ts FROM orders) o JOIN events e ON e.user_id = o.o_custkey AND e.ts <= o.ts AND e.ts >= o.ts - INTERVAL 30 DAY GROUP BY o.o_orderkey)
    SELECT o_orderkey, e.id AS event_id FROM orders LEFT JOIN met USING (o_orderkey)""",
)
def as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order, moved on by 26 years, with its customer's last event within the 30 days before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + interval 26 years").alias("ts"))
    met = as_of(orders, table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", F.expr("interval 30 days"))
    return met.select("o_orderkey", F.col("met.event_id").alias("event_id"))


@query(
    "as_of_stream",
    """WITH met AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS met_event_id, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER w AS met_ts
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type <> 'click', event_id))
    SELECT user_id, ts, event_id, met_ts, met_event_id FROM met WHERE event_type = 'error' AND ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR FROM events WHERE event_type IN ('error', 'click'))""",
)
def as_of_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: each error that the watermark (6 hours) has passed with the last click of its user."""
    ws = Workspace(spark, "as-of-stream")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may be a single file
    met = as_of_stream(events, "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "click", "6 hours")
    with timers(spark):
        met.writeStream.format("parquet").option("checkpointLocation", f"{ws.root}/progress").trigger(availableNow=True).start(f"{ws.root}/met").awaitTermination()
    return spark.read.schema(met.schema).parquet(f"{ws.root}/met")


# scans


@query("wrap_array", "SELECT i AS id, concat_ws(',', 3 * i, 3 * i + 1, 3 * i + 2) AS vec FROM (SELECT unnest(range(50)) AS i)")
def wrap_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors.wrap(spark, np.arange(150.0).reshape(50, 3))
    return x.select("id", F.array_join(F.transform("vec", lambda v: v.cast("long").cast("string")), ",").alias("vec"))


@query("wrap_rows", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS id, concat_ws(',', s_nationkey, s_suppkey) AS vec FROM supplier WHERE s_suppkey < 200")
def wrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of the first 200 suppliers, the most that this query takes to the driver, wrapped again."""
    rows = table(spark, sf_dir, "supplier").where("s_suppkey < 200").orderBy("s_suppkey").select("s_nationkey", "s_suppkey").toArrow()
    x = vectors.wrap(spark, np.column_stack([rows["s_nationkey"].to_numpy(), rows["s_suppkey"].to_numpy()]).astype(float))
    return x.select("id", F.array_join(F.transform("vec", lambda v: v.cast("long").cast("string")), ",").alias("vec"))


@query("scan_delimited", "SELECT 'c' || c_custkey AS id, concat_ws(',', c_custkey, c_nationkey) AS vec FROM customer")
def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tab-separated text with row names, written and scanned."""
    path = f"{Workspace(spark, 'delimited').root}/customer"
    table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")), "c_custkey", "c_nationkey").write.csv(path, sep="\t")
    x = vectors.delimited(spark, path, 2, rownames=True)
    return x.select("id", F.array_join(F.transform("vec", lambda v: v.cast("long").cast("string")), ",").alias("vec"))


@query("scan_npy", f"WITH {E} SELECT row_number() OVER (ORDER BY id) - 1 AS id, id AS vec_id, round(list_sum(vec), 6) + 0.0 AS total FROM e")
def scan_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors led by their ids, written as parts of one array in order of these and read back in ranges of rows."""
    path = f"{Workspace(spark, 'arrays').root}/embeddings"
    led = points(spark, sf_dir).select("id", F.concat(F.array(F.col("id").cast("double")), "vec").alias("vec"))
    arrays.write(led, path, part_bytes=1 << 24)
    total = F.aggregate(F.slice("vec", 2, DIM), F.lit(0.0), lambda a, v: a + v)
    return vectors.npy(spark, path).select("id", F.get("vec", F.lit(0)).cast("long").alias("vec_id"), (F.round(total, 6) + 0.0).alias("total"))


@query("scan_blocks", "SELECT count(*) AS n, sum(vec_id)::BIGINT AS ids, true AS bounded, greatest(3, (count(*) + 99) // 100) AS blocks FROM embeddings")
def scan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in blocks of about 100: all of them once, none in a block of over twice that."""
    sizes = vectors.blocks(points(spark, sf_dir), 3, 100).groupBy(F.spark_partition_id().alias("block")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    return sizes.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), (F.max("n") <= 200).alias("bounded"), F.count("*").alias("blocks"))


@query("sample_medoids", f"WITH {E}, drawn AS (SELECT sample, id, vec, row_number() OVER (PARTITION BY sample ORDER BY md5(id || ':' || sample || ':9')) AS r FROM e CROSS JOIN (SELECT unnest(range(3)) AS sample)) SELECT sample, id, round(list_sum(vec), 6) + 0.0 AS total FROM drawn WHERE r <= 12")
def sample_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve medoids for each of three tables: ids, their distinct vectors, and each draw's place among these."""
    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("sample").cast("string"), F.lit("9")))
    ids, distinct, drawn = sampling.medoids(points(spark, sf_dir), 12, 3, order=order)
    total = distinct[drawn].sum(axis=2).round(6) + 0.0
    return spark.createDataFrame([(t, ids[12 * t + k], float(total[t, k])) for t in range(3) for k in range(12)], "sample long, id long, total double")


@query("wrap_frame", "SELECT count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS total FROM embeddings")
def wrap_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.wrap(spark, points(spark, sf_dir)).agg(F.count("*").alias("n"), F.round(F.sum(F.col("vec")[0]), 6).alias("total"))


@query("scan_range", "SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE vec_id >= 100 AND vec_id < 200")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.by_range(points(spark, sf_dir), 100, 200).select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("scan_by_id", "SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT event_id * 3 FROM events)")
def scan_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.by_id(points(spark, sf_dir), table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("id"))).select("id")


@query("scan_shape", "SELECT count(*) AS n, max(len(embedding)) AS dim, (min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT vec_id) = count(*)) AS indices FROM embeddings")
def scan_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir)
    n, dim = vectors.shape(x)
    return spark.createDataFrame([(n, dim, vectors.are_indices(x))], "n long, dim long, indices boolean")


@query("scan_numbered", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer")
def scan_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.with_ids(table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["lsh_voronoi_multiprobe"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
