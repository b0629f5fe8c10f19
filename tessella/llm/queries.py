"""The registered queries of this subpackage, and their SQL where it has one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.centroids import centroid_clusters
from tessella.llm.decontaminate import contamination
from tessella.llm.html_text import extract
from tessella.llm.language import fit_language, predict_language
from tessella.llm.mixing import WORD, mix, truncated
from tessella.llm.near_dedup import near_duplicates
from tessella.llm.neighbours import nearest
from tessella.llm.periodic import periodic_runs
from tessella.llm.quality import quality
from tessella.llm.sharding import shard
from tessella.llm.storage import stored
from tessella.llm.token_edits import count_with_edits
from tessella.llm.toxicity import fit_toxicity, score_toxicity
from tessella.llm.vector_dedup import vector_duplicates

#: The rank file that op9 counts with; it must be at this path on every machine.
VOCABULARY = os.environ.get("TESSELLA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and the smallest id that links of 80 percent of two-word shingles reach."""
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2, similarity_percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score, learnt from the labelled rows outside the held-out third."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = quality(_read(spark, sf_dir, "documents"), labels, _remainder(3) != 1).withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the mix of sources takes of it."""
    sizes = _read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("mix_size"))
    return truncated(mix(stored(sizes, "sizes"), size="mix_size")).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken", "upto_words")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in 24 shards of nearly equal bytes."""
    placed = shard(_read(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.select("doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark windows and the items they belong to."""
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10).drop("text_key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score, learnt from the labelled rows outside the held-out fifth."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs, labels.filter(_remainder(5) != 0))
    out = score_toxicity(docs, model).withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under three edits made from its own text: a cut at a third, an insertion at two thirds, a line at its end."""
    docs = _read(spark, sf_dir, "documents")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    edit = lambda pos, removed, added: F.struct(pos.cast("int").alias("pos"), F.lit(removed).alias("removed"), added.alias("added"))
    edits = F.array(edit(F.floor(n / 3), 7, F.lit("")), edit(F.floor(n * 2 / 3), 0, F.substring("text", 1, 12)), edit(n + 5, 0, F.concat(F.lit("\n"), F.coalesce("source", F.lit("")))))
    return count_with_edits(docs.withColumn("edits", edits), VOCABULARY)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language, learnt from the rows outside the held-out third."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs, _remainder(3) != 1)
    out = predict_language(docs, model).withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.93 or more inside its label, and the smallest id that links reach."""
    return vector_duplicates(_read(spark, sf_dir, "embeddings"), 0.93).select("vec_id", "n_links", "component_id", "kept")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 finite components with its cluster after ten rounds of eight centroids."""
    out = centroid_clusters(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, seed=3)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of the documents whose crc32 ends in 0, the words from the a-th on become repeats of the p words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    planned = split.withColumn("n", F.when(F.col("h") % 10 == 0, n)).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    planned = planned.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int")).withColumn("a", F.col("a").cast("int"))
    rest = F.col("n") - F.col("a")
    often = F.ceil(rest / F.col("p")).cast("int")
    base = F.slice("words", F.col("a") + 1, F.least(F.col("p"), rest))
    tail = F.slice(F.flatten(F.array_repeat(base, often)), F.lit(1), rest)
    return planned.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its periodic runs of words, after repeats are planted in a tenth of the documents."""
    found = periodic_runs(_with_repeats(_read(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(F.lit(""))
    made = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.q")
    return made.select("doc_id", "n_runs", (-F.col("top.a")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_html_text, op3_quality, op4_neighbours, op5_mixing, op6_sharding, op7_decontaminate, op8_toxicity, op9_token_counts, op10_language, op11_vector_dedup, op12_centroids, op13_periodic_runs)
}

_OP5 = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((src - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight, source_size * 3 AS most FROM s),
f AS (SELECT *, most / weight AS fill FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - (sum(most) OVER (ORDER BY fill, src ROWS UNBOUNDED PRECEDING) - most) AS BIGINT)
    / CAST(sum(weight) OVER (ORDER BY fill, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM f),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT level FROM l WHERE level <= fill ORDER BY fill, src LIMIT 1) * weight) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, md5(concat('5|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', size)) AS h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM p),
k AS (SELECT *, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - (upto - size) - source_size * k)) AS BIGINT) AS words FROM o, range(0, 3) r(k)),
q AS (SELECT *, CASE WHEN words > 0 THEN least(1.0::DOUBLE, upto / target + k * source_size / target) END AS time FROM k),
z AS (SELECT *, CAST(sum(words) OVER (ORDER BY time ASC NULLS LAST, source ASC NULLS LAST, doc_id ASC NULLS LAST, size, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reached FROM q)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(words) AS BIGINT) AS taken, max(CASE WHEN k = 0 AND words > 0 THEN reached END) AS upto_words FROM z GROUP BY doc_id
"""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END)) AS g FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_WORDS = f"regexp_extract_all({_AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS s FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k) WHERE len(w) > 0),
p AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM d, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k) WHERE len(w) >= n),
m AS (SELECT doc_id, k, n, item_id FROM p JOIN win USING (n, s)),
h AS (SELECT doc_id, COUNT(DISTINCT pos) AS n_hit FROM m, LATERAL (SELECT unnest(range(k, k + n)) AS pos) GROUP BY 1),
i AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_FINITE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_OP11 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, COUNT(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def _op12(k: int, rounds: int, dim: int) -> str:
    """Each round is a table of assignments and one of centroids."""
    steps = [f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND {_FINITE})"]
    steps.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))")
    for r in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, min({{'d': {gap}, 'c': c}}) AS best FROM (SELECT row_number() OVER () AS id, * FROM v), c{r} GROUP BY id, vec_id, x)")
        if r < rounds:
            moved = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM (SELECT best.c AS c, j, sum(x[j]) AS s, COUNT(*) AS n FROM a{r}, range(1, {dim} + 1) t(j) GROUP BY 1, 2) GROUP BY c"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN ({moved}) n USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c"""


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"
_OP13 = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM t),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
u AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM v),
p AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, COUNT(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p) GROUP BY doc_id, q, k HAVING COUNT(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN d USING (doc_id, i) GROUP BY doc_id),
f AS (SELECT doc_id, COUNT(*) AS n_runs, arg_max({{'start': start, 'length': length, 'period': period}}, [length, -start, -period]) AS top, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS told FROM r GROUP BY doc_id)
SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period, CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM v LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLE: dict[str, str] = {"op1_near_dedup": _OP1, "op5_mixing": _OP5, "op7_decontaminate": _OP7, "op11_vector_dedup": _OP11, "op12_centroids": _op12(8, 10, 64), "op13_periodic_runs": _OP13}
