"""The operators as queries over the driver's tables: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.get(F.col("copies.position"), 0)
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    order = [F.asc_nulls_last("position"), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.suffix_dedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.neighbours import search

    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = search(vectors.filter(F.col("id") % 20 == 0), vectors, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.language_model import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from briefmill.llm.common import shared_dir
    from briefmill.llm.warc import capture_index, write_archives

    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/warc"
    write_archives(_table(spark, sf_dir, "pages"), path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.exact_dedup import classify

    return classify(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.jaccard_join import join

    return join(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.line_dedup import summary

    found = summary(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.clusters import report

    return report(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.bpe import decode, encode

    ids = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True).drop("text")
    tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return decode(ids).select("doc_id", tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_OPERATORS = (
    op1_mixing, op2_suffix_dedup, op3_toxicity, op4_neighbours, op5_language_model, op6_warc, op7_exact_dedup, op8_jaccard_join, op9_line_dedup,
    op10_packing, op11_clusters, op12_bpe, op13_resampling,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _clusters_sql(clusters: int = 16, rounds: int = 3, dimensions: int = 64) -> str:
    """Each round as two tables: every vector's nearest centroid, then the centroids."""
    far = "list_sum(list_transform(range(1, {d}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(d=dimensions + 1)
    to = "SELECT row_no, min(k) AS k, any_value(d)::BIGINT AS d FROM (SELECT v.row_no, c.k, {far} AS d, min({far}) OVER (PARTITION BY v.row_no) AS least FROM v, c{r} c) WHERE d = least GROUP BY row_no"
    parts = [
        "x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e, row_number() OVER () AS row_no FROM embeddings)",
        f"v AS (SELECT vec_id, row_no, list_transform(e, lambda y: floor(64 * y)::BIGINT) AS x FROM x WHERE len(e) = {dimensions} AND len(list_filter(e, lambda y: y IS NOT NULL AND isfinite(y))) = {dimensions})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x FROM v ORDER BY k LIMIT {clusters})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS ({to.format(far=far, r=r)})")
        sums = f"SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (row_no), range(1, {dimensions + 1}) t(i) GROUP BY k, i"
        # sums and counts are whole: // cuts towards zero, so one less where a negative sum leaves a rest
        down = "((s // n) - CASE WHEN s < 0 AND s % n <> 0 THEN 1 ELSE 0 END)::BIGINT"
        parts.append(f"m{r} AS (SELECT k, list({down} ORDER BY i) AS x FROM ({sums}) GROUP BY k)")
        parts.append(f"c{r + 1} AS (SELECT k, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (k))")
    parts.append(f"a{rounds} AS ({to.format(far=far, r=rounds)})")
    return f"""WITH {", ".join(parts)}
 SELECT vec_id, a.k::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (row_no) JOIN c{rounds} c ON c.k = a.k"""


def _resampling_sql(buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> str:
    """The CRC of each distinct word goes byte by byte through a table made from its polynomial."""
    words = f"regexp_extract_all({_LOW.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    step = "lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    table = f"list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), {step}, i::BIGINT))"
    octets = "list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)"
    crc = f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, t.x[1 + xor(c, b) % 256]), 4294967295::BIGINT), 4294967295)"
    return f"""WITH t AS (SELECT {table} AS x), d AS (SELECT doc_id, {words} AS ws FROM documents), g AS (SELECT {words} AS ws FROM benchmark),
 dw AS (SELECT doc_id, unnest(ws) AS w FROM d), gw AS (SELECT unnest(ws) AS w FROM g),
 named AS (SELECT w, ({crc} % {buckets})::INT AS b FROM (SELECT w FROM dw UNION SELECT w FROM gw), t),
 s AS (SELECT b, count(*) AS n FROM dw JOIN named USING (w) GROUP BY b), h AS (SELECT b, count(*) AS n FROM gw JOIN named USING (w) GROUP BY b),
 al AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM h), 0)::DOUBLE AS t),
 gain AS (SELECT s.b, floor(1000 * ln((coalesce(h.n, 0) + 1)::DOUBLE * (al.s + {buckets}) / ((s.n + 1)::DOUBLE * (al.t + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN h USING (b), al),
 sums AS (SELECT doc_id, sum(gain)::BIGINT AS total FROM dw JOIN named USING (w) JOIN gain USING (b) GROUP BY doc_id),
 f AS (SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n, coalesce(total, 0) AS total FROM d LEFT JOIN sums USING (doc_id)),
 w AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE total // n - CASE WHEN total < 0 AND total % n <> 0 THEN 1 ELSE 0 END END AS weight,
  ('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT AS h FROM f),
 z AS (SELECT doc_id, n AS n_features, weight::BIGINT AS weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score, n >= {least} AS enough FROM w),
 r AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS k, count_if(enough) OVER () AS m FROM z)
 SELECT doc_id, n_features, weight, score, CASE WHEN enough AND k <= {percent} * m // 100 THEN k END AS rank FROM r"""


ORACLE_SQL: dict[str, str] = {
    "op11_clusters": _clusters_sql(),
    "op13_resampling": _resampling_sql(),
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
 q AS (SELECT *, strlen(html) >= 100 AND first <> page_id AS again FROM p)
 SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN again THEN first END AS refers_to FROM q""",
    "op7_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
 FROM (SELECT doc_id, {_LOW.format("coalesce(text, '')")} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op8_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
 links AS (SELECT a AS i, b AS o FROM l UNION ALL SELECT b, a FROM l),
 reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.o FROM reach JOIN links ON reach.r = links.i)
 SELECT doc_id, len(s) AS n_shingles, c AS component_id FROM s JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op9_line_dedup": f"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
 y AS (SELECT doc_id, unnest(range(0, len(l))) AS k, unnest(l) AS line FROM x),
 z AS (SELECT doc_id, k, list_sort(list_distinct({_WORDS.format(_LOW.format("line"))})) AS t FROM y),
 u AS (SELECT t, min(doc_id * 1000000 + k) AS first, row_number() OVER () AS id FROM z WHERE len(t) > 0 GROUP BY t),
 e AS (SELECT id, first, len(t) AS n, unnest(t) AS w FROM u),
 near AS (SELECT DISTINCT id FROM (SELECT a.id FROM e a JOIN e b ON a.w = b.w AND b.first < a.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*)))),
 gone AS (SELECT doc_id, count(*) AS c, string_agg(k::VARCHAR, ',' ORDER BY k) AS ks FROM z JOIN u USING (t) WHERE doc_id * 1000000 + k <> first OR id IN (SELECT id FROM near) GROUP BY doc_id)
 SELECT x.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_removed, coalesce(ks, '') AS removed_lines FROM x LEFT JOIN gone USING (doc_id)""",
}
