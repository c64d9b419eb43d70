"""Registered queries of this subpackage: thin, each reads its whole table and applies one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger.llm import ball_kmeans, personal_data, secrets
from voltledger.llm.decontaminate import contamination
from voltledger.llm.fingerprints import edited, likeness
from voltledger.llm.language_id import predict
from voltledger.llm.line_crf import quality
from voltledger.llm.line_dedup import remove_lines
from voltledger.llm.ngram_join import near_duplicates
from voltledger.llm.periodic_runs import periodic_runs
from voltledger.llm.piece_bpe import encode_decode
from voltledger.llm.spans import of_kind, rendered
from voltledger.llm.substring_dedup import remove_repeated_windows
from voltledger.llm.suffix_dedup import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(found: DataFrame, kinds: list[str], base: int) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans, and their number."""
    counts = [of_kind(F.col("spans"), k).alias(f"n_{kinds[k]}") for k in range(base)]
    own = F.filter("spans", lambda s: s["kind"] < base)
    return found.select("doc_id", *counts, F.sha2(rendered(own, kinds), 256).alias("base_sha256"), rendered(F.col("spans"), kinds).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(secrets.scan(_table(spark, sf_dir, "documents")), [r.kind for r in secrets.RULES], len(secrets.BASE))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it; clean documents have none."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), "n_shared")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(personal_data.find(_table(spark, sf_dir, "documents")), list(personal_data.KINDS), 4)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = edited(_table(spark, sf_dir, "documents"))
    own, near = F.col("fingerprint"), likeness(F.col("fingerprint"), F.col("edited_fingerprint"))
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"), "common_chars")


def _planted(docs: DataFrame) -> DataFrame:
    """The texts with the runs that the contract plants: behind word a, one document in ten repeats the next p words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    plant = F.col("__h").isNotNull() & (F.col("__h") % 10 == 0) & (F.size("__x") > 0)
    n, shift = F.size("__x"), F.col("__g")
    a = shift % n
    p = 1 + F.floor((n - a) / (3 + shift % 8))
    source = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: F.get(F.col("__x"), source(i).cast("int"))), " ")
    rows = docs.select("doc_id", "text", h.alias("__h"), g.alias("__g"), F.when(h % 10 == 0, words).alias("__x"))
    rows = rows.withColumns({"__a": F.when(plant, a), "__p": F.when(plant, p)})
    return rows.select("doc_id", F.when(plant, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic_runs(_planted(_table(spark, sf_dir, "documents")))
    # exact comparison of length / period: of two runs the one with the greater cross product
    ahead = lambda x, y: F.coalesce(y["length"] * x["period"] - x["length"] * y["period"], F.lit(0))
    order = lambda x, y: F.when(ahead(x, y) != 0, F.signum(ahead(x, y))).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")
    best = F.get(F.array_sort("runs", order), F.lit(0))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    done = done.withColumn("best", best)
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return done.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        milli.alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ball_kmeans.ball_kmeans(_table(spark, sf_dir, "embeddings"))
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scans, op3_quality_rules, op4_benchmark_decontamination, op5_language_id, op6_sentencepiece, op7_suffix_array_dedup, op8_substring_dedup, op9_personal_data, op10_line_dedup, op11_document_fingerprints, op12_periodic_runs, op13_ball_kmeans)}
# ---- The same results in DuckDB SQL, where SQL can express them. Learned or library results (3, 6, 9), edit distances (4), components (1) and
# ---- byte windows (7), fingerprints (11) and runs at every lag (12: a third of the square of a text's words) are tested against brute force, the
# ---- classifier (5) by held-out accuracy.

_LINES = r"""WITH l AS (SELECT doc_id, unnest(x) line, generate_subscripts(x, 1) n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) x FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key FROM l),
hot AS (SELECT key, max(doc_id) top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, coalesce(k.doc_id <> top, false) gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) kept_sha256 FROM j GROUP BY doc_id"""

_WINDOWS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') x FROM documents),
w AS (SELECT doc_id, unnest(x) word, generate_subscripts(x, 1) j FROM d),
v AS (SELECT doc_id, j, md5(array_to_string(x[j:j + 19], ' ')) h FROM (SELECT doc_id, x, unnest(range(1, len(x) - 18)) j FROM d WHERE len(x) >= 20)),
r AS (SELECT doc_id, j, row_number() OVER (PARTITION BY h ORDER BY doc_id, j) > 1 again FROM v),
c AS (SELECT w.*, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.j = w.j)
SELECT d.doc_id, count(word) n_words, count(*) FILTER (gone = 1) n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (gone = 0), '')) kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""


def _secrets_sql() -> str:
    """One SELECT a rule: pieces between matches and matches give the places, as in ``spans``."""
    text = "coalesce(text, '')"
    parts = []
    for no, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        keep = f"length(regexp_extract(x[i], '{pattern}', 2)) >= 12" if r.kind == "assign" else "true"
        parts.append(f"""SELECT doc_id, {no} no, '{r.kind}' kind, CAST(coalesce(list_sum(list_transform(p[1:i], lambda a: length(a))), 0) + coalesce(list_sum(list_transform(x[1:i - 1], lambda a: length(a))), 0) AS BIGINT) s, length(x[i]) n
FROM (SELECT doc_id, p, x, unnest(range(1, len(x) + 1)) i FROM (SELECT doc_id, string_split_regex({text}, '{pattern}') p, regexp_extract_all({text}, '{pattern}') x FROM documents)) WHERE {keep}""")
    base = len(secrets.BASE)
    joined = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (no = {k}) n_{r.kind}" for k, r in enumerate(secrets.BASE))
    return f"WITH m AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, {counts}, sha256({joined(f'no < {base}')}) base_sha256, {joined('no IS NOT NULL')} spans, count(no) n_spans FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id"


def _kmeans_sql(k: int = ball_kmeans.K, rounds: int = ball_kmeans.ROUNDS, dims: int = ball_kmeans.DIMS) -> str:
    """Rounds of comparing every vector with all centroids, written out one after the other."""
    finite = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    apart = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [f"v AS MATERIALIZED (SELECT row_number() OVER () r, vec_id, embedding, list_transform(embedding, lambda e: CAST(floor({ball_kmeans.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) x FROM embeddings WHERE len(embedding) = {dims} AND {finite})"]
    parts += [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, embedding) - 1 j, x FROM (SELECT sha256('{ball_kmeans.SALT}' || vec_id) h, embedding, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, embedding LIMIT {k}))"]
    for n in range(rounds + 1):
        parts += [f"a{n} AS MATERIALIZED (SELECT v.r, min(struct_pack(d := CAST({apart} AS BIGINT), j := c.j)) m FROM v CROSS JOIN c{n} c GROUP BY v.r)"]
        if n < rounds:
            parts += [f"s{n} AS (SELECT a.m.j j, i, CAST(sum(v.x[i]) AS BIGINT) s, count(*) n FROM v JOIN a{n} a USING (r) CROSS JOIN range(1, {dims + 1}) t(i) GROUP BY ALL)"]
            parts += [f"m{n} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) x FROM s{n} GROUP BY j)"]
            parts += [f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) x FROM c{n} c LEFT JOIN m{n} m USING (j))"]
    last = f"SELECT v.vec_id, a.m.j j, a.m.d d, c.x FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.j = a.m.j"
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) cluster_inertia, CAST(sum(d) OVER () AS BIGINT) inertia, sha256(array_to_string(x, ',')) centroid_sha256 FROM ({last})"


ORACLE_SQL: dict[str, str] = {"op2_secret_scans": _secrets_sql(), "op8_substring_dedup": _WINDOWS, "op10_line_dedup": _LINES, "op13_ball_kmeans": _kmeans_sql()}
