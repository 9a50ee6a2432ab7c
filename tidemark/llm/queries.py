"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op01_exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op02_suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).drop("span_starts", "span_ends")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op03_simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op04_warc import convert_archives, read_archives, write_arcs

    return read_archives(convert_archives(write_arcs(table(spark, sf_dir, "pages"))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op05_mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op06_toxicity import scores, train

    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op07_html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op08_token_file import read_digests, write_token_files

    return read_digests(write_token_files(table(spark, sf_dir, "documents"), byte_bpe()))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op09_embedding_dedup import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_bpe import Bpe

    docs = table(spark, sf_dir, "documents")
    return Bpe(docs, byte_bpe()).digests(docs)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_periodic_runs import collapse_runs, planted, run_digests

    return run_digests(collapse_runs(table(spark, sf_dir, "documents"), loop=planted()))


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_elkan import cluster_report

    return cluster_report(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_token_counts import TokenCounts

    docs = table(spark, sf_dir, "documents")
    return TokenCounts(docs, byte_bpe()).counts(docs)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_simhash, op4_warc, op5_mixing, op6_toxicity, op7_html, op8_token_file, op9_embedding_dedup, op10_bpe, op11_periodic_runs, op12_elkan, op13_token_counts, pipeline)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def clusters_sql(k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> str:
    """The rounds of op12_elkan one after the other."""

    def near(c: str) -> str:
        return f"""(SELECT r, vec_id, v, j, d FROM (SELECT x.r, x.vec_id, x.v, c.j, list_sum(list_transform(range(1, {size + 1}), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i]))) AS d FROM x, {c} c)
                   QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)"""

    steps = [f"""
        x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS j, v AS c FROM x ORDER BY j LIMIT {k})"""]
    for n in range(rounds):
        steps.append(f"""
        s{n} AS (SELECT j, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(range({size})) AS i, unnest(v) AS e FROM {near(f'c{n}')}) GROUP BY j, i),
        c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY j) m USING (j))""")
    return f"""WITH {','.join(steps)}
        SELECT vec_id, j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM {near(f'c{rounds}')} JOIN c{rounds} c USING (j)"""

RUNS_SQL = r"""
        WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                          xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT),
                                          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, _: xor(y >> 1, 3988292384 * (y & 1))), 4294967295::BIGINT), 4294967295) AS h
                   FROM documents),
        a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS m FROM h),
        d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END]) END AS w FROM a),
        p AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM d),
        g AS (SELECT doc_id, n, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        e AS MATERIALIZED (SELECT * FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
        isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
        found AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS len FROM isles GROUP BY doc_id, q, isle HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
        runs AS MATERIALIZED (SELECT doc_id, s, len, min(q) AS q FROM found GROUP BY ALL),
        summed AS (SELECT doc_id, count(*) AS n_runs, first(s ORDER BY len DESC, s, q) AS start, max(len) AS length, first(q ORDER BY len DESC, s, q) AS period, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM d LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
        FROM n JOIN g USING (t)""",
    "op5_mixing": """
        WITH sizes AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS size FROM documents GROUP BY source),
        wanted AS (SELECT source, size, pow(size, 0.7) AS want FROM sizes),
        rates AS (SELECT source, want * sum(size) OVER () / (sum(want) OVER () * size) AS rate FROM wanted),
        pmf AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
                FROM rates, LATERAL (SELECT unnest(range(0, ceil(rate + 10 * sqrt(rate) + 20)::BIGINT + 1)) AS k)),
        cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
        drawn AS (SELECT *, (('0x' || left(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM documents),
        counts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (c.c <= d.u) AS repeats
                   FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source GROUP BY ALL)
        SELECT doc_id, text, lang, source, n_chars, r AS repeat_no, repeats,
               md5('17:mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || r) AS mix_key
        FROM counts, LATERAL (SELECT unnest(range(1, repeats + 1)) AS r)""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        f AS (SELECT b, min(page_id) AS first FROM p GROUP BY b),
        h AS (SELECT page_id, octet_length(b) AS n, first, lower(sha1(b)) AS hex FROM p JOIN f USING (b)),
        bits AS (SELECT page_id, n, first, string_agg(right(bin(('0x' || substr(hex, 2 * i + 1, 2))::INT + 256), 8), '' ORDER BY i) AS s
                 FROM h, range(20) t(i) GROUP BY ALL),
        b32 AS (SELECT page_id, n, first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (list_sum(list_transform(range(5), lambda x: (substr(s, (5 * j + x + 1)::BIGINT, 1) = '1')::INT * (16 >> x))))::INT, 1), '' ORDER BY j) AS d
                FROM bits, range(32) t(j) GROUP BY ALL)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b32""",
    "op11_periodic_runs": RUNS_SQL,
    "op12_elkan": clusters_sql(),
}
