"""DuckDB SQL of the registered queries, written from the definitions alone."""

from __future__ import annotations

from .search import BOOK, DIM, K, KC, KP, MP, PQ_ROUNDS, ROUNDS, TRIM, W

WIDTH = DIM // MP


def _fold(a: str, b: str, kind: str = "double") -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::{kind} - z[2]::{kind}) * (z[1]::{kind} - z[2]::{kind})))"


BASE = ["v AS (SELECT vec_id, embedding AS e FROM embeddings)", "q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id % 50 = 0)"]


def _lloyd(rounds: int) -> list[str]:
    """Centers c0.., labels l0.. of the coarse codebook; the last round only assigns."""
    out = [f"c0 AS (SELECT vec_id::INT AS cid, e AS center FROM v WHERE vec_id < {KC})"]
    for i in range(rounds):
        out.append(
            f"l{i} AS MATERIALIZED (SELECT vec_id, cid FROM (SELECT vec_id, cid, row_number() OVER (PARTITION BY vec_id ORDER BY {_fold('e', 'center')}, cid) AS r "
            f"FROM v, c{i}) WHERE r = 1)"
        )
        if i < rounds - 1:
            out.append(
                f"u{i} AS (SELECT cid, list(x ORDER BY pos) AS center FROM (SELECT cid, pos, (sum(x::DOUBLE) / count(*))::FLOAT AS x FROM "
                f"(SELECT cid, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM l{i} JOIN v USING (vec_id)) GROUP BY cid, pos) GROUP BY cid)"
            )
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cid, coalesce(u{i}.center, c{i}.center) AS center FROM c{i} LEFT JOIN u{i} USING (cid))")
    return [*out, f"c AS (SELECT * FROM c{rounds - 1})", f"l AS (SELECT * FROM l{rounds - 1})"]


def _pq_lloyd() -> list[str]:
    out = [
        f"s AS MATERIALIZED (SELECT vec_id, m::INT AS m, list_slice(e, m * {WIDTH} + 1, (m + 1) * {WIDTH}) AS p FROM v, range({MP}) t(m))",
        f"p0 AS (SELECT m, vec_id::INT AS ks, p AS center FROM s WHERE vec_id < {KP})",
    ]
    for i in range(PQ_ROUNDS):
        out.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, m, ks FROM (SELECT vec_id, s.m, ks, row_number() OVER (PARTITION BY vec_id, s.m ORDER BY {_fold('p', 'center')}, ks) AS r "
            f"FROM s JOIN p{i} ON s.m = p{i}.m) WHERE r = 1)"
        )
        if i < PQ_ROUNDS - 1:
            out.append(
                f"w{i} AS (SELECT m, ks, list(x ORDER BY pos) AS center FROM (SELECT m, ks, pos, (sum(x::DOUBLE) / count(*))::FLOAT AS x FROM "
                f"(SELECT m, ks, generate_subscripts(p, 1) AS pos, unnest(p) AS x FROM a{i} JOIN s USING (vec_id, m)) GROUP BY m, ks, pos) GROUP BY m, ks)"
            )
            out.append(f"p{i + 1} AS MATERIALIZED (SELECT p{i}.m, p{i}.ks, coalesce(w{i}.center, p{i}.center) AS center FROM p{i} LEFT JOIN w{i} USING (m, ks))")
    return [*out, f"pq AS (SELECT * FROM p{PQ_ROUNDS - 1})", f"code AS (SELECT * FROM a{PQ_ROUNDS - 1})"]


def _sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join([*BASE, *ctes]) + "\n" + select


def _ranked(source: str, k: int, columns: str = "qid, rank, vec_id, dist") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id)::INT AS rank FROM ({source})) WHERE rank <= {k}"


def _pairs(u8: str = "") -> str:
    quantized = "list_transform({}, lambda x: floor((x::DOUBLE + 1) * 127.5)::SMALLINT)"
    q = quantized.format("q") if u8 else "q"
    e = quantized.format("e") if u8 == "both" else "e"
    kind = "bigint" if u8 == "both" else "double"
    cast = "::BIGINT" if u8 == "both" else ""
    return _sql([f"a AS (SELECT qid, {q} AS q FROM q)", f"b AS (SELECT vec_id, {e} AS e FROM v)"], f"SELECT qid AS i, vec_id AS j, ({_fold('q', 'e', kind)}){cast} AS dist FROM a, b")


def _values(array: str, source: str, keys: str) -> str:
    return f"SELECT {keys}, (generate_subscripts({array}, 1) - 1)::INT AS pos, unnest({array})::DOUBLE AS value FROM {source}"


COARSE = _lloyd(ROUNDS)
CODES = [*COARSE, *_pq_lloyd()]
TOPW = (
    f"topw AS MATERIALIZED (SELECT qid, cid, rank FROM (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY {_fold('q', 'center')}, cid)::INT AS rank FROM q, c) "
    f"WHERE rank <= {W})"
)
ALL = f"SELECT qid, vec_id, {_fold('q', 'e')} AS dist FROM q, v"
SIZES = f"sizes AS (SELECT i::INT AS cid, count(vec_id) AS n FROM range({KC}) t(i) LEFT JOIN l ON l.cid = i GROUP BY i)"
SCAN = f"SELECT qid, vec_id, {_fold('q', 'e')} AS dist FROM topw JOIN l USING (cid) JOIN v USING (vec_id) JOIN q USING (qid)"
DISTANCES = f"dt AS MATERIALIZED (SELECT qid, m, ks, {_fold(f'list_slice(q, m * {WIDTH} + 1, (m + 1) * {WIDTH})', 'center')} AS d FROM q, pq)"
ADC = "adc AS MATERIALIZED (SELECT qid, vec_id, list_sum(list(d ORDER BY m)) AS dist FROM dt JOIN code USING (m, ks) GROUP BY qid, vec_id)"
PQ_SCAN = "SELECT adc.* FROM topw JOIN l USING (cid) JOIN adc USING (qid, vec_id)"
GIVEN = f"SELECT DISTINCT adc.* FROM (SELECT DISTINCT qid, unnest([qid % {KC}, (qid // 50) % {KC}])::INT AS cid FROM q) JOIN l USING (cid) JOIN adc USING (qid, vec_id)"
TRUTH = f"truth AS MATERIALIZED ({_ranked(ALL, K)})"
FOUND = f"found AS MATERIALIZED ({_ranked(SCAN, K)})"
COUNTS = "SELECT qid, sum(n)::BIGINT AS searched_cnt FROM topw JOIN sizes USING (cid) GROUP BY qid"

SQL: dict[str, str] = {
    "l2sqr_pairs": _pairs(),
    "l2sqr_u8_pairs": _pairs("both"),
    "l2sqr_u8_f32": _pairs("query"),
    "exact_nn1": _sql([], _ranked(ALL, 1)),
    "exact_knn": _sql([], _ranked(ALL, K)),
    "nearest_center": _sql(
        _lloyd(1), f"SELECT vec_id, cid, dist FROM (SELECT vec_id, cid, {_fold('e', 'center')} AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY {_fold('e', 'center')}, cid) AS r FROM v, c) WHERE r = 1"
    ),
    "kmeans_update": _sql(_lloyd(2), _values("center", "c", "cid")),
    "kmeans_centroids": _sql(COARSE, _values("center", "c", "cid")),
    "kmeans_labels": _sql(COARSE, "SELECT vec_id, cid FROM l"),
    "ivf_train": _sql(COARSE, _values("center", "c", "cid")),
    "ivf_assign": _sql(COARSE, "SELECT vec_id, cid FROM l"),
    "ivf_list_sizes": _sql([*COARSE, SIZES], "SELECT * FROM sizes"),
    "coarse_topw": _sql([*COARSE, TOPW], "SELECT qid, rank, cid FROM topw"),
    "ivf_search": _sql([*COARSE, TOPW], _ranked(SCAN, K)),
    "ivf_searched_cnt": _sql([*COARSE, TOPW, SIZES], COUNTS),
    "avg_searched_cnt": _sql([*COARSE, TOPW, SIZES], f"SELECT avg(searched_cnt) AS avg_searched_cnt FROM ({COUNTS})"),
    "subvector_slice": _sql(_pq_lloyd()[:1], _values("p", "s", "vec_id, m")),
    "pq_codebook": _sql(_pq_lloyd(), _values("center", "pq", "m, ks")),
    "ivfpq_train": _sql(_pq_lloyd(), _values("center", "pq", "m, ks")),
    "pq_encode": _sql(_pq_lloyd(), "SELECT vec_id, m, ks FROM code"),
    "pq_distance_table": _sql([*_pq_lloyd(), DISTANCES], "SELECT qid, m, ks, d AS dist FROM dt"),
    "pq_adc": _sql([*_pq_lloyd(), DISTANCES, ADC], "SELECT * FROM adc"),
    "ivfpq_list_sizes": _sql([*COARSE, SIZES], "SELECT * FROM sizes"),
    "ivfpq_postings": _sql(CODES, "SELECT cid, vec_id, m, ks FROM l JOIN code USING (vec_id)"),
    "ivfpq_search": _sql([*CODES, TOPW, DISTANCES, ADC], _ranked(PQ_SCAN, K)),
    "ivfpq_topk_given_topw": _sql([*CODES, DISTANCES, ADC], _ranked(GIVEN, K)),
    "ivfpq_scan_stats": _sql([*COARSE, TOPW, SIZES], "SELECT count(*) AS searched_clusters, sum(n)::BIGINT AS searched_vectors FROM topw JOIN sizes USING (cid)"),
    "pq_exhaustive": _sql([*_pq_lloyd(), DISTANCES, ADC], _ranked("SELECT * FROM adc", K)),
    "book_scan": _sql(COARSE, f"SELECT cid, vec_id FROM l WHERE cid IN ({', '.join(map(str, BOOK))})"),
    "gt_hits_per_cluster": _sql(
        [*COARSE, TRUTH],
        f"SELECT q.qid, i::INT AS cid, count(h.vec_id) AS hits FROM q CROSS JOIN range({KC}) t(i) LEFT JOIN (SELECT qid, vec_id, cid FROM truth JOIN l USING (vec_id)) h "
        "ON h.qid = q.qid AND h.cid = i GROUP BY q.qid, i",
    ),
    "recall_at_k": _sql(
        [*COARSE, TOPW, TRUTH, FOUND],
        f"SELECT {K}::INT AS k, (SELECT count(*) FROM truth JOIN found USING (qid, vec_id)) / ((SELECT count(*) FROM q) * {K})::DOUBLE AS recall",
    ),
    "recall_1_at_k": _sql(
        [*COARSE, TOPW, TRUTH, FOUND],
        f"SELECT {K}::INT AS k, avg((f.vec_id IS NOT NULL)::INT::DOUBLE) AS recall FROM truth t LEFT JOIN found f USING (qid, vec_id) WHERE t.rank = 1",
    ),
    "book_files": _sql(CODES, f"SELECT cid, vec_id, m, ks FROM l JOIN code USING (vec_id) WHERE cid IN ({', '.join(map(str, BOOK))})"),
    "codebook_files": _sql(_pq_lloyd(), _values("center", "pq", "m, ks")),
    "ground_truth_files": _sql([TRUTH], "SELECT dense_rank() OVER (ORDER BY qid) - 1 AS record, (rank - 1)::INT AS rank, vec_id, dist::FLOAT::DOUBLE AS dist FROM truth"),
    "trim_file": _sql([], f"SELECT vec_id, (generate_subscripts(e, 1) - 1)::INT AS pos, unnest(e)::DOUBLE AS value FROM v WHERE vec_id < {TRIM}"),
    "trim_dataset": f"SELECT vec_id, label FROM embeddings WHERE vec_id < {TRIM}",
}
