"""DuckDB SQL fragments for the oracle queries.

Each oracle is one SQL statement over the driver's pre-registered views.
These helpers only assemble text; they mirror the operator semantics, not
the Spark plans.
"""
from __future__ import annotations

VECS = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def norm(a: str) -> str:
    return f"sqrt(list_dot_product({a}, {a}))"


def cos(a: str, b: str) -> str:
    return (f"(list_dot_product({a}, {b}) / (greatest({norm(a)}, 1e-8) * greatest({norm(b)}, 1e-8)))")


def mean_vectors(src: str, keys: str, vec: str = "x") -> str:
    """SELECT keys..., c FROM element-wise mean of ``vec`` by keys (keys is a comma list)."""
    return (f"SELECT {keys}, list(m ORDER BY pos) AS c FROM ("
            f"SELECT {keys}, pos, avg(v) AS m FROM ("
            f"SELECT {keys}, unnest({vec}) AS v, unnest(range(len({vec}))) AS pos FROM {src}) "
            f"GROUP BY {keys}, pos) GROUP BY {keys}")


def class_mean_protos() -> str:
    return f"protos AS ({mean_vectors('(SELECT label AS q, x FROM vecs)', 'q')})"


def nearest_by_cos(src: str, protos: str = "protos") -> str:
    """(id, label, pred) with pred = argmax cosine, ties to the lowest q."""
    return (f"SELECT id, label, q AS pred FROM (SELECT v.id, v.label, p.q, "
            f"row_number() OVER (PARTITION BY v.id ORDER BY {cos('v.x', 'p.c')} DESC, p.q) AS rk "
            f"FROM {src} v CROSS JOIN {protos} p) WHERE rk = 1")


def dp_best(cells: str, mode: str = "max", prefix: str = "m") -> list[str]:
    """CTEs computing ``{prefix}_best(g, best)``: optimal 1:1 matching total per group ``g``.

    ``cells`` is a CTE with columns (g, r, c, v); rows and columns are indexed
    by dense rank inside g and padded to a square of zeros.
    """
    agg = "max" if mode == "max" else "min"
    p = prefix
    return [
        f"{p}_cells AS (SELECT g, dense_rank() OVER (PARTITION BY g ORDER BY r) - 1 AS ci, "
        f"dense_rank() OVER (PARTITION BY g ORDER BY c) - 1 AS cj, CAST(v AS DOUBLE) AS v FROM {cells})",
        f"{p}_k AS (SELECT g, greatest(max(ci), max(cj)) + 1 AS kk FROM {p}_cells GROUP BY g)",
        f"{p}_w AS (SELECT k.g, ri.i, cj.j, coalesce(c.v, 0.0) AS v FROM {p}_k k "
        f"CROSS JOIN range(0, 64) ri(i) CROSS JOIN range(0, 64) cj(j) "
        f"LEFT JOIN {p}_cells c ON c.g = k.g AND c.ci = ri.i AND c.cj = cj.j "
        f"WHERE ri.i < k.kk AND cj.j < k.kk)",
        f"{p}_dp(g, i, mask, best) AS (SELECT g, 0, CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE) FROM {p}_k "
        f"UNION ALL SELECT d.g, d.i + 1, d.mask | (CAST(1 AS BIGINT) << w.j), {agg}(d.best + w.v) "
        f"FROM {p}_dp d JOIN {p}_k k ON k.g = d.g "
        f"JOIN {p}_w w ON w.g = d.g AND w.i = d.i AND (d.mask & (CAST(1 AS BIGINT) << w.j)) = 0 "
        f"WHERE d.i < k.kk GROUP BY d.g, d.i + 1, d.mask | (CAST(1 AS BIGINT) << w.j))",
        f"{p}_best AS (SELECT d.g, {agg}(d.best) AS best FROM {p}_dp d JOIN {p}_k k "
        f"ON k.g = d.g AND d.i = k.kk GROUP BY d.g)",
    ]


def agreement(cont: str, prefix: str = "s") -> list[str]:
    """CTEs computing ``{prefix}_scores(g, n, ari, nmi, accuracy)`` from ``cont(g, pred, label, n_ij)``."""
    p = prefix
    return [
        f"{p}_cm AS (SELECT g, pred, label, CAST(n_ij AS DOUBLE) AS n_ij, "
        f"CAST(sum(n_ij) OVER (PARTITION BY g, label) AS DOUBLE) AS a_i, "
        f"CAST(sum(n_ij) OVER (PARTITION BY g, pred) AS DOUBLE) AS b_j, "
        f"CAST(sum(n_ij) OVER (PARTITION BY g) AS DOUBLE) AS n FROM {cont})",
        f"{p}_agg AS (SELECT g, any_value(n) AS n, sum(n_ij * n_ij) AS s_ij2, sum(n_ij * a_i) AS s_a2, "
        f"sum(n_ij * b_j) AS s_b2, sum(n_ij / n * ln(n * n_ij / (a_i * b_j))) AS mi_raw, "
        f"-sum(n_ij / n * ln(a_i / n)) AS h_true, -sum(n_ij / n * ln(b_j / n)) AS h_pred, "
        f"count(DISTINCT label) AS n_true, count(DISTINCT pred) AS n_pred, "
        f"sum(CASE WHEN pred = label THEN n_ij ELSE 0 END) AS tp FROM {p}_cm GROUP BY g)",
        f"{p}_pc AS (SELECT *, s_ij2 - n AS tp2, s_b2 - s_ij2 AS fp2, s_a2 - s_ij2 AS fn2, "
        f"n * n - (s_b2 - s_ij2) - (s_a2 - s_ij2) - s_ij2 AS tn2 FROM {p}_agg)",
        f"{p}_scores AS (SELECT g, CAST(n AS BIGINT) AS n, "
        f"CASE WHEN fn2 = 0 AND fp2 = 0 THEN 1.0 ELSE 2.0 * (tp2 * tn2 - fn2 * fp2) / "
        f"((tp2 + fn2) * (fn2 + tn2) + (tp2 + fp2) * (fp2 + tn2)) END AS ari, "
        f"CASE WHEN n_true = 1 AND n_pred = 1 THEN 1.0 WHEN abs(mi_raw) < 1e-15 THEN 0.0 "
        f"ELSE greatest(mi_raw, 0.0) / ((h_true + h_pred) / 2.0) END AS nmi, "
        f"tp / n AS accuracy FROM {p}_pc)",
    ]


def page(id_: str = "id") -> str:
    """Page of a vector id: runs of 300 ids make pages of 1, 2, ..., 24 paragraphs."""
    return f"(24 * ({id_} // 300) + CAST(floor((sqrt(8 * ({id_} % 300) + 1) - 1) / 2) AS BIGINT))"


def para(id_: str = "id") -> str:
    """Position of a vector id in its page."""
    t = f"CAST(floor((sqrt(8 * ({id_} % 300) + 1) - 1) / 2) AS BIGINT)"
    return f"CAST(({id_} % 300) - {t} * ({t} + 1) // 2 AS INTEGER)"


def report_select(scores: str = "s_scores", best: str = "m_best", keys: str = "", cont: str = "cont") -> str:
    """Final SELECT of a clustering report joined on g."""
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}s.n, CAST(b.best AS BIGINT) AS matched, {r6('b.best / s.n', 'acc')}, "
            f"{r6('s.ari', 'ari')}, {r6('s.nmi', 'nmi')}, {r6('s.accuracy', 'accuracy')}, "
            f"{r6('m.tp / (m.tp + m.fp)', 'precision_micro')}, {r6('m.tp / (m.tp + m.fn)', 'recall_micro')}, "
            f"{r6('CASE WHEN m.tp = 0 THEN 0.0 ELSE 2 * m.tp / (2 * m.tp + m.fp + m.fn) END', 'f1_micro')} "
            f"FROM {scores} s JOIN {best} b ON b.g = s.g JOIN {MICRO.format(cont=cont)} m ON m.g = s.g")


# true positives, false positives and false negatives of each class, summed per group
MICRO = ("(SELECT g, sum(tp) AS tp, sum(np - tp) AS fp, sum(nl - tp) AS fn FROM (SELECT g, cls, "
         "sum(CASE WHEN pred = cls AND label = cls THEN n_ij ELSE 0 END) AS tp, sum(CASE WHEN pred = cls THEN n_ij ELSE 0 END) AS np, "
         "sum(CASE WHEN label = cls THEN n_ij ELSE 0 END) AS nl FROM (SELECT c.*, k.cls FROM {cont} c JOIN (SELECT g, pred AS cls FROM {cont} "
         "UNION SELECT g, label FROM {cont}) k USING (g)) GROUP BY g, cls) GROUP BY g)")


def with_ctes(ctes: list[str], select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + select
