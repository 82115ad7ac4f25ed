"""SQL of the spectral methods, for the oracle.

What the kernel does with an eigensolver and a Gram matrix is stated here by
other means, so that both can be held against each other: the Fiedler vector is
what repeated squaring leaves of the matrix 2 I - L without its trivial
eigenvector (for an eigenvalue of several vectors, their projection), and the optimizer's steps are written out, one after the other, on
the vectors themselves.
"""

from __future__ import annotations

from prismrank.plans import fixtures as X

SQUARINGS = 22
#: One query for all samples instead of the label's centroid.
SHARED_QUERY = "cq AS (SELECT DISTINCT sigma, label, [1.0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS q FROM v, sg)"
OWN_LABEL = "cq AS (SELECT sigma, label, q FROM c, sg)"
#: The label's centroid in the training part of each of five folds (the key sigma);
#: there a sample is a query in its own fold and in the gallery of the one before.
FOLD_LABEL = """cq AS (SELECT sigma, label, list(m ORDER BY d) AS q FROM (SELECT sigma, label, d, avg(x[d + 1]) AS m FROM b, sg, (SELECT unnest(range(8))::INT AS d) WHERE sample_id % 5 NOT IN (sigma, (sigma + 1) % 5) GROUP BY ALL) GROUP BY ALL)"""


def _dominant(source: str, name: str, times: int = SQUARINGS) -> list[str]:
    """``name``: what is left of the matrices ``source`` (sigma, sample_id, i, j,
    a) when they are squared again and again, to a trace of 1."""
    out, last = [], source
    for k in range(times):
        now = f"{name}{k}"
        out.append(
            f"{now} AS MATERIALIZED (SELECT sigma, sample_id, i, j, a / sum(a) FILTER (WHERE i = j) OVER (PARTITION BY sigma, sample_id) AS a FROM "
            f"(SELECT x.sigma, x.sample_id, x.i, y.j, sum(x.a * y.a) AS a FROM {last} x JOIN {last} y ON x.sigma = y.sigma AND x.sample_id = y.sample_id AND x.j = y.i GROUP BY ALL))"
        )
        last = now
    return [*out, f"{name} AS MATERIALIZED (SELECT * FROM {last})"]


def spectral(sigmas: tuple[float, ...] = (0.5,), query: str = OWN_LABEL, gap: bool = False) -> str:
    """Tables ``fw`` (sigma, sample_id, i, w) of Fiedler weights and ``fl`` (sigma,
    sample_id, lambda_2, and with ``gap`` lambda_3).  With ``FOLD_LABEL`` the key
    sigma is the fold and the temperature 0.5."""
    folds = query == FOLD_LABEL
    keys = [(k, 0.5) for k in range(5)] if folds else [(x, x) for x in sigmas]
    wanted = " WHERE sample_id % 5 IN (sigma, (sigma + 1) % 5)" if folds else ""
    steps = [
        f"sg(sigma, temperature) AS (VALUES {', '.join(f'({k}::DOUBLE, {t}::DOUBLE)' for k, t in keys)})",
        query,
        "cw AS MATERIALIZED (SELECT sigma, sample_id, i, x, t / sum(t) OVER (PARTITION BY sigma, sample_id) AS w FROM (SELECT sigma, sample_id, i, x, exp(s - max(s) OVER (PARTITION BY sigma, sample_id)) AS t FROM (SELECT sigma, sample_id, i, x, list_cosine_similarity(x, q) / temperature AS s FROM b JOIN cq USING (label) JOIN sg USING (sigma)" + wanted + ")))",
        "ra AS MATERIALIZED (SELECT y.sigma, y.sample_id, y.i, z.i AS j, greatest(list_cosine_similarity(y.x, z.x), 0) * y.w * z.w AS a FROM cw y JOIN cw z USING (sigma, sample_id))",
        "rd AS MATERIALIZED (SELECT sigma, sample_id, i, sum(a) + 1e-8 AS d FROM ra GROUP BY ALL)",
        "na AS MATERIALIZED (SELECT r.sigma, r.sample_id, r.i, r.j, r.a / sqrt(x.d * y.d) AS a FROM ra r JOIN rd x ON r.sigma = x.sigma AND r.sample_id = x.sample_id AND r.i = x.i JOIN rd y ON r.sigma = y.sigma AND r.sample_id = y.sample_id AND r.j = y.i)",
        "nd AS MATERIALIZED (SELECT sigma, sample_id, i, sum(a) AS d FROM na GROUP BY ALL)",
        "nt AS MATERIALIZED (SELECT sigma, sample_id, sum(d) AS t FROM nd GROUP BY ALL)",
        "md AS MATERIALIZED (SELECT n.sigma, n.sample_id, n.i, n.j, (n.i = n.j)::INT + n.a / sqrt(x.d * y.d) - 2 * sqrt(x.d * y.d) / t AS a FROM na n JOIN nd x ON n.sigma = x.sigma AND n.sample_id = x.sample_id AND n.i = x.i JOIN nd y ON n.sigma = y.sigma AND n.sample_id = y.sample_id AND n.j = y.i JOIN nt ON n.sigma = nt.sigma AND n.sample_id = nt.sample_id)",
        *_dominant("md", "pv"),
        "fw AS MATERIALIZED (SELECT sigma, sample_id, i, sqrt(greatest(a, 0)) / sum(sqrt(greatest(a, 0))) OVER (PARTITION BY sigma, sample_id) AS w FROM pv WHERE i = j)",
        "l2 AS MATERIALIZED (SELECT sigma, sample_id, 2 - sum(md.a * pv.a) AS lambda_2, round(1 / sum(pv.a * pv.a)) AS times FROM md JOIN pv USING (sigma, sample_id, i, j) GROUP BY ALL)",
    ]
    if gap:
        steps += [
            "me AS MATERIALIZED (SELECT sigma, sample_id, i, j, md.a - (2 - lambda_2) * pv.a AS a FROM md JOIN pv USING (sigma, sample_id, i, j) JOIN l2 USING (sigma, sample_id))",
            *_dominant("me", "pw"),
            "fl AS (SELECT sigma, sample_id, any_value(lambda_2) AS lambda_2, CASE WHEN any_value(times) > 1 THEN any_value(lambda_2) ELSE 2 - sum(me.a * pw.a) END AS lambda_3 FROM me JOIN pw USING (sigma, sample_id, i, j) JOIN l2 USING (sigma, sample_id) GROUP BY ALL)",
        ]
    else:
        steps.append("fl AS (SELECT * FROM l2)")
    return X.SQL_KNN + ", " + ", ".join(steps)


def refined(cells: list[tuple[float, float, int]]) -> str:
    """``cells``: sigma, rate and steps of each config.  Tables ``rw`` (config,
    sample_id, i, x, w, steps, first_loss, last_loss) and ``rf`` (config,
    sample_id, f)."""
    listed = ", ".join(f"({k}, {sigma}::DOUBLE, {rate}::DOUBLE, {steps})" for k, (sigma, rate, steps) in enumerate(cells))
    of = "PARTITION BY config, sample_id"
    out = [
        f"cf(config, sigma, lr, most) AS (VALUES {listed})",
        "sh AS (SELECT sample_id, j AS i, count(*) * 0.1 / (8 * 3) AS share FROM k GROUP BY ALL)",
        "s0 AS MATERIALIZED (SELECT config, sample_id, i, b.x AS e, coalesce(share, 0) AS share, lr, most, ln(greatest(fw.w, 1e-8)) AS z, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, true AS going, 0 AS steps, NULL::DOUBLE AS first_loss, NULL::DOUBLE AS last_loss FROM cf JOIN fw USING (sigma) JOIN b USING (sample_id, i) LEFT JOIN sh USING (sample_id, i))",
    ]

    def fused(t: int | str, weights: str, name: str) -> str:
        return f"{name} AS MATERIALIZED (SELECT config, sample_id, list(y ORDER BY d) AS f FROM (SELECT config, sample_id, d, sum({weights} * e[d + 1]) AS y FROM {t}, (SELECT unnest(range(8))::INT AS d) GROUP BY ALL) GROUP BY ALL)"

    soft = lambda s: f"SELECT *, ex / sum(ex) OVER ({of}) AS p FROM (SELECT *, exp(z - max(z) OVER ({of})) AS ex FROM {s})"
    for t in range(max(n for *_, n in cells)):
        out += [
            f"p{t} AS MATERIALIZED ({soft(f's{t}')})",
            fused(f"p{t}", "p", f"f{t}"),
            f"r{t} AS MATERIALIZED (SELECT *, share * dist AS part, CASE WHEN dist > 0 THEN share / dist ELSE 0 END AS pull FROM (SELECT p.*, f, list_distance(f, e) AS dist FROM p{t} p JOIN f{t} USING (config, sample_id)))",
            f"g{t} AS MATERIALIZED (SELECT config, sample_id, list(y ORDER BY d) AS g FROM (SELECT config, sample_id, d, sum(pull * (f[d + 1] - e[d + 1])) AS y FROM r{t}, (SELECT unnest(range(8))::INT AS d) GROUP BY ALL) GROUP BY ALL)",
            f"u{t} AS MATERIALIZED (SELECT *, p * (u - sum(p * u) OVER ({of})) AS gr, sum(part) OVER ({of}) AS loss FROM (SELECT r.*, list_dot_product(e, g) AS u FROM r{t} r JOIN g{t} USING (config, sample_id)))",
            f"h{t} AS (SELECT *, gr * least(1, 1 / (sqrt(sum(gr * gr) OVER ({of})) + 1e-6)) AS gc, going AND {t} < most AS now FROM u{t})",
            f"n{t} AS (SELECT *, 0.9 * m + 0.1 * gc AS m2, 0.999 * v + 0.001 * gc * gc AS v2 FROM h{t})",
            f"s{t + 1} AS MATERIALIZED (SELECT config, sample_id, i, e, share, lr, most, CASE WHEN now THEN z - lr * (m2 / {1 - 0.9 ** (t + 1)!r}) / (sqrt(v2 / {1 - 0.999 ** (t + 1)!r}) + 1e-8) ELSE z END AS z, m2 AS m, v2 AS v,"
            f" now AND NOT ({t} > 0 AND abs(last_loss - loss) < 1e-6) AS going, steps + now::INT AS steps, coalesce(first_loss, loss) AS first_loss, CASE WHEN now THEN loss ELSE last_loss END AS last_loss FROM n{t})",
        ]
    last = max(n for *_, n in cells)
    out += [f"rw AS MATERIALIZED (SELECT config, sample_id, i, e, p AS w, steps, first_loss, last_loss FROM ({soft(f's{last}')}))", fused("rw", "w", "ru"), unit("ru", "rf")]
    return ", " + ", ".join(out)


def unit(source: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT config, sample_id, list_transform(f, lambda y: y / sqrt(list_dot_product(f, f))) AS f FROM {source})"


def quality(features: str) -> str:
    """``aq`` (config, query_id, ap, h1, h5, h10) of ``features`` (config,
    sample_id, f): queries 0, gallery 1 to 2 of each five ids."""
    return f""", lf AS MATERIALIZED (SELECT config, sample_id, label, f FROM {features} JOIN v USING (sample_id)),
 pq AS (SELECT q.config, q.sample_id AS query_id, (q.label = g.label)::INT AS rel, row_number() OVER (PARTITION BY q.config, q.sample_id ORDER BY list_dot_product(q.f, g.f) DESC, g.sample_id) AS rank FROM lf q JOIN lf g ON q.config = g.config AND q.sample_id % 5 = 0 AND g.sample_id % 5 IN (1, 2)),
 ps AS (SELECT *, sum(rel) OVER (PARTITION BY config, query_id ORDER BY rank) AS seen FROM pq),
 aq AS (SELECT config, query_id, CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rel = 1 THEN seen / rank ELSE 0 END) / sum(rel) ELSE 0 END AS ap, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS h5, max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h10 FROM ps GROUP BY ALL),
 am AS (SELECT config, count(*) AS num_queries, avg(h1) * 100 AS r_at_1, avg(h5) * 100 AS r_at_5, avg(h10) * 100 AS r_at_10, avg(ap) * 100 AS map FROM aq GROUP BY config)"""


def axes(source: str, components: int) -> str:
    """``ev`` (k, i, w): the first eigenvectors of the covariance ``source``
    (sigma, sample_id, i, j, a: one matrix), each with its largest coefficient
    positive.  What a vector explains is taken off before the next one."""
    out, last = [], source
    for k in range(components):
        vector = f"SELECT i, a / sqrt(d) AS w FROM y{k} JOIN (SELECT i AS top, a AS d FROM y{k} WHERE i = j ORDER BY a DESC, i LIMIT 1) ON j = top"
        out += [*_dominant(last, f"y{k}", 16), f"e{k} AS MATERIALIZED ({vector})"]
        rest = f"SELECT sigma, sample_id, x.i, x.j, x.a - (SELECT sum(z.a * p.a) FROM {last} z JOIN y{k} p USING (i, j)) * y.a AS a FROM {last} x JOIN y{k} y USING (sigma, sample_id, i, j)"
        out.append(f"x{k} AS MATERIALIZED ({rest})")
        last = f"x{k}"
    listed = " UNION ALL ".join(f"SELECT {k} AS k, * FROM e{k}" for k in range(components))
    return ", ".join(out) + f", ev AS MATERIALIZED ({listed})"
