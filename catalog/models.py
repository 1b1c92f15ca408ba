"""k-medoids, rule clusters, frozen assignment, audits, pipelines and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ordinalia.operators import audit as A
from ordinalia.operators import pam
from ordinalia.operators import rules as RL
from ordinalia.operators import tiles as T
from ordinalia.operators import transfer as TR
from ordinalia.plans import gates as G
from ordinalia.plans import pipelines as PL
from ordinalia.runtime import checked_broadcast, cut, ensure_checkpoint_dir
from ordinalia.streaming import assign as STR

from . import inputs as I
from . import sql as L
from .matrix import _PAIR, _bare, _points, _ranked_pair_parts
from .registry import n, r6, register

# ---------------------------------------------------------------- k-medoids steps with given medoids

_THREE = """mds AS (SELECT dataset_id, sample_id, m FROM (SELECT dataset_id, sample_id,
    row_number() OVER (PARTITION BY dataset_id ORDER BY sample_id) - 1 AS m FROM samples) WHERE m < 3)"""
_DM = "dm AS (SELECT d.dataset_id, d.i, mds.m, d.d FROM d JOIN mds ON mds.dataset_id = d.dataset_id AND mds.sample_id = d.j)"
_EUC3 = L.matrix("m3") + L.scaled("m3", 10) + [f"d AS ({_PAIR['V_EUC_PAM']})", _THREE, _DM]


def _smallest_ids(points, count: int):
    """Profiles of the ``count`` smallest sample ids per space without gathering the space."""
    from pyspark.sql import Window as W

    # the rank filter is a top-k per space that Spark limits before the shuffle
    order = W.partitionBy("space_id").orderBy("sample_id")
    first = points.select("space_id", "sample_id").withColumn("_at", F.row_number().over(order)).where(
        F.col("_at") <= count
    )
    return (
        points.join(checked_broadcast(cut(first)), ["space_id", "sample_id"])
        .groupBy("space_id")
        .agg(F.array_sort(F.collect_list(F.struct("sample_id", "z", "q"))).cast(T.MEDOIDS).alias("medoids"))
    )


def _fixed_runs(points, blocks, method: str, count: int = 3):
    medoids = _smallest_ids(points, count)
    return cut(
        medoids.join(T.space_blocks(blocks), "space_id").select(
            "space_id", "blocks", F.col("space_id").alias("run_id"), F.lit(method).alias("method_id"),
            F.lit(0).alias("member_no"), "medoids",
        )
    )


@register(
    "build_costs",
    L.query(
        _EUC3 + ["d1 AS (SELECT dataset_id, i, d AS r FROM dm WHERE m = 0)"],
        f"""SELECT d.dataset_id, d.j AS sample_id, {L.r6('sum(least(d.d, r))')} AS cost FROM d JOIN d1 USING (dataset_id, i)
        WHERE d.j NOT IN (SELECT sample_id FROM mds WHERE m = 0 AND mds.dataset_id = d.dataset_id) GROUP BY ALL""",
    ),
)
def build_costs(spark, sf):
    """Cost of every sample as the second medoid, given the first."""
    points, _ = _points(spark, sf, I.m3, 10)
    blocks = T.block_table(points, _bare(points))
    costs = T.candidate_costs(blocks, _fixed_runs(points, blocks, "V_EUC_PAM", 1), 1, False, every_candidate=True, small=True)
    return costs.select(F.col("run_id").alias("dataset_id"), "sample_id", r6("c0").alias("cost"))


@register(
    "swap_costs",
    L.query(
        _EUC3
        + ["rest AS (SELECT a.dataset_id, a.i, a.m AS leaving, min(b.d) AS r FROM dm a JOIN dm b ON b.dataset_id = a.dataset_id AND b.i = a.i AND b.m <> a.m GROUP BY ALL)"],
        f"""SELECT d.dataset_id, d.j AS sample_id, leaving::bigint AS leaving, {L.r6('sum(least(d.d, r))')} AS cost
        FROM d JOIN rest ON rest.dataset_id = d.dataset_id AND rest.i = d.i
        WHERE (d.dataset_id, d.j) NOT IN (SELECT (dataset_id, sample_id) FROM mds) GROUP BY ALL""",
    ),
)
def swap_costs(spark, sf):
    """Cost after replacing each of three medoids by each other sample."""
    points, _ = _points(spark, sf, I.m3, 10)
    blocks = T.block_table(points, _bare(points))
    costs = T.candidate_costs(blocks, _fixed_runs(points, blocks, "V_EUC_PAM"), 3, True, every_candidate=True, small=True)
    long = costs.select(
        F.col("run_id").alias("dataset_id"), "sample_id", F.posexplode(F.array("c0", "c1", "c2")).alias("leaving", "cost")
    )
    return long.select("dataset_id", "sample_id", n("leaving").alias("leaving"), r6("cost").alias("cost"))


_NEAR = """near AS (SELECT dataset_id, i AS sample_id, m AS cluster, d AS nearest, lead(d) OVER w AS second
    FROM (SELECT dataset_id, i, m, round(d, 12) AS d FROM dm) WINDOW w AS (PARTITION BY dataset_id, i ORDER BY d, m)
    QUALIFY row_number() OVER w = 1)"""


def _fixed_fit(points, method, count=3):
    return cut(
        _smallest_ids(points, count).select(
            "space_id", F.col("space_id").alias("run_id"), F.lit(method).alias("method_id"), "medoids", F.lit("done").alias("status")
        )
    )


@register(
    "nearest_medoids",
    L.query(_EUC3 + [_NEAR], f"SELECT dataset_id, sample_id, cluster::bigint AS cluster, {L.r6('nearest')} AS nearest, {L.r6('second')} AS second FROM near"),
)
def nearest_medoids(spark, sf):
    points, _ = _points(spark, sf, I.m3, 10)
    labels = pam.assign(points, _bare(points), _fixed_fit(points, "V_EUC_PAM"))
    return labels.select(
        F.col("space_id").alias("dataset_id"), "sample_id", n("cluster").alias("cluster"),
        r6("nearest").alias("nearest"), r6("second").alias("second"),
    )


@register(
    "source_thresholds",
    L.query(
        _EUC3 + [_NEAR],
        f"""SELECT dataset_id, cluster::bigint AS cluster, {L.r6('quantile_cont(nearest, 0.95)')} AS radius,
        {L.r6('max(c05)')} AS confidence_q05 FROM near JOIN (SELECT dataset_id, quantile_cont((second - nearest) / greatest(second, 1e-15), 0.05) AS c05
        FROM near GROUP BY dataset_id) USING (dataset_id) GROUP BY dataset_id, cluster""",
    ),
)
def source_thresholds(spark, sf):
    points, _ = _points(spark, sf, I.m3, 10)
    labels = pam.assign(points, _bare(points), _fixed_fit(points, "V_EUC_PAM"))
    limits = TR.source_thresholds(cut(labels))
    return limits.select(
        F.col("run_id").alias("dataset_id"), F.posexplode("radius_q95").alias("cluster", "radius"), "confidence_q05"
    ).select("dataset_id", n("cluster").alias("cluster"), r6("radius").alias("radius"), r6("confidence_q05").alias("confidence_q05"))


def _one_run(points, method):
    return points.select("space_id").distinct().select(
        "space_id", F.col("space_id").alias("run_id"), F.lit(method).alias("method_id"), F.lit(0).alias("member_no")
    )


def _walk(k: int) -> list[str]:
    """All rounds of k-medoids over ``d(dataset_id, i, j, d)``: one row per round, from the first medoid on.

    ``walk.ids`` are the sorted medoids after round ``turn``, rounds up to ``k`` add one, later ones swap one.  A
    candidate costs what all samples pay with their nearest medoid or it; if it replaces a medoid, the samples of that
    medoid fall back to their second nearest.  Costs have ten decimals, ties go to the smaller set of ids.
    """
    return [
        "dd AS MATERIALIZED (SELECT dataset_id, i, j, round(d, 12) AS d FROM d)",
        f"""walk(dataset_id, turn, ids, objective) AS (
          SELECT dataset_id, 1, [j], cost FROM (
            SELECT dataset_id, j, round(sum(d::decimal(28,12)), 10)::decimal(38,10) AS cost FROM dd GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY cost, j) = 1
          UNION ALL
          SELECT dataset_id, turn + 1, after, cost FROM (
            SELECT dataset_id, turn, ids, objective, list_sort(list_append(list_filter(ids, lambda x: x <> leaving), j)) AS after,
              round(paid + coalesce(fallback[leaving], 0), 10)::decimal(38,10) AS cost
            FROM (
              SELECT *, unnest(CASE WHEN len(ids) < {k} THEN [''] ELSE ids END) AS leaving FROM (
              SELECT dataset_id, turn, ids, objective, j, sum(with_nearest) AS paid,
                map_from_entries(list((owner, with_second - with_nearest))) AS fallback
              FROM (
                SELECT near.dataset_id, turn, ids, objective, dd.j, owner, sum(least(dd.d, first)::decimal(28,12)) AS with_nearest,
                  sum(least(dd.d, second)::decimal(28,12)) AS with_second
                FROM (
                  SELECT m.dataset_id, turn, ids, objective, dd.i, (list(m.m ORDER BY dd.d, m.m))[1] AS owner,
                    min(dd.d) AS first, coalesce((list(dd.d ORDER BY dd.d))[2], 'inf'::double) AS second
                  FROM (SELECT *, unnest(ids) AS m FROM walk) m JOIN dd ON dd.dataset_id = m.dataset_id AND dd.j = m.m
                  GROUP BY ALL) near
                JOIN dd ON dd.dataset_id = near.dataset_id AND dd.i = near.i
                WHERE NOT list_contains(ids, dd.j) GROUP BY ALL)
              GROUP BY ALL)))
          WHERE len(ids) < {k} OR cost < objective
          QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY cost, after) = 1)""",
    ]


_VECTORS_SQL = L.query(
    L.matrix("m1")
    + L.scaled("m1", 64)
    + [
        "zl AS (SELECT dataset_id, sample_id, list(z ORDER BY feature_rank) AS zs FROM zed GROUP BY ALL)",
        """d AS (SELECT a.dataset_id, a.sample_id AS i, b.sample_id AS j, list_distance(a.zs, b.zs) AS d
          FROM zl a JOIN zl b USING (dataset_id))""",
    ]
    + _walk(10)
    + ["centres AS (SELECT dataset_id, unnest(ids) AS m, generate_subscripts(ids, 1) - 1 AS cluster FROM walk QUALIFY rank() OVER (PARTITION BY dataset_id ORDER BY turn DESC) = 1)"],
    f"""SELECT i AS sample_id, cluster::bigint AS cluster, {L.r6('d')} AS nearest
    FROM (SELECT dd.dataset_id, i, j, d, cluster FROM dd JOIN centres c ON c.dataset_id = dd.dataset_id AND c.m = dd.j)
    QUALIFY row_number() OVER (PARTITION BY dataset_id, i ORDER BY i <> j, d, cluster) = 1""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@register("kmedoids_vectors", _VECTORS_SQL)
def kmedoids_vectors(spark, sf):
    """Ten medoids of the embeddings over all their features, and every sample's cluster."""
    points, _ = _points(spark, sf, I.m1, 64)
    params = cut(_bare(points))
    fitted = pam.settled(pam.fit(points, params, _one_run(points, "V_EUC_PAM"), 10))
    return pam.assign(points, params, fitted).select("sample_id", n("cluster").alias("cluster"), r6("nearest").alias("nearest"))


_TRACE_SQL = L.query(
    L.matrix("m3") + L.scaled("m3", 10) + L.ranked() + [f"d AS ({_PAIR['R_FOOT_PAM']})"] + _walk(3),
    f"SELECT dataset_id, (turn - 3)::bigint AS step, {L.r6('objective::double')} AS objective FROM walk WHERE turn >= 3",
).replace("WITH ", "WITH RECURSIVE ", 1)


@register("kmedoids_trace", _TRACE_SQL)
def kmedoids_trace(spark, sf):
    """Objective after BUILD and after every swap, both supplier datasets in one fit."""
    points, _ = _points(spark, sf, I.m3, 10)
    fitted = pam.fit(points, cut(_bare(points)), _one_run(points, "R_FOOT_PAM"), 3)
    return pam.trace_table(fitted).select(F.col("run_id").alias("dataset_id"), n("step").alias("step"), r6("objective").alias("objective"))


# ---------------------------------------------------------------- rules


def _imputed(m: str, budget: int) -> list[str]:
    return (
        L.matrix(m) + L.stats(m)
        + [
            "mads AS (SELECT dataset_id, feature_id, quantile_cont(abs(coalesce(value, median) - median), 0.5) AS mad FROM grid GROUP BY ALL)",
            f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY mad DESC, feature_id) AS feature_rank FROM mads)
              WHERE feature_rank <= {budget})""",
            "imp AS (SELECT g.dataset_id, g.sample_id, t.feature_rank, g.feature_id, coalesce(g.value, g.median, 0) AS x FROM grid g JOIN top t USING (dataset_id, feature_id))",
            """rp AS (SELECT a.dataset_id, a.feature_id AS fa, b.feature_id AS fb,
                row_number() OVER (PARTITION BY a.dataset_id ORDER BY a.feature_rank, b.feature_rank) - 1 AS pair_no
              FROM top a JOIN top b ON a.dataset_id = b.dataset_id AND a.feature_rank < b.feature_rank)""",
            """bits AS (SELECT a.dataset_id, a.sample_id, rp.pair_no, (a.x > b.x)::int AS bit FROM rp
              JOIN imp a ON a.dataset_id = rp.dataset_id AND a.feature_id = rp.fa
              JOIN imp b ON b.dataset_id = rp.dataset_id AND b.feature_id = rp.fb AND b.sample_id = a.sample_id)""",
        ]
    )


_CLASSES = _imputed("m1", 12) + [
    "lab AS (SELECT lpad(vec_id::varchar, 20, '0') AS sample_id, label AS cluster FROM embeddings)",
    """cc AS (SELECT dataset_id, cluster, pair_no, sum(bit) AS ones, count(*) AS c FROM bits JOIN lab USING (sample_id) GROUP BY ALL)""",
    """con AS (SELECT *, CASE WHEN up THEN share ELSE 1 - share END AS support,
        CASE WHEN up THEN share ELSE 1 - share END - CASE WHEN up THEN every ELSE 1 - every END AS contrast
      FROM (SELECT dataset_id, cluster, pair_no, ones / c AS share, ones / c >= 0.5 AS up,
        sum(ones) OVER (PARTITION BY dataset_id, pair_no) / sum(c) OVER (PARTITION BY dataset_id, pair_no) AS every FROM cc))""",
    """pro AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, cluster ORDER BY round(contrast, 12) DESC, round(support, 12) DESC, pair_no) AS rule_rank
      FROM (SELECT *, support >= 0.55 AND contrast >= 0.02 AS strong, bool_or(support >= 0.55 AND contrast >= 0.02) OVER (PARTITION BY dataset_id, cluster) AS anystrong FROM con)
      WHERE strong OR NOT anystrong) WHERE rule_rank <= 6)""",
    "rul AS (SELECT pro.*, fa, fb, greatest(1e-12, support * greatest(contrast, 1e-6)) AS weight FROM pro JOIN rp USING (dataset_id, pair_no))",
]


def _class_counts(spark, sf):
    """Relation counts per label class of the embeddings: the label column is the partition."""
    m1 = I.m1(spark, sf)
    selected = cut(RL.select_features(m1, 12))
    rows = cut(RL.fit_rows(m1, selected))
    classes = I.table(spark, sf, "embeddings").select(
        F.lit("embeddings").alias("dataset_id"), I.padded("vec_id").alias("sample_id"), F.col("label").cast("int").alias("cluster")
    )
    return m1, selected, rows, classes, cut(RL.label_counts(rows, classes, 66))


@register(
    "relation_prevalence",
    L.query(_imputed("m3", 12), f"SELECT dataset_id, pair_no::bigint AS pair_no, {L.r6('avg(bit)')} AS prevalence FROM bits GROUP BY ALL"),
)
def relation_prevalence(spark, sf):
    m3 = I.m3(spark, sf)
    rows = RL.fit_rows(m3, cut(RL.select_features(m3, 12)))
    return RL.prevalence(rows, 66).select("dataset_id", n("pair_no").alias("pair_no"), r6("prevalence").alias("prevalence"))


@register(
    "prototype_contrasts",
    L.query(_CLASSES, f"""SELECT cluster::bigint AS cluster, pair_no::bigint AS pair_no, up::bigint AS direction, {L.r6('support')} AS support,
    {L.r6('contrast')} AS contrast FROM con"""),
)
def prototype_contrasts(spark, sf):
    *_, counts = _class_counts(spark, sf)
    return RL.contrasts(counts).select(
        n("cluster").alias("cluster"), n("pair_no").alias("pair_no"), n("direction").alias("direction"),
        r6("support").alias("support"), r6("contrast").alias("contrast"),
    )


def _class_rules(spark, sf):
    m1, selected, _, _, counts = _class_counts(spark, sf)
    return m1, RL.named_rules(RL.build_prototypes(counts, 6, 0.55, 0.02), selected, 66)


@register(
    "prototype_rules",
    L.query(_CLASSES, f"""SELECT cluster::bigint AS cluster, rule_rank::bigint AS rule_rank, fa AS feature_a, fb AS feature_b, up::bigint AS direction,
    {L.r6('support')} AS support, {L.r6('contrast')} AS contrast FROM rul"""),
)
def prototype_rules(spark, sf):
    _, rules = _class_rules(spark, sf)
    return rules.select(
        n("cluster").alias("cluster"), n("rule_rank").alias("rule_rank"), "feature_a", "feature_b",
        n("direction").alias("direction"), r6("support").alias("support"), r6("contrast").alias("contrast"),
    )


@register(
    "posthoc_rules",
    L.query(
        _CLASSES,
        """SELECT cluster::bigint AS cluster, rule_rank::bigint AS rule_rank, fa AS feature_a, fb AS feature_b FROM (
          SELECT *, row_number() OVER (PARTITION BY dataset_id, cluster ORDER BY round(contrast, 12) DESC, round(support, 12) DESC, pair_no) AS rule_rank FROM con)
        JOIN rp USING (dataset_id, pair_no) WHERE rule_rank <= 5""",
    ),
)
def posthoc_rules(spark, sf):
    _, selected, rows, classes, _ = _class_counts(spark, sf)
    rules = RL.named_rules(RL.posthoc(rows, classes, 66, 5), selected, 66)
    return rules.select(n("cluster").alias("cluster"), n("rule_rank").alias("rule_rank"), "feature_a", "feature_b")


_SCORES = _CLASSES + [
    """sco AS (SELECT a.sample_id, r.cluster, sum(CASE WHEN (a.value > b.value) = r.up THEN weight ELSE 0 END) / sum(weight) AS score
      FROM rul r JOIN m1 a ON a.feature_id = r.fa JOIN m1 b ON b.feature_id = r.fb AND b.sample_id = a.sample_id GROUP BY ALL)"""
]


@register(
    "rule_scores",
    L.query(_SCORES, f"SELECT sample_id, cluster::bigint AS cluster, {L.r6('score')} AS score FROM sco"),
)
def rule_scores(spark, sf):
    m1, rules = _class_rules(spark, sf)
    samples = RL.feature_maps(m1).withColumnRenamed("dataset_id", "model_id")
    assigned = RL.assign(samples, RL.rule_model(cut(rules)))
    return assigned.select("sample_id", F.posexplode("scores").alias("cluster", "score")).select(
        "sample_id", n("cluster").alias("cluster"), r6("score").alias("score")
    )


_RULE_ASSIGN = """SELECT sample_id, round(best, 6) + 0.0 AS best_score, round(best - second, 6) + 0.0 AS score_margin,
    CASE WHEN best >= 0.6 AND round(best - second, 12) >= 0.05 THEN cluster END::bigint AS accepted_cluster
  FROM (SELECT sample_id, cluster, s AS best, lead(s) OVER w AS second FROM (SELECT sample_id, cluster, round(score, 12) AS s FROM sco)
    WINDOW w AS (PARTITION BY sample_id ORDER BY s DESC, cluster) QUALIFY row_number() OVER w = 1)"""


@register("rule_assignment", L.query(_SCORES, _RULE_ASSIGN))
def rule_assignment(spark, sf):
    m1, rules = _class_rules(spark, sf)
    samples = RL.feature_maps(m1).withColumnRenamed("dataset_id", "model_id")
    return _rule_result(RL.assign(samples, RL.rule_model(cut(rules))))


def _rule_result(assigned):
    return assigned.select(
        "sample_id", r6("best_score").alias("best_score"), r6("score_margin").alias("score_margin"),
        n("accepted_cluster").alias("accepted_cluster"),
    )


_SEED_STEPS = [
    "prev AS (SELECT dataset_id, pair_no, avg(bit) AS p FROM bits GROUP BY ALL)",
    "aty AS (SELECT dataset_id, sample_id, round(avg(abs(bit - p)), 12) AS s FROM bits JOIN prev USING (dataset_id, pair_no) GROUP BY ALL)",
    "s1 AS (SELECT dataset_id, sample_id FROM aty QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY s DESC, sample_id) = 1)",
    """h1 AS (SELECT b.dataset_id, b.sample_id, round(avg((b.bit <> o.bit)::int), 12) AS h FROM bits b JOIN s1 ON s1.dataset_id = b.dataset_id
      JOIN bits o ON o.dataset_id = b.dataset_id AND o.sample_id = s1.sample_id AND o.pair_no = b.pair_no GROUP BY ALL)""",
    """s2 AS (SELECT dataset_id, sample_id FROM h1 WHERE (dataset_id, sample_id) NOT IN (SELECT (dataset_id, sample_id) FROM s1)
      QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY h DESC, sample_id) = 1)""",
]


@register(
    "rule_seeds",
    L.query(_imputed("m3", 12) + _SEED_STEPS, "SELECT dataset_id, 0::bigint AS seed, sample_id FROM s1 UNION ALL SELECT dataset_id, 1, sample_id FROM s2"),
)
def rule_seeds(spark, sf):
    """The most atypical sample and the one farthest from it."""
    m3 = I.m3(spark, sf)
    rows = cut(RL.fit_rows(m3, cut(RL.select_features(m3, 12))))
    seeds = RL.initial_seeds(rows, 2, 66)
    return seeds.select("dataset_id", F.posexplode("seeds").alias("seed", "s")).select(
        "dataset_id", n("seed").alias("seed"), F.col("s.sample_id").alias("sample_id")
    )


def _filled(scored: str, k: int, extra: str = "") -> str:
    """Labels of greatest score; empty clusters take the least secure members of the largest one, in order."""
    kept = f", {extra}" if extra else ""
    return f"""SELECT dataset_id, sample_id{kept}, CASE WHEN cluster = donor AND place <= len(free) THEN free[place] ELSE cluster END AS cluster
      FROM (
        SELECT *, list_filter({list(range(k))}, lambda c: NOT list_contains(list(cluster) OVER dataset, c)) AS free,
          first_value(cluster) OVER (PARTITION BY dataset_id ORDER BY size DESC, cluster, place) AS donor
        FROM (
          SELECT *, count(*) OVER (PARTITION BY dataset_id, cluster) AS size,
            row_number() OVER (PARTITION BY dataset_id, cluster ORDER BY secure, sample_id) AS place
          FROM (
            SELECT *, round(score - lead(score) OVER one, 12) AS secure FROM {scored}
            WINDOW one AS (PARTITION BY dataset_id, sample_id ORDER BY score DESC, cluster) QUALIFY row_number() OVER one = 1))
        WINDOW dataset AS (PARTITION BY dataset_id))"""


def _rules_of(labels: str, max_rules: int, min_support: float, min_contrast: float) -> str:
    """Rules of the clusters of ``labels(dataset_id, sample_id, cluster)``."""
    strong = f"support >= {min_support} AND contrast >= {min_contrast}"
    return f"""(SELECT *, greatest(1e-12, support * greatest(contrast, 1e-6)) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset_id, cluster ORDER BY round(contrast, 12) DESC, round(support, 12) DESC, pair_no) AS rule_rank
        FROM (SELECT *, {strong} AS strong, bool_or({strong}) OVER (PARTITION BY dataset_id, cluster) AS anystrong
          FROM (SELECT *, CASE WHEN up THEN share ELSE 1 - share END AS support,
              CASE WHEN up THEN share ELSE 1 - share END - CASE WHEN up THEN every ELSE 1 - every END AS contrast
            FROM (SELECT dataset_id, cluster, pair_no, ones / c AS share, ones / c >= 0.5 AS up,
                sum(ones) OVER (PARTITION BY dataset_id, pair_no) / sum(c) OVER (PARTITION BY dataset_id, pair_no) AS every
              FROM (SELECT l.dataset_id, l.cluster, b.pair_no, sum(b.bit) AS ones, count(*) AS c
                FROM {labels} l JOIN bits b ON b.dataset_id = l.dataset_id AND b.sample_id = l.sample_id GROUP BY ALL))))
        WHERE strong OR NOT anystrong) WHERE rule_rank <= {max_rules})"""


def _scores_of(rules: str) -> str:
    return f"""(SELECT r.dataset_id, b.sample_id, r.cluster, round(sum(CASE WHEN b.bit = r.up::int THEN r.weight ELSE 0 END) / sum(r.weight), 12) AS score
      FROM {rules} r JOIN bits b ON b.dataset_id = r.dataset_id AND b.pair_no = r.pair_no GROUP BY ALL)"""


def _rule_walk(m: str, budget: int, k: int, max_rules: int, min_support: float, min_contrast: float) -> list[str]:
    """All rounds of rule clustering for two or three clusters: ``rounds`` has the labels of every round until none
    changes, ``final`` those of the last, ``rules`` what is built from them."""
    parts = [p.replace("bits AS (", "bits AS MATERIALIZED (") for p in _imputed(m, budget)] + _SEED_STEPS
    seeds = ["SELECT dataset_id, 0 AS cluster, sample_id FROM s1", "SELECT dataset_id, 1, sample_id FROM s2"]
    if k == 3:
        parts += [
            """h2 AS (SELECT dataset_id, sample_id, min(h) AS h FROM (SELECT * FROM h1 UNION ALL
              SELECT b.dataset_id, b.sample_id, round(avg((b.bit <> o.bit)::int), 12) FROM bits b JOIN s2 ON s2.dataset_id = b.dataset_id
              JOIN bits o ON o.dataset_id = b.dataset_id AND o.sample_id = s2.sample_id AND o.pair_no = b.pair_no GROUP BY ALL) GROUP BY ALL)""",
            """s3 AS (SELECT dataset_id, sample_id FROM h2 WHERE (dataset_id, sample_id) NOT IN (SELECT (dataset_id, sample_id) FROM s1 UNION ALL SELECT (dataset_id, sample_id) FROM s2)
              QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY h DESC, sample_id) = 1)""",
        ]
        seeds.append("SELECT dataset_id, 2, sample_id FROM s3")
    return parts + [
        f"seeds AS ({' UNION ALL '.join(seeds)})",
        """closeness AS (SELECT b.dataset_id, b.sample_id, s.cluster, -round(avg((b.bit <> o.bit)::int), 12) AS score FROM bits b
          JOIN seeds s ON s.dataset_id = b.dataset_id
          JOIN bits o ON o.dataset_id = b.dataset_id AND o.sample_id = s.sample_id AND o.pair_no = b.pair_no GROUP BY ALL)""",
        f"""rounds(dataset_id, turn, sample_id, cluster) AS (
          SELECT dataset_id, 0, sample_id, cluster FROM ({_filled('closeness', k)})
          UNION ALL
          SELECT dataset_id, turn, sample_id, cluster FROM (
            SELECT old.dataset_id, old.turn + 1 AS turn, old.sample_id, fresh.cluster,
              bool_or(old.cluster <> fresh.cluster) OVER (PARTITION BY old.dataset_id) AS moved
            FROM rounds old
            JOIN ({_filled(_scores_of(_rules_of('rounds', max_rules, min_support, min_contrast)), k)}) fresh
              ON fresh.dataset_id = old.dataset_id AND fresh.sample_id = old.sample_id)
          WHERE moved AND turn <= 50)""",
        "final AS (SELECT * FROM rounds QUALIFY rank() OVER (PARTITION BY dataset_id ORDER BY turn DESC) = 1)",
        f"rules AS {_rules_of('final', max_rules, min_support, min_contrast)}",
    ]


@register(
    "rule_clusters",
    L.query(
        _rule_walk("m1", 64, 3, 15, 0.6, 0.05),
        f"""SELECT sample_id, final.cluster::bigint AS cluster, {L.r6('best - second')} AS score_margin
        FROM (SELECT dataset_id, sample_id, max(score) AS best, (list(score ORDER BY score DESC))[2] AS second
          FROM {_scores_of('rules')} GROUP BY ALL) JOIN final USING (dataset_id, sample_id)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def rule_clusters(spark, sf):
    """Rule clusters of the embeddings over all their features, with the margin between best and second score."""
    fitted = RL.fit(I.m1(spark, sf), k=3, feature_budget=64, max_rules=15, min_support=0.6, min_contrast=0.05)
    return fitted["labels"].select("sample_id", n("cluster").alias("cluster"), r6("score_margin").alias("score_margin"))


@register(
    "rule_cluster_prototypes",
    L.query(
        _rule_walk("m3", 12, 2, 8, 0.7, 0.1),
        f"""SELECT dataset_id AS model_id, cluster::bigint AS cluster, rule_rank::bigint AS rule_rank, fa AS feature_a, fb AS feature_b,
        up::int::bigint AS direction, {L.r6('support')} AS support, {L.r6('contrast')} AS contrast FROM rules JOIN rp USING (dataset_id, pair_no)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def rule_cluster_prototypes(spark, sf):
    """Executable rules of the supplier datasets."""
    fitted = RL.fit(I.m3(spark, sf), k=2, feature_budget=12, max_rules=8, min_support=0.7)
    return fitted["rules"].select(
        "model_id", n("cluster").alias("cluster"), n("rule_rank").alias("rule_rank"), "feature_a", "feature_b",
        n("direction").alias("direction"), r6("support").alias("support"), r6("contrast").alias("contrast"),
    )


# ---------------------------------------------------------------- frozen assignment with given medoids

# medoids: the three smallest sample ids with complete rows; weights 1, 2, ... over all pairs in rank order
_FROZEN_PARTS = _ranked_pair_parts("m2", 10) + [
    "full_rows AS (SELECT dataset_id, sample_id FROM ranks GROUP BY ALL HAVING count(*) = 10)",
    "mds AS (SELECT sample_id, m FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS m FROM full_rows) WHERE m < 3)",
    "obs AS (SELECT sample_id, count(*) FILTER (raw IS NOT NULL) AS seen FROM zed GROUP BY ALL)",
    """de AS (SELECT a.sample_id, m, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM zed a JOIN zed b USING (feature_id) JOIN mds ON mds.sample_id = b.sample_id GROUP BY ALL)""",
    "cen AS (SELECT sample_id, feature_id, z - avg(z) OVER (PARTITION BY sample_id) AS c FROM zed)",
    """dc AS (SELECT a.sample_id, m, 1 - least(greatest(sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c))), -1.0), 1.0) AS d
      FROM cen a JOIN cen b USING (feature_id) JOIN mds ON mds.sample_id = b.sample_id GROUP BY ALL)""",
    """df AS (SELECT a.sample_id, m, least(greatest(sum(abs(a.q - b.q)) * 9.0 / 50.0 * (10.0 / count(*)), 0.0), 1.0) AS d, count(*) AS c
      FROM ranks a JOIN ranks b USING (feature_id) JOIN mds ON mds.sample_id = b.sample_id GROUP BY ALL)""",
    """dp AS (SELECT a.sample_id, m, sum(CASE WHEN a.state <> b.state THEN a.weight ELSE 0 END) / sum(a.weight) AS d
      FROM st a JOIN st b USING ("left", "right") JOIN mds ON mds.sample_id = b.sample_id GROUP BY ALL)""",
    "rc AS (SELECT sample_id, sum(weight) / (SELECT sum(weight) FROM w) AS relation_coverage FROM st GROUP BY ALL)",
    "sm AS (SELECT samples.sample_id, m FROM samples, mds)",
    """dist AS (SELECT 'V_EUC_PAM' AS method_id, sample_id, m, d FROM de
      UNION ALL SELECT 'V_COR_PAM', sample_id, m, coalesce(d, 2.0) FROM sm LEFT JOIN dc USING (sample_id, m)
      UNION ALL SELECT 'R_FOOT_PAM', sample_id, m, CASE WHEN coalesce(c, 0) < 2 THEN 1.0 ELSE d END FROM sm LEFT JOIN df USING (sample_id, m)
      UNION ALL SELECT 'R_PAIR_PAM', sample_id, m, coalesce(d, 1.0) FROM sm LEFT JOIN dp USING (sample_id, m)
      UNION ALL SELECT 'H_EUC_PAIR_A025_PAM', sample_id, m, 0.75 * de.d / 1.5 + 0.25 * coalesce(dp.d, 1.0) / 0.4 FROM de LEFT JOIN dp USING (sample_id, m))""",
]
_FROZEN_METHODS = ("V_EUC_PAM", "V_COR_PAM", "R_FOOT_PAM", "R_PAIR_PAM", "H_EUC_PAIR_A025_PAM")


def _frozen(spark, sf):
    """A frozen model over the event matrix with the three smallest complete rows as medoids."""
    points, model = _points(spark, sf, I.m2, 10)
    complete = points.where(~F.exists("q", lambda v: v.isNull()))
    medoids = _smallest_ids(complete, 3)
    widths = F.expr(
        "flatten(transform(sequence(0, 8), i -> transform(sequence(i + 1, 9), j -> struct(i AS l, j AS r))))"
    )
    relations = medoids.select("space_id", "medoids", widths.alias("_l"))
    base = relations.join(model.withColumnRenamed("dataset_id", "space_id"), "space_id").selectExpr(
        "space_id AS model_id",
        "feature_ids",
        "medians",
        "scales",
        "medoids",
        f"explode(array({', '.join(repr(m) for m in _FROZEN_METHODS)})) AS method_id",
        "CAST(_l.l AS array<int>) AS pl",
        "CAST(_l.r AS array<int>) AS pr",
        "transform(_l, (p, i) -> i + 1.0D) AS pw",
    )
    pairs = "method_id IN ('R_PAIR_PAM', 'H_EUC_PAIR_A025_PAM')"
    return cut(
        base.selectExpr(
            "model_id", "method_id", "feature_ids", "medians", "scales", "medoids",
            f"if({pairs}, pl, CAST(array() AS array<int>)) AS pair_left",
            f"if({pairs}, pr, CAST(array() AS array<int>)) AS pair_right",
            f"if({pairs}, pw, CAST(array() AS array<double>)) AS pair_weight",
            "0.0D AS margin", "1.5D AS value_scale", "0.4D AS relational_scale", "0.25D AS alpha",
            "array(1.5D, 1.5D, 1.5D) AS radius_q95", "0.05D AS confidence_q05",
            "0.8D AS min_feature_coverage", "0.8D AS min_relation_coverage",
        )
    )


def _event_samples(spark, sf):
    return RL.feature_maps(I.m2(spark, sf)).withColumnRenamed("dataset_id", "model_id")


@register(
    "frozen_distances",
    L.query(_FROZEN_PARTS, f"SELECT method_id, sample_id, m::bigint AS cluster, {L.r6('d')} AS distance FROM dist"),
)
def frozen_distances(spark, sf):
    """Distances of rows with missing cells to frozen medoids under all five kinds of distance."""
    rows = TR.with_distances(_event_samples(spark, sf).join(_frozen(spark, sf), "model_id"))
    return rows.select("method_id", "sample_id", F.posexplode("distances").alias("cluster", "d")).select(
        "method_id", "sample_id", n("cluster").alias("cluster"), r6("d").alias("distance")
    )


_ACCEPT = [
    """two AS (SELECT method_id, sample_id, m AS forced, d AS nearest, lead(d) OVER w AS second FROM (SELECT method_id, sample_id, m, round(d, 12) AS d FROM dist)
      WINDOW w AS (PARTITION BY method_id, sample_id ORDER BY d, m) QUALIFY row_number() OVER w = 1)""",
    """jud AS (SELECT two.*, least(greatest((second - nearest) / greatest(second, 1e-15), 0.0), 1.0) AS confidence, seen / 10 AS feature_coverage,
        CASE WHEN method_id IN ('R_PAIR_PAM', 'H_EUC_PAIR_A025_PAM') THEN coalesce(relation_coverage, 0.0) END AS relation_coverage
      FROM two JOIN obs USING (sample_id) LEFT JOIN rc USING (sample_id))""",
    """rea AS (SELECT *, concat_ws(',', CASE WHEN feature_coverage < 0.8 THEN 'feature_coverage' END, CASE WHEN relation_coverage < 0.8 THEN 'relation_coverage' END,
        CASE WHEN nearest > 1.5 + 1e-12 THEN 'source_radius' END, CASE WHEN confidence + 1e-12 < 0.05 THEN 'confidence' END) AS reasons FROM jud)""",
]


@register(
    "frozen_assignment",
    L.query(
        _FROZEN_PARTS + _ACCEPT,
        f"""SELECT method_id, sample_id, forced::bigint AS forced_cluster, CASE WHEN reasons = '' THEN forced END::bigint AS accepted_cluster,
        {L.r6('nearest')} AS nearest, {L.r6('confidence')} AS confidence, {L.r6('feature_coverage')} AS feature_coverage,
        {L.r6('relation_coverage')} AS relation_coverage, reasons FROM rea""",
    ),
)
def frozen_assignment(spark, sf):
    """Forced and accepted clusters with rejection reasons."""
    assigned = TR.assign(_event_samples(spark, sf), _frozen(spark, sf))
    return _frozen_result(assigned)


def _frozen_result(assigned, *more):
    return assigned.select(
        "method_id", "sample_id", n("forced_cluster").alias("forced_cluster"), n("accepted_cluster").alias("accepted_cluster"),
        r6("nearest_distance").alias("nearest"), r6("confidence").alias("confidence"),
        r6("feature_coverage").alias("feature_coverage"), r6("relation_coverage").alias("relation_coverage"),
        F.concat_ws(",", "rejection_reasons").alias("reasons"), *more,
    )


@register(
    "common_features",
    L.query(L.matrix("m3"), "SELECT feature_id FROM m3 WHERE dataset_id = 'F' INTERSECT SELECT feature_id FROM m3 WHERE dataset_id = 'O'"),
)
def common_features(spark, sf):
    m3 = I.m3(spark, sf)
    return TR.common_features(m3.where("dataset_id = 'F'"), m3.where("dataset_id = 'O'"))


@register(
    "schema_mismatches",
    L.query(L.matrix("m3"), "SELECT 'O' AS dataset_id WHERE (SELECT count(DISTINCT feature_id) FROM m3 WHERE dataset_id = 'O') > 0"),
)
def schema_mismatches(spark, sf):
    """Targets against the schemas a model was frozen for: one dataset is expected to have another schema."""
    m3 = I.m3(spark, sf)
    expected = TR.feature_schema_hash(m3).withColumn(
        "feature_schema_sha256",
        F.when(F.col("dataset_id") == "O", F.lit("other")).otherwise(F.col("feature_schema_sha256")),
    )
    return TR.schema_mismatches(m3, expected)


# ---------------------------------------------------------------- streams


def _stream_folder(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _vector_stream(spark, sf):
    """The embeddings file as a stream of samples with a feature map."""
    schema = spark.read.parquet(f"{sf}/embeddings.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/embeddings*.parquet")
    names = F.transform("embedding", lambda v, i: F.format_string("f%03d", i))
    return stream.select(
        F.lit("embeddings").alias("model_id"),
        I.padded("vec_id").alias("sample_id"),
        F.map_from_arrays(names, F.col("embedding").cast("array<double>")).alias("features"),
    )


def _finished(spark, assigned):
    folder = _stream_folder(spark)
    STR.write_assignments(assigned, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@register("streamed_rule_assignment", L.query(_SCORES, _RULE_ASSIGN))
def streamed_rule_assignment(spark, sf):
    """The rule assignment as a stateless stream: same rows as the batch."""
    _, rules = _class_rules(spark, sf)
    models = cut(RL.rule_model(cut(rules)))
    return _rule_result(_finished(spark, STR.assign_rules(STR.clean(_vector_stream(spark, sf)), models)))


_M1_NEAR = L.matrix("m1") + L.scaled("m1", 16) + [
    "mds AS (SELECT sample_id, m FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS m FROM samples) WHERE m < 3)",
    "de AS (SELECT a.sample_id, m, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM zed a JOIN zed b USING (feature_id) JOIN mds ON mds.sample_id = b.sample_id GROUP BY ALL)",
]


@register(
    "streamed_medoid_assignment",
    L.query(
        _M1_NEAR,
        f"""SELECT sample_id, m::bigint AS forced_cluster, {L.r6('d')} AS nearest FROM (SELECT sample_id, m, round(d, 12) AS d FROM de)
        QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d, m) = 1""",
    ),
)
def streamed_medoid_assignment(spark, sf):
    points, model = _points(spark, sf, I.m1, 16)
    frozen = cut(
        _smallest_ids(points, 3).join(model.withColumnRenamed("dataset_id", "space_id"), "space_id").selectExpr(
            "space_id AS model_id", "'V_EUC_PAM' AS method_id", "feature_ids", "medians", "scales", "medoids",
            "CAST(array() AS array<int>) AS pair_left", "CAST(array() AS array<int>) AS pair_right",
            "CAST(array() AS array<double>) AS pair_weight", "0.0D AS margin",
            "CAST(NULL AS double) AS value_scale", "CAST(NULL AS double) AS relational_scale", "CAST(NULL AS double) AS alpha",
            "array(9.0D, 9.0D, 9.0D) AS radius_q95", "0.0D AS confidence_q05",
            "0.8D AS min_feature_coverage", "0.8D AS min_relation_coverage",
        )
    )
    assigned = _finished(spark, STR.assign_medoids(_vector_stream(spark, sf), frozen))
    return assigned.select("sample_id", n("forced_cluster").alias("forced_cluster"), r6("nearest_distance").alias("nearest"))


# ---------------------------------------------------------------- audits and pipelines


def _config(**changes) -> A.AuditConfig:
    options = {"k": 2, "feature_budget": 10, "relation_budget": 30, "resamples": 3, "seed": 7}
    return A.AuditConfig(**{**options, **changes})


_HALVES = L.matrix("m3") + [
    "samples AS (SELECT DISTINCT dataset_id, sample_id FROM m3)",
    f"""ord AS (SELECT dataset_id, sample_id, rep, count(*) OVER (PARTITION BY dataset_id, rep) AS c,
        row_number() OVER (PARTITION BY dataset_id, rep ORDER BY {L.u01('5', "'half'", 'rep', 'sample_id')}) AS a,
        row_number() OVER (PARTITION BY dataset_id, rep ORDER BY {L.u01('5', "'subsample'", 'rep', 'sample_id')}) AS b
      FROM samples, (VALUES (0), (1), (2)) r(rep))""",
]


@register(
    "resample_members",
    L.query(_HALVES, "SELECT dataset_id, sample_id, rep::bigint AS rep, a <= c // 2 AS train, b <= greatest(2, ceil(0.8::double * c)) AS sub FROM ord"),
)
def resample_members(spark, sf):
    """Half splits and 80 % subsamples of every dataset."""
    samples = I.m3(spark, sf).select(F.col("dataset_id").alias("space_id"), "sample_id").distinct()
    members = A.resample_members(samples, 3, 2, 5)
    return members.select(
        F.col("space_id").alias("dataset_id"), "sample_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rep"), "member"
    ).select(
        "dataset_id", "sample_id", n("rep").alias("rep"),
        F.get("member", 3 * F.col("rep") + 1).alias("train"), F.get("member", 3 * F.col("rep") + 3).alias("sub"),
    )


_METRICS = (
    "prediction_strength", "cluster_stability", "perturbation_invariance", "representation_stability",
    "nondegeneracy_score", "min_cluster_fraction", "cluster_entropy", "q_score",
)


@register("representation_audit")
def representation_audit(spark, sf):
    """All seven representations of both supplier datasets: strength, stability, invariance and Q."""
    metrics = A.audit(I.m3(spark, sf), _config()).metrics
    return metrics.select(
        "dataset_id", "method_id", "family", *[r6(c).alias(c) for c in _METRICS], "nondegenerate",
        n("complexity").alias("complexity"), n("perturbation_failures").alias("perturbation_failures"),
    )


@register("audit_with_missing_cells")
def audit_with_missing_cells(spark, sf):
    """The event matrix has holes: the footrule method fails with a reason, the others are scored."""
    result = A.audit(I.m2(spark, sf), _config(k=3, feature_budget=12, resamples=2, relation_coverage_threshold=0.3))
    scored = result.metrics.select("method_id", r6("q_score").alias("q_score"), F.lit(None).cast("string").alias("failure"))
    failed = result.failures.select("method_id", F.lit(None).cast("double").alias("q_score"), F.col("reason").alias("failure"))
    return scored.unionByName(failed)


@register("calibrated_selection")
def calibrated_selection(spark, sf):
    """Audit both datasets with three shuffled copies of each, calibrate, and select or abstain."""
    _, selection, _, _ = PL.audit_and_select(I.m3(spark, sf), _config(resamples=2), 3)
    return selection.select(
        "dataset_id", "decision", "uncertain", r6("decision_confidence").alias("decision_confidence"),
        "selected_method", n("selected_k").alias("selected_k"), r6("q_score").alias("q_score"),
    )


def _directions(spark):
    return spark.createDataFrame([("F", "O"), ("O", "F")], "model_id string, target_id string")


@register("cohort_transfer")
def cohort_transfer(spark, sf):
    """Both directions between the two line-status cohorts: fit, select, freeze, assign the other cohort.

    Every frozen method assigns; ``selected_cluster`` is what the source's decision leaves of it.
    """
    _, assigned = PL.transfer(I.m3(spark, sf), _directions(spark), _config(resamples=2), 3)
    return _frozen_result(assigned, "model_id", "decision", "selected", n("selected_cluster").alias("selected_cluster"))


@register("transfer_evaluation")
def transfer_evaluation(spark, sf):
    """Frozen transfer judged against the suppliers' regions after freezing."""
    frozen, assigned = PL.transfer(I.m3(spark, sf), _directions(spark), _config(resamples=2), 3)
    judged = PL.evaluate_transfer(frozen, assigned, I.region_labels(spark, sf), 2)
    gate = judged.select("model_id", "target_id", "decision", "selected_method", *[
        r6(c).alias(c) for c in ("selected_ari", "coverage", "oracle_ari", "regret", "min_accepted_share")
    ], "oracle_method")
    return gate


@register("shared_source_transfer")
def shared_source_transfer(spark, sf):
    """One fitted source serves two targets, itself included."""
    result = A.audit(I.m3(spark, sf).where("dataset_id = 'F'"), _config(resamples=1))
    routes = spark.createDataFrame([("F", "O"), ("F", "F")], "model_id string, target_id string")
    assigned = cut(PL.assign_targets(PL.freeze_models(result), routes, I.m3(spark, sf)))
    return assigned.groupBy("target_id", "method_id").agg(
        n(F.count(F.lit(1))).alias("n"), n(F.count("accepted_cluster")).alias("accepted"),
        r6(F.avg("confidence")).alias("mean_confidence"),
    )


@register("rule_transfer")
def rule_transfer(spark, sf):
    """Rules fitted on one cohort, executed on the other, judged by region."""
    _, assigned = PL.rule_transfer(
        I.m3(spark, sf), _directions(spark), k=2, feature_budget=12, max_rules=8, min_support=0.7
    )
    judged = PL.evaluate_rules(cut(assigned), I.region_labels(spark, sf))
    return judged.select("model_id", "target_id", *[r6(c).alias(c) for c in ("coverage", "mean_score", "mean_margin", "ari")])


@register("method_comparison")
def method_comparison(spark, sf):
    """Value, relation, post-hoc rule and direct rule clusters of both cohorts against the regions."""
    labels = cut(PL.compare_methods(I.m3(spark, sf), k=2, feature_budget=12, max_rules=8, min_support=0.7))
    scored = G.method_metrics(
        labels.withColumn("forced_cluster", F.col("cluster")).withColumn("accepted_cluster", F.col("cluster")),
        I.region_labels(spark, sf), ["dataset_id", "method_id"],
    )
    return scored.select("dataset_id", "method_id", r6("ari_forced").alias("ari"), r6("nmi_forced").alias("nmi"))
