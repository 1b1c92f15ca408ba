"""Sources, statistics, ranks, relations, perturbations and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalia.functions import expr as X
from ordinalia.functions import quantiles as Q
from ordinalia.operators import edges as E
from ordinalia.operators import perturb as P
from ordinalia.operators import ranks as K
from ordinalia.operators import robust as R
from ordinalia.operators import rules as RL
from ordinalia.operators import screen as S
from ordinalia.operators import tiles as T
from ordinalia.operators import transfer as TR
from ordinalia.operators import validate as V
from ordinalia.runtime import cut
from ordinalia.sources import matrices as SM

from . import inputs as I
from . import sql as L
from .registry import n, r6, register

# ---------------------------------------------------------------- sources


@register(
    "vectors_to_measurements",
    L.query(L.matrix("m1"), f"SELECT dataset_id, sample_id, feature_id, {L.r6('value')} AS value FROM m1"),
)
def vectors_to_measurements(spark, sf):
    return I.m1(spark, sf).select("dataset_id", "sample_id", "feature_id", r6("value").alias("value"))


@register(
    "measurements_to_vectors",
    f"""SELECT lpad(vec_id::varchar, 20, '0') AS sample_id, len(embedding)::bigint AS width,
        {L.r6('embedding[1]::double')} AS first_value, {L.r6('embedding[len(embedding)]::double')} AS last_value,
        list_sum(list_transform(embedding, lambda x, i: i * round(x::double * 1000000)::bigint))::bigint AS by_position
        FROM embeddings""",
)
def measurements_to_vectors(spark, sf):
    rows = SM.measurements_to_vectors(I.m1(spark, sf))
    return rows.select(
        "sample_id",
        n(F.size("vector")).alias("width"),
        r6(F.element_at("vector", 1)).alias("first_value"),
        r6(F.element_at("vector", -1)).alias("last_value"),
        F.aggregate(
            F.transform("vector", lambda x, i: (i + 1) * F.round(x * 1000000).cast("bigint")),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        ).alias("by_position"),
    )


@register(
    "event_matrix",
    L.query(L.matrix("m2"), f"SELECT sample_id, feature_id, {L.r6('value')} AS value FROM m2"),
)
def event_matrix(spark, sf):
    return I.m2(spark, sf).select("sample_id", "feature_id", r6("value").alias("value"))


@register(
    "supplier_matrix",
    L.query(L.matrix("m3"), f"SELECT dataset_id, sample_id, feature_id, {L.r6('value')} AS value FROM m3"),
)
def supplier_matrix(spark, sf):
    return I.m3(spark, sf).select("dataset_id", "sample_id", "feature_id", r6("value").alias("value"))


@register(
    "matrix_shapes",
    L.query(
        L.matrix("m2") + L.matrix("m3"),
        """SELECT dataset_id, count(DISTINCT sample_id)::bigint AS n_samples, count(DISTINCT feature_id)::bigint AS n_features
        FROM (SELECT * FROM m2 UNION ALL SELECT * FROM m3) GROUP BY dataset_id""",
    ),
)
def matrix_shapes(spark, sf):
    return SM.shape_of(I.m2(spark, sf).unionByName(I.m3(spark, sf))).select(
        "dataset_id", n("n_samples").alias("n_samples"), n("n_features").alias("n_features")
    )


# ---------------------------------------------------------------- robust statistics


def _stats_sql(m: str) -> str:
    return L.query(
        L.matrix(m) + L.stats(m),
        f"""SELECT dataset_id, feature_id, {L.r6('median')} AS median, {L.r6('mad')} AS mad, {L.r6('iqr')} AS iqr,
        {L.r6('scale')} AS scale, iqr_fallback, n_observed::bigint AS n_observed FROM stats""",
    )


def _stats(measurements):
    return R.feature_stats(measurements).select(
        "dataset_id",
        "feature_id",
        *[r6(c).alias(c) for c in ("median", "mad", "iqr", "scale")],
        "iqr_fallback",
        n("n_observed").alias("n_observed"),
    )


@register("feature_stats_vectors", _stats_sql("m1"))
def feature_stats_vectors(spark, sf):
    return _stats(I.m1(spark, sf))


@register("feature_stats_missing", _stats_sql("m2"))
def feature_stats_missing(spark, sf):
    return _stats(I.m2(spark, sf))


@register("feature_stats_datasets", _stats_sql("m3"))
def feature_stats_datasets(spark, sf):
    return _stats(I.m3(spark, sf))


@register(
    "top_features",
    L.query(
        L.matrix("m1") + L.selected("m1", 20),
        f"SELECT dataset_id, feature_rank::bigint AS feature_rank, feature_id, {L.r6('mad')} AS mad FROM sel",
    ),
)
def top_features(spark, sf):
    chosen = R.top_features(R.feature_stats(I.m1(spark, sf)), 20)
    return chosen.select("dataset_id", n("feature_rank").alias("feature_rank"), "feature_id", r6("mad").alias("mad"))


@register(
    "observed_scale",
    L.query(
        L.matrix("m2"),
        f"""SELECT feature_id, {L.r6('''CASE WHEN count(value) >= 2 AND quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 0
        THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1.0 END''')} AS scale FROM m2 GROUP BY feature_id""",
    ),
)
def observed_scale(spark, sf):
    return R.observed_scale(I.m2(spark, sf)).select("feature_id", r6("scale").alias("scale"))


@register(
    "allowed_features",
    L.query(
        L.matrix("m3")
        + ["common AS (SELECT feature_id FROM m3 WHERE dataset_id = 'F' INTERSECT SELECT feature_id FROM m3 WHERE dataset_id = 'O')"],
        """SELECT dataset_id, feature_id, count(*)::bigint AS n_cells FROM m3
        WHERE feature_id IN (SELECT feature_id FROM common) AND feature_id NOT LIKE '%tax' GROUP BY ALL""",
    ),
)
def allowed_features(spark, sf):
    m3 = I.m3(spark, sf)
    common = TR.common_features(m3.where("dataset_id = 'F'"), m3.where("dataset_id = 'O'"))
    allowed = common.where(~F.col("feature_id").endswith("tax")).select(
        F.explode(F.array(F.lit("F"), F.lit("O"))).alias("dataset_id"), "feature_id"
    )
    kept = R.restrict_features(m3, allowed)
    return kept.groupBy("dataset_id", "feature_id").agg(n(F.count(F.lit(1))).alias("n_cells"))


@register(
    "unknown_features",
    L.query(
        L.matrix("m2") + L.matrix("m3"),
        """SELECT 'F' AS dataset_id, feature_id FROM (SELECT DISTINCT feature_id FROM m2
        EXCEPT SELECT feature_id FROM m3 WHERE dataset_id = 'F')""",
    ),
)
def unknown_features(spark, sf):
    asked = I.m2(spark, sf).select(F.lit("F").alias("dataset_id"), "feature_id")
    return R.unknown_features(I.m3(spark, sf), asked)


# ---------------------------------------------------------------- scaling and imputation


@register(
    "scaled_values",
    L.query(
        L.matrix("m2") + L.scaled("m2", 12),
        f"SELECT sample_id, feature_rank::bigint AS feature_rank, {L.r6('z')} AS z FROM zed",
    ),
)
def scaled_values(spark, sf):
    m2 = I.m2(spark, sf)
    model = cut(R.feature_model(R.top_features(R.feature_stats(m2), 12)))
    return R.scaled_rows(m2, model).select("sample_id", F.posexplode("z").alias("p", "z")).select(
        "sample_id", n(F.col("p") + 1).alias("feature_rank"), r6("z").alias("z")
    )


@register(
    "aligned_target",
    L.query(
        L.matrix("m2") + L.selected("m2", 12)
        + ["frozen AS (SELECT feature_rank, feature_id FROM sel UNION ALL SELECT 13, 'absent_feature')"],
        f"""SELECT s.sample_id, f.feature_rank::bigint AS feature_rank, f.feature_id, {L.r6('m2.value')} AS value
        FROM samples s CROSS JOIN frozen f LEFT JOIN m2 ON m2.sample_id = s.sample_id AND m2.feature_id = f.feature_id""",
    ),
)
def aligned_target(spark, sf):
    m2 = I.m2(spark, sf)
    selected = R.top_features(R.feature_stats(m2), 12)
    frozen = cut(R.feature_model(selected)).withColumn(
        "feature_ids", F.concat("feature_ids", F.array(F.lit("absent_feature")))
    )
    rows = R.aligned_rows(m2, frozen)
    cells = F.arrays_zip(F.col("feature_ids"), F.col("x"))
    return rows.select("sample_id", F.posexplode(cells).alias("p", "c")).select(
        "sample_id",
        n(F.col("p") + 1).alias("feature_rank"),
        F.col("c.feature_ids").alias("feature_id"),
        r6("c.x").alias("value"),
    )


@register(
    "absent_features",
    L.query(
        L.matrix("m2") + L.selected("m2", 12) + ["frozen AS (SELECT feature_id FROM sel UNION ALL SELECT 'absent_feature')"],
        "SELECT 'events' AS dataset_id, feature_id FROM frozen WHERE feature_id NOT IN (SELECT feature_id FROM m2)",
    ),
)
def absent_features(spark, sf):
    m2 = I.m2(spark, sf)
    model = R.feature_model(R.top_features(R.feature_stats(m2), 12)).withColumn(
        "feature_ids", F.concat("feature_ids", F.array(F.lit("absent_feature")))
    )
    return R.absent_features(m2, model)


@register(
    "robust_z",
    L.query(
        L.matrix("m3") + L.stats("m3")
        + ["""mads AS (SELECT dataset_id, feature_id, quantile_cont(abs(coalesce(value, median) - median), 0.5) AS mad FROM grid GROUP BY ALL)"""],
        f"""SELECT dataset_id, sample_id, feature_id,
        {L.r6('(coalesce(value, median) - median) / CASE WHEN mad > 1e-12 THEN mad ELSE 1.0 END')} AS z
        FROM grid JOIN mads USING (dataset_id, feature_id) WHERE value IS NOT NULL""",
    ),
)
def robust_z(spark, sf):
    return R.robust_z(I.m3(spark, sf)).select("dataset_id", "sample_id", "feature_id", r6("z").alias("z"))


@register(
    "median_imputed",
    L.query(
        L.matrix("m2") + L.stats("m2")
        + [
            "mads AS (SELECT dataset_id, feature_id, quantile_cont(abs(coalesce(value, median) - median), 0.5) AS mad FROM grid GROUP BY ALL)",
            "top AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY mad DESC, feature_id) AS feature_rank FROM mads)",
        ],
        f"""SELECT sample_id, feature_rank::bigint AS feature_rank, {L.r6('coalesce(value, median, 0)')} AS value
        FROM grid JOIN top USING (dataset_id, feature_id) WHERE feature_rank <= 15""",
    ),
)
def median_imputed(spark, sf):
    m2 = I.m2(spark, sf)
    rows = RL.fit_rows(m2, RL.select_features(m2, 15))
    return rows.select("sample_id", F.posexplode("x").alias("p", "value")).select(
        "sample_id", n(F.col("p") + 1).alias("feature_rank"), r6("value").alias("value")
    )


# ---------------------------------------------------------------- ranks and relations


@register(
    "average_ranks",
    L.query(
        L.matrix("m2") + L.scaled("m2", 12) + L.ranked(),
        f"SELECT sample_id, feature_id, {L.r6('q')} AS q FROM ranks",
    ),
)
def average_ranks(spark, sf):
    m2 = I.m2(spark, sf)
    chosen = R.top_features(R.feature_stats(m2), 12)
    return K.rank_encode(R.restrict_features(m2, chosen)).select("sample_id", "feature_id", r6("q").alias("q"))


@register(
    "profile_rows",
    L.query(
        L.matrix("m2") + L.scaled("m2", 12) + L.ranked(),
        f"""SELECT z.sample_id, z.feature_rank::bigint AS feature_rank, {L.r6('z.raw')} AS x, {L.r6('r.q')} AS q
        FROM zed z LEFT JOIN ranks r USING (dataset_id, sample_id, feature_id)""",
    ),
)
def profile_rows(spark, sf):
    m2 = I.m2(spark, sf)
    model = cut(R.feature_model(R.top_features(R.feature_stats(m2), 12)))
    rows = K.profile_rows(m2, model)
    return rows.select("sample_id", F.posexplode(F.arrays_zip("x", "q")).alias("p", "c")).select(
        "sample_id", n(F.col("p") + 1).alias("feature_rank"), r6("c.x").alias("x"), r6("c.q").alias("q")
    )


@register(
    "ternary_relations",
    L.query(
        L.matrix("m2") + L.scaled("m2", 8) + L.ranked() + L.pairs() + L.states(margin=0.1),
        """SELECT s.sample_id, p."left", p."right", t.state::bigint AS state FROM samples s JOIN pairs p USING (dataset_id)
        LEFT JOIN states t ON t.sample_id = s.sample_id AND t."left" = p."left" AND t."right" = p."right" """,
    ),
)
def ternary_relations(spark, sf):
    m2 = I.m2(spark, sf)
    chosen = cut(R.top_features(R.feature_stats(m2), 8))
    ranks = K.rank_encode(R.restrict_features(m2, chosen))
    states = K.relation_states(ranks, K.candidate_pairs(chosen), margin=0.1)
    return states.select("sample_id", "left", "right", n("state").alias("state"))


@register(
    "binary_relations",
    L.query(
        L.matrix("m3") + L.selected("m3", 8) + L.pairs(),
        """SELECT a.dataset_id, a.sample_id, p."left", p."right", (a.value > b.value)::bigint AS bit
        FROM pairs p JOIN m3 a ON a.dataset_id = p.dataset_id AND a.feature_id = p."left"
        JOIN m3 b ON b.dataset_id = p.dataset_id AND b.feature_id = p."right" AND b.sample_id = a.sample_id""",
    ),
)
def binary_relations(spark, sf):
    m3 = I.m3(spark, sf)
    chosen = cut(R.top_features(R.feature_stats(m3), 8))
    bits = K.binary_relations(R.restrict_features(m3, chosen), K.candidate_pairs(chosen))
    return bits.select("dataset_id", "sample_id", "left", "right", n("bit").alias("bit"))


@register(
    "candidate_pairs",
    L.query(
        L.matrix("m3") + L.selected("m3", 10) + L.pairs(),
        """SELECT dataset_id, "left", "right", (row_number() OVER (PARTITION BY dataset_id ORDER BY "left", "right") - 1)::bigint AS pair_no
        FROM pairs""",
    ),
)
def candidate_pairs(spark, sf):
    chosen = R.top_features(R.feature_stats(I.m3(spark, sf)), 10)
    return K.candidate_pairs(chosen).select("dataset_id", "left", "right", n("pair_no").alias("pair_no"))


@register(
    "ranked_pairs",
    L.query(
        L.matrix("m1") + L.selected("m1", 20),
        """SELECT * FROM (SELECT a.feature_id AS "left", b.feature_id AS "right",
          (row_number() OVER (ORDER BY a.feature_rank, b.feature_rank) - 1)::bigint AS pair_no
          FROM sel a JOIN sel b ON a.feature_rank < b.feature_rank) WHERE pair_no < 150""",
    ),
)
def ranked_pairs(spark, sf):
    chosen = R.top_features(R.feature_stats(I.m1(spark, sf)), 20)
    return K.ranked_pairs(chosen, 150).select("left", "right", n("pair_no").alias("pair_no"))


@register(
    "invalid_pairs",
    """WITH flows AS (SELECT 'trade' AS dataset_id, s_nationkey::varchar AS "left", c_nationkey::varchar AS "right"
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
       SELECT DISTINCT "left", "right", 'self pair' AS reason FROM flows WHERE "left" = "right"
       UNION ALL SELECT "left", "right", 'duplicate pair' FROM flows GROUP BY ALL HAVING count(*) > 1""",
)
def invalid_pairs(spark, sf):
    flows = (
        I.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
        .join(I.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(I.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(I.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.lit("trade").alias("dataset_id"),
            F.col("s_nationkey").cast("string").alias("left"),
            F.col("c_nationkey").cast("string").alias("right"),
        )
    )
    return K.invalid_pairs(flows).select("left", "right", "reason").distinct()


# ---------------------------------------------------------------- method names


@register(
    "method_families",
    """SELECT format('H_EUC_PAIR_A{:03d}_PAM', round(l_discount * 100)::int) AS method_id, 'HYBRID' AS family,
       round(l_discount * 100)::int / 100.0 + 0.0::double AS alpha, count(*)::bigint AS n FROM lineitem GROUP BY ALL
       UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'R_PAIR_PAM' ELSE 'V_EUC_PAM' END,
       CASE WHEN l_returnflag = 'R' THEN 'RELATIONAL' ELSE 'VALUE' END, NULL, count(*) FROM lineitem GROUP BY ALL""",
)
def method_families(spark, sf):
    lines = I.table(spark, sf, "lineitem")
    hybrid = lines.select(X.hybrid_method_of(F.col("l_discount")).alias("method_id"))
    pure = lines.select(F.when(F.col("l_returnflag") == "R", "R_PAIR_PAM").otherwise("V_EUC_PAM").alias("method_id"))
    counted = hybrid.unionByName(pure).groupBy("method_id").agg(n(F.count(F.lit(1))).alias("n"))
    return counted.select(
        "method_id", X.family_of(F.col("method_id")).alias("family"), X.alpha_of(F.col("method_id")).alias("alpha"), "n"
    )


# ---------------------------------------------------------------- perturbations

SEED = 17


def _perturbation(kind: str):
    specs = [(rep, kind, P.STRENGTH[kind][rep]) for rep in range(3)]
    sql = L.query(
        L.matrix("m2") + L.perturbed("m2", specs, SEED),
        f"SELECT rep::bigint AS rep, sample_id, feature_id, {L.r6('value')} AS value FROM moved",
    )

    @register(f"perturb_{kind}", sql)
    def run(spark, sf):
        return P.perturb(I.m2(spark, sf), specs, SEED).select(
            n("rep").alias("rep"), "sample_id", "feature_id", r6("value").alias("value")
        )


for _kind in P.KINDS:
    _perturbation(_kind)

_SUITE = P.suite(7, "strong")


@register(
    "perturbation_suite",
    L.query(
        L.matrix("m3") + L.perturbed("m3", _SUITE, SEED),
        f"""SELECT dataset_id, rep::bigint AS rep, kind, feature_id, count(*)::bigint AS cells, count(value)::bigint AS observed,
        {L.r6('quantile_cont(value, 0.5)')} AS median FROM moved GROUP BY ALL""",
    ),
)
def perturbation_suite(spark, sf):
    moved = cut(P.perturb(I.m3(spark, sf), _SUITE, SEED))
    keys = ["dataset_id", "rep", "kind", "feature_id"]
    middle = Q.quantiles(moved, keys, "value", [0.5]).select(*keys, r6(F.col("q")[0]).alias("median"))
    counts = moved.groupBy(*keys).agg(
        n(F.count(F.lit(1))).alias("cells"), n(F.count("value")).alias("observed")
    )
    return counts.join(middle, keys, "left").withColumn("rep", n("rep"))


def _null_sql() -> str:
    primes = "[" + ", ".join(f"{p}::bigint" for p in P.PRIMES) + "]"
    s = str(SEED)
    p1 = f"{primes}[(floor({L.u01(s, chr(39) + 'p1' + chr(39), 'rep', 'feature_id')} * {len(P.PRIMES)}))::int + 1] % n"
    p2 = f"{primes}[(floor({L.u01(s, chr(39) + 'p2' + chr(39), 'rep', 'feature_id')} * {len(P.PRIMES)}))::int + 1] % n"
    b = f"floor({L.u01(s, chr(39) + 'b' + chr(39), 'rep', 'feature_id')} * n)::bigint"
    return L.query(
        L.matrix("m3")
        + [
            "samples AS (SELECT DISTINCT dataset_id, sample_id FROM m3)",
            f"""ord AS (SELECT dataset_id, sample_id, row_number() OVER (PARTITION BY dataset_id
                ORDER BY {L.u01(s, chr(39) + 'null' + chr(39), 'sample_id')}) - 1 AS pos,
                count(*) OVER (PARTITION BY dataset_id) AS n FROM samples)""",
            f"""placed AS (SELECT m3.dataset_id, rep, feature_id, value,
                ((({p1}) * ({p2})) % n * pos + {b}) % n AS pos
                FROM m3 JOIN ord USING (dataset_id, sample_id), (VALUES (0), (1)) r(rep))""",
        ],
        f"""SELECT format('{{}}#null{{:03d}}', p.dataset_id, rep) AS dataset_id, ord.sample_id, feature_id, {L.r6('value')} AS value
        FROM placed p JOIN ord ON ord.dataset_id = p.dataset_id AND ord.pos = p.pos""",
    )


@register("shuffled_null", _null_sql())
def shuffled_null(spark, sf):
    return P.shuffle_null(I.m3(spark, sf), 2, SEED).select(
        "dataset_id", "sample_id", "feature_id", r6("value").alias("value")
    )


# ---------------------------------------------------------------- relation screen


def _screen_sql(reps: int) -> list[str]:
    parts = (
        L.matrix("m2") + L.scaled("m2", 8) + L.ranked() + L.pairs() + L.states()
        + ["""counts AS (SELECT dataset_id, "left", "right", count(*) AS seen, count(*) FILTER (state = -1) AS t0,
            count(*) FILTER (state = 0) AS t1, count(*) FILTER (state = 1) AS t2 FROM states GROUP BY ALL)"""]
    )
    if reps:
        parts += ["used AS (SELECT m2.* FROM m2 JOIN sel USING (dataset_id, feature_id))"]
        parts += L.perturbed("used", P.suite(reps, "small"), SEED)
        parts += L.ranked("moved", "value", "mranks", ", rep") + L.states("mranks", "mstates", "rep")
        parts += [
            """agree AS (SELECT dataset_id, "left", "right", rep, avg((a.state = b.state)::int) AS share
              FROM states a JOIN mstates b USING (dataset_id, sample_id, "left", "right") GROUP BY ALL)""",
            f"""stab AS (SELECT dataset_id, "left", "right", sum(share) / {reps}.0 AS stability FROM agree GROUP BY ALL)""",
        ]
    term = "CASE WHEN {0} > 0 THEN -({0} / seen) * ln({0} / seen) ELSE 0.0 END"
    entropy = "(" + " + ".join(term.format(f"t{i}") for i in range(3)) + ") / ln(3.0)"
    join = 'JOIN stab USING (dataset_id, "left", "right")' if reps else ""
    stability = "stability" if reps else "1.0"
    parts += [
        f"""scored AS (SELECT dataset_id, "left", "right",
            seen / (SELECT count(*) FROM samples) AS coverage, {entropy} AS entropy, {stability} AS stability,
            ((t0 > 0)::int + (t1 > 0)::int + (t2 > 0)::int) >= 2 AS varies FROM counts {join})"""
    ]
    return parts


@register(
    "relation_coverage_entropy",
    L.query(
        _screen_sql(0),
        f"""SELECT "left", "right", {L.r6('coverage')} AS coverage, {L.r6('entropy')} AS entropy, varies FROM scored""",
    ),
)
def relation_coverage_entropy(spark, sf):
    m2 = I.m2(spark, sf)
    model = cut(R.feature_model(R.top_features(R.feature_stats(m2), 8)))
    scored = S.score_pairs(m2, model, perturbations=0)
    return scored.select("left", "right", r6("coverage").alias("coverage"), r6("entropy").alias("entropy"), "varies")


@register(
    "relation_stability",
    L.query(_screen_sql(3), f"""SELECT "left", "right", {L.r6('stability')} AS stability FROM scored"""),
)
def relation_stability(spark, sf):
    m2 = I.m2(spark, sf)
    model = cut(R.feature_model(R.top_features(R.feature_stats(m2), 8)))
    scored = S.score_pairs(m2, model, perturbations=3, seed=SEED)
    return scored.select("left", "right", r6("stability").alias("stability"))


@register(
    "relation_screen",
    L.query(
        _screen_sql(3)
        + [
            """kept AS (SELECT *, coverage * entropy * stability AS score,
                row_number() OVER (ORDER BY round(coverage * entropy * stability, 10) DESC, "left" || '>' || "right") AS relation_rank
              FROM scored WHERE coverage > 0.5 AND entropy >= 0.05 AND stability >= 0.8 AND varies)"""
        ],
        f"""SELECT relation_rank::bigint AS relation_rank, "left", "right", {L.r6('score')} AS score,
        {L.r6('score / avg(score) OVER ()')} AS weight FROM kept WHERE relation_rank <= 15""",
    ).replace("FROM kept WHERE relation_rank <= 15", "FROM (SELECT * FROM kept WHERE relation_rank <= 15)"),
)
def relation_screen(spark, sf):
    m2 = I.m2(spark, sf)
    model = cut(R.feature_model(R.top_features(R.feature_stats(m2), 8)))
    scored = S.score_pairs(m2, model, perturbations=3, seed=SEED, coverage_threshold=0.5)
    return S.retain(scored, 15).select(
        n("relation_rank").alias("relation_rank"), "left", "right", r6("score").alias("score"), r6("weight").alias("weight")
    )


# ---------------------------------------------------------------- distances


def _points(spark, sf, m, budget=None):
    """Profiles over the ``budget`` most spread features, or over all."""
    measurements = m(spark, sf)
    model = cut(R.feature_model(R.top_features(R.feature_stats(measurements), budget)))
    rows = K.profile_rows(measurements, model)
    z = R.standardise(F.col("x"), F.col("medians"), F.col("scales"))
    return cut(rows.select(F.col("dataset_id").alias("space_id"), "sample_id", z.alias("z"), "q")), model


def _all_pair_params(points, weighted: bool):
    """All position pairs of the model; weights 1, 2, ... in pair order or all 1."""
    widths = points.groupBy("space_id").agg(F.max(F.size("q")).alias("_p"))
    listed = widths.withColumn(
        "_l",
        F.expr(
            "flatten(transform(sequence(0, _p - 2), i -> transform(sequence(i + 1, _p - 1), j -> struct(i AS l, j AS r))))"
        ),
    )
    weight = "i + 1.0D" if weighted else "1.0D"
    return cut(
        listed.selectExpr(
            "space_id",
            "CAST(_l.l AS array<int>) AS pair_left",
            "CAST(_l.r AS array<int>) AS pair_right",
            f"transform(_l, (p, i) -> {weight}) AS pair_weight",
            "0.0D AS margin",
            "1.5D AS value_scale",
            "0.4D AS relational_scale",
        )
    )


def _ranked_pair_parts(m: str, budget: int) -> list[str]:
    """``w``: position pairs in feature-rank order with weights 1, 2, ..."""
    return (
        L.matrix(m) + L.scaled(m, budget) + L.ranked()
        + [
            """w AS (SELECT a.dataset_id, a.feature_id AS "left", b.feature_id AS "right",
                row_number() OVER (PARTITION BY a.dataset_id ORDER BY a.feature_rank, b.feature_rank)::double AS weight
              FROM sel a JOIN sel b ON a.dataset_id = b.dataset_id AND a.feature_rank < b.feature_rank)""",
            """st AS (SELECT a.dataset_id, a.sample_id, w."left", w."right", weight,
                sign(a.q - b.q)::int AS state, (a.q > b.q)::int AS bit
              FROM w JOIN ranks a ON a.dataset_id = w.dataset_id AND a.feature_id = w."left"
              JOIN ranks b ON b.dataset_id = w.dataset_id AND b.feature_id = w."right" AND b.sample_id = a.sample_id)""",
        ]
    )


_PAIR = {
    "V_EUC_PAM": """SELECT a.dataset_id, a.sample_id AS i, b.sample_id AS j, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d
        FROM zed a JOIN zed b USING (dataset_id, feature_id) GROUP BY ALL""",
    "V_COR_PAM": """SELECT a.dataset_id, a.sample_id AS i, b.sample_id AS j, 1.0 - least(greatest(sum(a.u * b.u), -1.0), 1.0) AS d
        FROM unit a JOIN unit b USING (dataset_id, feature_id) GROUP BY ALL""",
    "R_FOOT_PAM": """SELECT a.dataset_id, a.sample_id AS i, b.sample_id AS j,
        least(sum(abs(a.q - b.q)) * (max(p) - 1) / (max(p) * max(p) // 2), 1.0) AS d
        FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id, sample_id) AS p FROM ranks) a JOIN ranks b USING (dataset_id, feature_id)
        GROUP BY ALL""",
    "R_PAIR_PAM": """SELECT a.dataset_id, a.sample_id AS i, b.sample_id AS j,
        sum(CASE WHEN a.state <> b.state THEN a.weight ELSE 0 END) / sum(a.weight) AS d
        FROM st a JOIN st b USING (dataset_id, "left", "right") GROUP BY ALL""",
    "BINARY": """SELECT a.dataset_id, a.sample_id AS i, b.sample_id AS j, avg((a.bit <> b.bit)::int) AS d
        FROM st a JOIN st b USING (dataset_id, "left", "right") GROUP BY ALL""",
}
_UNIT = [
    "cen AS (SELECT dataset_id, sample_id, feature_id, z - avg(z) OVER (PARTITION BY dataset_id, sample_id) AS c FROM zed)",
    "unit AS (SELECT dataset_id, sample_id, feature_id, c / sqrt(sum(c * c) OVER (PARTITION BY dataset_id, sample_id)) AS u FROM cen)",
]
_SUM = f"SELECT dataset_id, i AS sample_id, {L.r6('sum(d)')} AS total_distance FROM d GROUP BY ALL"


def _sums(points, params, method):
    sums = T.distance_sums(points, params, [method])
    return sums.select(F.col("space_id").alias("dataset_id"), "sample_id", r6("total_distance").alias("total_distance"))


def _bare(points):
    return points.select("space_id").distinct().select("space_id", *T.no_relations())


@register(
    "euclidean_sums",
    L.query(L.matrix("m1") + L.scaled("m1", None) + [f"d AS ({_PAIR['V_EUC_PAM']})"], _SUM),
)
def euclidean_sums(spark, sf):
    """Sum of Euclidean distances from every sample to all samples, i.e. the first k-medoids cost table."""
    points, _ = _points(spark, sf, I.m1)
    return _sums(points, _bare(points), "V_EUC_PAM")


@register(
    "correlation_sums",
    L.query(L.matrix("m1") + L.scaled("m1", None) + _UNIT + [f"d AS ({_PAIR['V_COR_PAM']})"], _SUM),
)
def correlation_sums(spark, sf):
    """Sum of correlation distances from every sample to all samples, over all features."""
    points, _ = _points(spark, sf, I.m1)
    return _sums(points, _bare(points), "V_COR_PAM")


@register(
    "footrule_sums",
    L.query(L.matrix("m3") + L.scaled("m3", 10) + L.ranked() + [f"d AS ({_PAIR['R_FOOT_PAM']})"], _SUM),
)
def footrule_sums(spark, sf):
    points, _ = _points(spark, sf, I.m3, 10)
    return _sums(points, _bare(points), "R_FOOT_PAM")


@register(
    "weighted_hamming_sums",
    L.query(_ranked_pair_parts("m2", 8) + [f"d AS ({_PAIR['R_PAIR_PAM']})"], _SUM),
)
def weighted_hamming_sums(spark, sf):
    points, _ = _points(spark, sf, I.m2, 8)
    return _sums(points, _all_pair_params(points, True), "R_PAIR_PAM")


@register(
    "binary_hamming_sums",
    L.query(_ranked_pair_parts("m3", 10) + [f"d AS ({_PAIR['BINARY']})"], _SUM),
)
def binary_hamming_sums(spark, sf):
    points, _ = _points(spark, sf, I.m3, 10)
    params = _all_pair_params(points, False).withColumn("margin", F.lit(-1.0))
    return _sums(points, params, "R_PAIR_PAM")


@register(
    "hybrid_sums",
    L.query(
        _ranked_pair_parts("m3", 10)
        + [
            f"dv AS ({_PAIR['V_EUC_PAM']})",
            f"dr AS ({_PAIR['R_PAIR_PAM']})",
            "d AS (SELECT dataset_id, i, j, 0.75 * dv.d / 1.5 + 0.25 * dr.d / 0.4 AS d FROM dv JOIN dr USING (dataset_id, i, j))",
        ],
        _SUM,
    ),
)
def hybrid_sums(spark, sf):
    points, _ = _points(spark, sf, I.m3, 10)
    return _sums(points, _all_pair_params(points, True), "H_EUC_PAIR_A025_PAM")


@register(
    "undefined_distances",
    L.query(
        L.matrix("m2") + L.scaled("m2", 20) + L.ranked()
        + ["full_rows AS (SELECT dataset_id, sample_id FROM ranks GROUP BY ALL HAVING count(*) = 20)"],
        """SELECT 'events' AS dataset_id, 'R_FOOT_PAM' AS method_id, 'undefined distance' AS reason
        WHERE (SELECT count(*) FROM full_rows) < (SELECT count(*) FROM samples)""",
    ),
)
def undefined_distances(spark, sf):
    """Methods that fail on a dataset are rows with a reason: the footrule needs complete rows."""
    points, _ = _points(spark, sf, I.m2, 20)
    sums = T.distance_sums(points, _bare(points), ["V_EUC_PAM", "R_FOOT_PAM"])
    return T.method_failures(sums).select(F.col("space_id").alias("dataset_id"), "method_id", "reason")


@register(
    "pair_distance_scales",
    L.query(
        _ranked_pair_parts("m3", 10)
        + [f"dv AS ({_PAIR['V_EUC_PAM']})", f"dr AS ({_PAIR['R_PAIR_PAM']})"],
        f"""SELECT dataset_id, 'V_EUC_PAM' AS method_id, {L.r6('quantile_cont(round(d, 12), 0.5)')} AS scale FROM dv WHERE i < j AND round(d, 12) > 0 GROUP BY ALL
        UNION ALL SELECT dataset_id, 'R_PAIR_PAM', {L.r6('quantile_cont(round(d, 12), 0.5)')} FROM dr WHERE i < j AND round(d, 12) > 0 GROUP BY ALL""",
    ),
)
def pair_distance_scales(spark, sf):
    points, _ = _points(spark, sf, I.m3, 10)
    scales = T.positive_median(points, _all_pair_params(points, True), ["V_EUC_PAM", "R_PAIR_PAM"])
    return scales.select(F.col("space_id").alias("dataset_id"), "method_id", r6("scale").alias("scale"))


# ---------------------------------------------------------------- distance tables


@register(
    "symmetrised_distances",
    L.query(L.trade_edges("price", "e"), f"SELECT i, j, {L.r6('d')} AS d FROM e"),
)
def symmetrised_distances(spark, sf):
    return I.trade_distances(spark, sf, "l_extendedprice").select("i", "j", r6("d").alias("d"))


@register(
    "distance_violations",
    L.query(
        [L.TRADE],
        """SELECT violation, count(*)::bigint AS n FROM (
          SELECT 'nonzero diagonal' AS violation FROM trade WHERE i = j AND abs(price) > 1e-12
          UNION ALL SELECT 'asymmetric' FROM trade a LEFT JOIN trade b ON a.i = b.j AND a.j = b.i
            WHERE b.price IS NULL OR abs(a.price - b.price) > 1e-12
          UNION ALL SELECT 'negative' FROM trade WHERE price < -1e-12) GROUP BY violation""",
    ),
)
def distance_violations(spark, sf):
    found = V.distance_violations(I.trade(spark, sf, "l_extendedprice"))
    return found.groupBy("violation").agg(n(F.count(F.lit(1))).alias("n"))


@register(
    "normalised_distances",
    L.query(
        L.trade_edges("price", "e"),
        f"SELECT i, j, {L.r6('d / (SELECT quantile_cont(d, 0.5) FROM e WHERE d > 0)')} AS d FROM e",
    ),
)
def normalised_distances(spark, sf):
    return I.scaled_edges(I.trade_distances(spark, sf, "l_extendedprice")).select("i", "j", r6("d").alias("d"))


@register(
    "hybrid_distances",
    L.query(
        L.trade_edges("price", "ev") + L.trade_edges("quantity", "er"),
        f"""SELECT format('H_EUC_PAIR_A{{:03d}}_PAM', (alpha * 100)::int) AS method_id, i, j,
        {L.r6('''(1 - alpha) * ev.d / (SELECT quantile_cont(d, 0.5) FROM ev WHERE d > 0)
          + alpha * er.d / (SELECT quantile_cont(d, 0.5) FROM er WHERE d > 0)''')} AS d
        FROM ev JOIN er USING (i, j), (VALUES (0.25::double), (0.5), (0.75)) t(alpha)""",
    ),
)
def hybrid_distances(spark, sf):
    mixed = E.hybrid(
        I.trade_distances(spark, sf, "l_extendedprice"), I.trade_distances(spark, sf, "l_quantity"), (0.25, 0.5, 0.75)
    )
    return mixed.select("method_id", "i", "j", r6("d").alias("d"))


@register(
    "distance_order_stability",
    L.query(
        L.trade_edges("price", "ev") + L.trade_edges("quantity", "er")
        + [
            """rk AS (SELECT rank() OVER (ORDER BY ev.d) + (count(*) OVER (PARTITION BY ev.d) - 1) / 2.0 AS a,
              rank() OVER (ORDER BY er.d) + (count(*) OVER (PARTITION BY er.d) - 1) / 2.0 AS b FROM ev JOIN er USING (i, j))"""
        ],
        f"SELECT {L.r6('greatest(0.0, least(1.0, corr(a, b)))')} AS order_stability FROM rk",
    ),
)
def distance_order_stability(spark, sf):
    score = E.order_stability(
        I.trade_distances(spark, sf, "l_extendedprice"), I.trade_distances(spark, sf, "l_quantity")
    )
    return score.select(r6("order_stability").alias("order_stability"))
