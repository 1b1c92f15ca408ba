"""Agreement metrics, calibration and selection, gate reports and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalia.functions import expr as X
from ordinalia.functions import quantiles as Q
from ordinalia.operators import metrics as M
from ordinalia.operators import ranks as K
from ordinalia.operators import robust as R
from ordinalia.operators import select as S
from ordinalia.operators import validate as V
from ordinalia.plans import gates as G
from ordinalia.runtime import cut
from ordinalia.sources import labels as SL
from ordinalia.sources import tables as ST

from . import inputs as I
from . import sql as L
from .registry import n, r6, register

# ---------------------------------------------------------------- quantiles and rank correlation


@register(
    "upper_quantile",
    f"""WITH s AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS pos,
          count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem)
        SELECT l_returnflag, {L.r6('x')} AS upper, c::bigint AS n FROM s WHERE pos = ceil(0.9::double * (c - 1))""",
)
def upper_quantile(spark, sf):
    top = Q.upper_quantile(I.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9, "upper")
    return top.select("l_returnflag", r6("upper").alias("upper"), n("n").alias("n"))


@register(
    "large_group_quantiles",
    f"""SELECT l_returnflag, {L.r6('quantile_cont(l_extendedprice, 0.05)')} AS q05, {L.r6('quantile_cont(l_extendedprice, 0.5)')} AS q50,
        {L.r6('quantile_cont(l_extendedprice, 0.95)')} AS q95, count(*)::bigint AS n FROM lineitem GROUP BY l_returnflag""",
)
def large_group_quantiles(spark, sf):
    """Exact quantiles on the path for groups too large for one buffer."""
    found = Q.quantiles(
        I.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95], small_group=0
    )
    return found.select(
        "l_returnflag", *[r6(F.col("q")[i]).alias(f"q{p}") for i, p in enumerate(("05", "50", "95"))], n("n").alias("n")
    )


@register(
    "spearman",
    f"""WITH r AS (SELECT l_returnflag,
          rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
          rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b
          FROM lineitem)
        SELECT l_returnflag, {L.r6('corr(a, b)')} AS rho FROM r GROUP BY l_returnflag""",
)
def spearman(spark, sf):
    rho = Q.spearman(I.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", "rho")
    return rho.select("l_returnflag", r6("rho").alias("rho"))


@register(
    "large_group_ranks",
    """SELECT l_returnflag, l_extendedprice AS price,
         max(r)::double AS average_rank, count(*)::bigint AS n
       FROM (SELECT l_returnflag, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
         + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS r FROM lineitem) GROUP BY ALL""",
)
def large_group_ranks(spark, sf):
    """Average ranks on the path for groups too large for one window."""
    ranked = Q.average_rank(
        I.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"),
        ["l_returnflag"], "l_extendedprice", "r", small_group=0,
    )
    return ranked.groupBy("l_returnflag", F.col("l_extendedprice").alias("price")).agg(
        F.max("r").cast("double").alias("average_rank"), n(F.count(F.lit(1))).alias("n")
    )


# ---------------------------------------------------------------- agreement

_TABLE = "t AS (SELECT lang AS truth, source AS predicted, count(*) AS n FROM documents GROUP BY ALL)"


def _documents(spark, sf):
    return M.contingency(I.table(spark, sf, "documents"), [], "lang", "source")


@register("contingency", L.query([_TABLE], "SELECT truth, predicted, n::bigint AS n FROM t"))
def contingency(spark, sf):
    return _documents(spark, sf).select("truth", "predicted", n("n").alias("n"))


@register(
    "adjusted_rand",
    L.query([_TABLE] + L.rand_index("t", ""), f"SELECT {L.r6('ari')} AS ari, n_samples::bigint AS n_samples FROM ari_t"),
)
def adjusted_rand(spark, sf):
    return M.adjusted_rand(_documents(spark, sf), []).select(r6("ari").alias("ari"), n("n_samples").alias("n_samples"))


@register(
    "adjusted_rand_groups",
    L.query(
        ["t AS (SELECT event_type AS g, dayofweek(ts) AS truth, (value > 100) AS predicted, count(*) AS n FROM events GROUP BY ALL)"]
        + L.rand_index("t", "g"),
        f"SELECT g AS event_type, {L.r6('ari')} AS ari FROM ari_t",
    ),
)
def adjusted_rand_groups(spark, sf):
    events = I.table(spark, sf, "events").select(
        "event_type", F.dayofweek("ts").alias("day"), (F.col("value") > 100).alias("large")
    )
    table = M.contingency(events, ["event_type"], "day", "large")
    return M.adjusted_rand(table, ["event_type"]).select("event_type", r6("ari").alias("ari"))


@register(
    "mutual_information",
    L.query(
        [
            _TABLE,
            "a AS (SELECT truth, sum(n) AS r FROM t GROUP BY ALL)",
            "b AS (SELECT predicted, sum(n) AS c FROM t GROUP BY ALL)",
            "s AS (SELECT sum(n)::double AS total FROM t)",
            "mi AS (SELECT sum(n / total * ln(n * total / (r::double * c))) AS v FROM t JOIN a USING (truth) JOIN b USING (predicted), s)",
            "h1 AS (SELECT sum(-(r / total) * ln(r / total)) AS v FROM a, s)",
            "h2 AS (SELECT sum(-(c / total) * ln(c / total)) AS v FROM b, s)",
        ],
        f"SELECT {L.r6('mi.v / ((h1.v + h2.v) / 2)')} AS nmi FROM mi, h1, h2",
    ),
)
def mutual_information(spark, sf):
    return M.normalised_mutual_information(_documents(spark, sf), []).select(r6("nmi").alias("nmi"))


@register(
    "co_membership",
    """WITH t AS (SELECT l_linestatus, l_returnflag AS truth, l_linenumber AS predicted, count(*)::double AS n FROM lineitem GROUP BY ALL)
       SELECT l_linestatus, round(min(share), 6) + 0.0 AS strength FROM (
         SELECT l_linestatus, predicted, sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2) AS share FROM t GROUP BY ALL)
       GROUP BY l_linestatus""",
)
def co_membership(spark, sf):
    table = M.contingency(I.table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", "l_linenumber")
    return M.co_membership(table, ["l_linestatus"], 7, "s").select("l_linestatus", r6("s").alias("strength"))


@register(
    "nondegeneracy",
    f"""WITH s AS (SELECT o_orderpriority AS g, o_orderstatus, count(*) AS c FROM orders GROUP BY ALL),
        t AS (SELECT g, sum(c) AS total, min(c) AS small, count(*) AS k FROM s GROUP BY g),
        e AS (SELECT g, sum(-(c / total) * ln(c / total)) / ln(3.0) AS h FROM s JOIN t USING (g) GROUP BY g)
        SELECT g AS dataset_id, {L.r6('least(least(1.0, small / total / 0.34), h)')} AS score,
        (k = 3 AND small / total >= 0.34) AS passes, {L.r6('small / total')} AS smallest, {L.r6('h')} AS entropy FROM t JOIN e USING (g)""",
)
def nondegeneracy(spark, sf):
    labels = I.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderstatus").alias("cluster")
    )
    return M.nondegeneracy(labels, ["dataset_id"], 3, 0.34).select(
        "dataset_id",
        r6("nondegeneracy_score").alias("score"),
        F.col("nondegenerate").alias("passes"),
        r6("min_cluster_fraction").alias("smallest"),
        r6("cluster_entropy").alias("entropy"),
    )


def _accepted(spark, sf):
    """Documents as samples: language is the label, source number the cluster, accepted only with a quality label."""
    documents = I.table(spark, sf, "documents")
    marks = I.table(spark, sf, "labels").select("doc_id", "quality")
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 4
    return documents.join(marks, "doc_id", "left").select(
        F.col("lang").alias("label"),
        F.when(F.col("quality").isNotNull(), number).alias("accepted_cluster"),
        F.lit("documents").alias("dataset_id"),
    )


_ACCEPTED = """acc AS (SELECT lang AS label, CASE WHEN quality IS NOT NULL THEN regexp_extract(source, '(\\d+)', 1)::int % 4 END AS accepted_cluster
  FROM documents LEFT JOIN labels USING (doc_id))"""


@register(
    "coverage_and_accepted_agreement",
    L.query(
        [_ACCEPTED, "t AS (SELECT label AS truth, accepted_cluster AS predicted, count(*) AS n FROM acc WHERE accepted_cluster IS NOT NULL GROUP BY ALL)"]
        + L.rand_index("t", "")
        + ["m AS (SELECT accepted_cluster, count(*) AS c FROM acc WHERE accepted_cluster IS NOT NULL GROUP BY ALL)"],
        f"""SELECT {L.r6('(SELECT avg((accepted_cluster IS NOT NULL)::int) FROM acc)')} AS coverage, {L.r6('ari')} AS accepted_ari,
        {L.r6('(SELECT min(c) FROM m) / (SELECT count(*) FROM acc)')} AS min_accepted_share FROM ari_t""",
    ),
)
def coverage_and_accepted_agreement(spark, sf):
    rows = _accepted(spark, sf)
    keys = ["dataset_id"]
    return (
        M.coverage(rows, keys)
        .join(M.accepted_rand(rows, keys), keys)
        .join(M.smallest_accepted_share(rows, keys, 4), keys)
        .select(r6("coverage").alias("coverage"), r6("accepted_ari").alias("accepted_ari"), r6("min_accepted_share").alias("min_accepted_share"))
    )


@register(
    "pair_recovery",
    L.query(
        L.matrix("m3") + L.selected("m3", 10)
        + [
            """p AS (SELECT * FROM (SELECT a.dataset_id, least(a.feature_id, b.feature_id) AS l, greatest(a.feature_id, b.feature_id) AS r,
                row_number() OVER (PARTITION BY a.dataset_id ORDER BY a.feature_rank, b.feature_rank) AS pos
                FROM sel a JOIN sel b ON a.dataset_id = b.dataset_id AND a.feature_rank < b.feature_rank) WHERE pos <= 20)"""
        ],
        f"""SELECT {L.r6('avg((EXISTS (SELECT 1 FROM p o WHERE o.dataset_id = p.dataset_id_o AND o.l = p.l AND o.r = p.r))::int)')} AS recovery
        FROM (SELECT l, r, 'O' AS dataset_id_o FROM p WHERE dataset_id = 'F') p""",
    ),
)
def pair_recovery(spark, sf):
    chosen = cut(R.top_features(R.feature_stats(I.m3(spark, sf)), 10))
    pairs = K.ranked_pairs(chosen, 20).withColumnRenamed("left", "feature_a").withColumnRenamed("right", "feature_b")
    one = F.lit("all").alias("model_id")
    truth = pairs.where("dataset_id = 'F'").select(one, "feature_a", "feature_b")
    learned = pairs.where("dataset_id = 'O'").select(one, "feature_a", "feature_b")
    return M.pair_recovery(truth, learned, ["model_id"]).select(r6("pair_recovery").alias("recovery"))


@register(
    "prototype_sizes",
    "SELECT l_suppkey::varchar AS model_id, count(*)::bigint AS prototype_size FROM lineitem GROUP BY ALL",
)
def prototype_sizes(spark, sf):
    rules = I.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("model_id"))
    return M.prototype_size(rules, ["model_id"]).select("model_id", n("prototype_size").alias("prototype_size"))


@register(
    "grouped_medians",
    f"""SELECT l_returnflag, l_linestatus, count(*)::bigint AS n, {L.r6('quantile_cont(l_quantity, 0.5)')} AS median_quantity,
        {L.r6('quantile_cont(l_extendedprice, 0.5)')} AS median_price FROM lineitem GROUP BY ALL""",
)
def grouped_medians(spark, sf):
    out = G.grouped_medians(
        I.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]
    )
    return out.select(
        "l_returnflag", "l_linestatus", n("n").alias("n"),
        r6("median_l_quantity").alias("median_quantity"), r6("median_l_extendedprice").alias("median_price"),
    )


_REPORT = f"""rep AS (SELECT l_linestatus AS status, 'all' AS calibration_id, lpad(l_suppkey::varchar, 20, '0') AS report_id,
    (['V_EUC_PAM', 'V_COR_PAM', 'R_FOOT_PAM', 'R_PAIR_PAM', 'H_EUC_PAIR_A025_PAM', 'H_EUC_PAIR_A050_PAM', 'H_EUC_PAIR_A075_PAM'])[l_linenumber] AS method_id,
    CASE WHEN l_linenumber <= 2 THEN 'VALUE' WHEN l_linenumber <= 4 THEN 'RELATIONAL' ELSE 'HYBRID' END AS family,
    round({L.mean('l_discount')} * 10.0, 6) AS q_score, {L.mean('l_tax')} >= 0.035 AS nondegenerate,
    count(*)::int AS complexity, round({L.mean('l_quantity')} / 50.0, 6) AS ari
  FROM lineitem GROUP BY l_linestatus, l_suppkey, l_linenumber)"""


@register(
    "method_pivot",
    L.query(
        [_REPORT],
        """SELECT report_id AS dataset_id, max(ari) FILTER (method_id = 'V_EUC_PAM') + 0.0 AS V_EUC_PAM,
        max(ari) FILTER (method_id = 'R_PAIR_PAM') + 0.0 AS R_PAIR_PAM FROM rep WHERE status = 'O' GROUP BY report_id""",
    ),
)
def method_pivot(spark, sf):
    table = I.audit_reports(spark, sf).where("status = 'O'").withColumnRenamed("report_id", "dataset_id")
    return G.method_pivot(table, ["V_EUC_PAM", "R_PAIR_PAM"])


# ---------------------------------------------------------------- calibration and selection


def _null(spark, sf):
    return cut(I.audit_reports(spark, sf).where("status = 'F'").drop("status"))


def _audited(spark, sf):
    return cut(I.audit_reports(spark, sf).where("status = 'O'").drop("status").withColumn("dataset_id", F.col("report_id")))


def _higher(source: str, value: str, q: str, out: str, group: str = "method_id") -> str:
    """Upper quantile per group in SQL."""
    return f"""{out} AS (SELECT {group}, {value} AS {out}_v, c AS {out}_n FROM (SELECT {group}, {value},
        row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS pos, count(*) OVER (PARTITION BY {group}) AS c
        FROM {source} WHERE {value} IS NOT NULL) WHERE pos = ceil({q}::double * (c - 1)))"""


_CAL = [
    _REPORT,
    "nul AS (SELECT * FROM rep WHERE status = 'F')",
    _higher("nul", "q_score", "0.9", "thr"),
    """gains AS (SELECT 'all' AS g, report_id, max(q_score) FILTER (family = 'HYBRID') - max(q_score) FILTER (family <> 'HYBRID') AS gain
      FROM nul GROUP BY report_id)""",
    _higher("gains", "gain", "0.9", "gq", "g"),
    """loo AS (SELECT a.report_id, a.method_id, a.nondegenerate, a.q_score,
        (SELECT list_sort(list(b.q_score))[ceil(0.9::double * (count(*) - 1))::int + 1] FROM nul b
         WHERE b.method_id = a.method_id AND b.report_id <> a.report_id) AS held FROM nul a)""",
    """exc AS (SELECT 'all' AS g, report_id, coalesce(max(q_score - held) FILTER (nondegenerate), 0.0) AS e FROM loo GROUP BY report_id)""",
    _higher("exc", "e", "0.9", "mq", "g"),
    "cal AS (SELECT greatest(0.02, gq_v) AS delta, greatest(0.0, mq_v) AS margin FROM gq, mq)",
]


@register(
    "null_thresholds",
    L.query(_CAL, f"SELECT method_id, {L.r6('thr_v')} AS threshold, thr_n::bigint AS n FROM thr"),
)
def null_thresholds(spark, sf):
    thresholds, _ = S.calibrate(_null(spark, sf))
    return thresholds.select("method_id", r6("threshold").alias("threshold"), n("n").alias("n"))


@register(
    "null_calibration",
    L.query(_CAL, f"SELECT {L.r6('delta')} AS delta_hybrid, {L.r6('margin')} AS multiple_testing_margin, 3::bigint AS k FROM cal"),
)
def null_calibration(spark, sf):
    _, calibration = S.calibrate(_null(spark, sf))
    return calibration.select(
        r6("delta_hybrid").alias("delta_hybrid"), r6("multiple_testing_margin").alias("multiple_testing_margin"), n("k").alias("k")
    )


@register(
    "held_out_thresholds",
    L.query(_CAL, f"SELECT report_id, method_id, {L.r6('held')} AS held_out_threshold FROM loo"),
)
def held_out_thresholds(spark, sf):
    return S.held_out_thresholds(_null(spark, sf)).select(
        "report_id", "method_id", r6("held_out_threshold").alias("held_out_threshold")
    )


@register(
    "leave_one_out_thresholds",
    L.query(_CAL, f"SELECT report_id AS excluded, method_id, {L.r6('held')} AS threshold FROM loo"),
)
def leave_one_out_thresholds(spark, sf):
    """Thresholds of the calibration set that leaves one NULL report out, for every report."""
    return S.leave_one_out_thresholds(_null(spark, sf)).select("excluded", "method_id", r6("threshold").alias("threshold"))


@register(
    "leave_one_out_deltas",
    L.query(
        _CAL,
        f"""SELECT report_id AS excluded, {L.r6('greatest(0.02, coalesce(d, 0.0))')} AS delta_hybrid FROM (SELECT a.report_id,
        (SELECT list_sort(list(b.gain))[ceil(0.9::double * (count(*) - 1))::int + 1] FROM gains b
         WHERE b.gain IS NOT NULL AND b.report_id <> a.report_id) AS d FROM gains a)""",
    ),
)
def leave_one_out_deltas(spark, sf):
    """Least hybrid gain of the calibration set that leaves one NULL report out, for every report."""
    return S.leave_one_out_deltas(_null(spark, sf)).select("excluded", r6("delta_hybrid").alias("delta_hybrid"))


_ELIG = _CAL + [
    """elig AS (SELECT r.*, least(1.0, thr_v + margin) AS lim, delta,
        CASE WHEN thr_v IS NULL THEN 'no_null_threshold' WHEN NOT nondegenerate THEN 'degenerate'
             WHEN q_score <= least(1.0, thr_v + margin) THEN 'not_above_null_threshold' END AS reason
      FROM (SELECT * FROM rep WHERE status = 'O') r LEFT JOIN thr USING (method_id), cal)"""
]


@register(
    "eligibility",
    L.query(_ELIG, f"SELECT report_id, method_id, {L.r6('lim')} AS null_threshold, coalesce(reason, 'eligible') AS reason FROM elig"),
)
def eligibility(spark, sf):
    thresholds, calibration = S.calibrate(_null(spark, sf))
    table = S.eligibility(_audited(spark, sf), thresholds, calibration)
    return table.select(
        "report_id", "method_id", r6("null_threshold").alias("null_threshold"), F.coalesce("reason", F.lit("eligible")).alias("reason")
    )


# thresholds at the NULL median and no margin, so that the stand-in audits reach every decision
_LOW = [
    _REPORT,
    "nul AS (SELECT * FROM rep WHERE status = 'F')",
    _higher("nul", "q_score", "0.5", "thr"),
    """elig AS (SELECT r.*, thr_v AS lim,
        CASE WHEN thr_v IS NULL THEN 'no_null_threshold' WHEN NOT nondegenerate THEN 'degenerate'
             WHEN q_score <= least(1.0, thr_v) THEN 'not_above_null_threshold' END AS reason
      FROM (SELECT * FROM rep WHERE status = 'O') r LEFT JOIN thr USING (method_id))""",
    """best AS (SELECT report_id, family, method_id, q_score, complexity,
        row_number() OVER (PARTITION BY report_id, family ORDER BY q_score DESC, complexity, method_id) AS pos FROM elig WHERE reason IS NULL)""",
    """wide AS (SELECT r.report_id, v.method_id AS vm, v.q_score AS vq, v.complexity AS vc, p.method_id AS pm, p.q_score AS pq, p.complexity AS pc,
        h.method_id AS hm, h.q_score AS hq, av, ar
      FROM (SELECT report_id, max(q_score) FILTER (family = 'VALUE') AS av, max(q_score) FILTER (family = 'RELATIONAL') AS ar FROM elig GROUP BY report_id) r
      LEFT JOIN (SELECT * FROM best WHERE pos = 1 AND family = 'VALUE') v USING (report_id)
      LEFT JOIN (SELECT * FROM best WHERE pos = 1 AND family = 'RELATIONAL') p USING (report_id)
      LEFT JOIN (SELECT * FROM best WHERE pos = 1 AND family = 'HYBRID') h USING (report_id))""",
    """dec AS (SELECT *, CASE WHEN hm IS NOT NULL AND av IS NOT NULL AND ar IS NOT NULL AND hq > greatest(av, ar) + 0.02 THEN 'HYBRID'
        WHEN vm IS NOT NULL AND pm IS NOT NULL AND abs(vq - pq) <= 0.02 THEN CASE WHEN vc <= pc THEN 'VALUE' ELSE 'RELATIONAL' END
        WHEN vm IS NOT NULL AND pm IS NOT NULL THEN CASE WHEN (-vq, vc, vm) <= (-pq, pc, pm) THEN 'VALUE' ELSE 'RELATIONAL' END
        WHEN vm IS NOT NULL THEN 'VALUE' WHEN pm IS NOT NULL THEN 'RELATIONAL' ELSE 'NO_STABLE_STRUCTURE' END AS decision FROM wide)""",
    """fin AS (SELECT report_id, decision, CASE decision WHEN 'HYBRID' THEN hm WHEN 'VALUE' THEN vm WHEN 'RELATIONAL' THEN pm END AS method_id,
        CASE decision WHEN 'HYBRID' THEN hq WHEN 'VALUE' THEN vq WHEN 'RELATIONAL' THEN pq END AS q_score,
        CASE decision WHEN 'HYBRID' THEN 0 WHEN 'VALUE' THEN vc WHEN 'RELATIONAL' THEN pc END AS complexity,
        CASE WHEN decision <> 'HYBRID' AND hm IS NOT NULL AND av IS NOT NULL AND ar IS NOT NULL THEN hm END AS weak FROM dec)""",
]


def _low_calibration(spark, sf):
    thresholds = cut(S.method_thresholds(_null(spark, sf), 0.5))
    calibration = thresholds.groupBy("calibration_id").agg(
        F.lit(0.02).alias("delta_hybrid"), F.lit(0.0).alias("multiple_testing_margin"), F.lit(3).alias("k")
    )
    return thresholds, cut(calibration)


@register(
    "decisions",
    L.query(_LOW, f"SELECT report_id, decision, method_id, {L.r6('q_score')} AS q_score, weak AS hybrid_without_gain FROM fin"),
)
def decisions(spark, sf):
    thresholds, calibration = _low_calibration(spark, sf)
    found = S.decide(S.eligibility(_audited(spark, sf), thresholds, calibration))
    return found.select("report_id", "decision", "method_id", r6("q_score").alias("q_score"), "hybrid_without_gain")


@register(
    "rejections",
    L.query(
        _LOW,
        """SELECT report_id, method_id, reason FROM elig WHERE reason IS NOT NULL
        UNION ALL SELECT report_id, weak, 'insufficient_gain_over_both_pure_endpoints' FROM fin WHERE weak IS NOT NULL""",
    ),
)
def rejections(spark, sf):
    thresholds, calibration = _low_calibration(spark, sf)
    table = S.eligibility(_audited(spark, sf), thresholds, calibration)
    return S.rejections(table, S.decide(table)).select("report_id", "method_id", "reason")


@register(
    "representation_votes",
    L.query(
        _LOW
        + [
            "own AS (SELECT fin.*, s_nationkey AS nation FROM fin JOIN supplier ON lpad(s_suppkey::varchar, 20, '0') = report_id)",
            """cnt AS (SELECT nation, decision, count(*) AS votes,
                CASE decision WHEN 'NO_STABLE_STRUCTURE' THEN 0 WHEN 'VALUE' THEN 1 WHEN 'RELATIONAL' THEN 2 ELSE 3 END AS tie FROM own GROUP BY ALL)""",
            """win AS (SELECT nation, decision, votes, sum(votes) OVER (PARTITION BY nation) AS total,
                row_number() OVER (PARTITION BY nation ORDER BY votes DESC, tie) AS pos FROM cnt)""",
            """sm AS (SELECT w.nation, o.method_id, o.q_score, row_number() OVER (PARTITION BY w.nation ORDER BY o.q_score DESC, o.complexity_o, o.method_id) AS pos
              FROM win w JOIN (SELECT own.*, e.complexity AS complexity_o FROM own JOIN elig e ON e.report_id = own.report_id AND e.method_id = own.method_id) o
                ON o.nation = w.nation AND o.decision = w.decision WHERE w.pos = 1 AND o.method_id IS NOT NULL)""",
        ],
        f"""SELECT w.nation::varchar AS dataset_id, w.decision, {L.r6('votes / total')} AS confidence, (votes / total < 0.6) AS uncertain,
        sm.method_id AS selected_method, {L.r6('sm.q_score')} AS q_score, {L.r6('CASE WHEN thr_v IS NOT NULL THEN least(1.0, thr_v) END')} AS null_threshold
        FROM win w LEFT JOIN sm ON sm.nation = w.nation AND sm.pos = 1 LEFT JOIN thr ON thr.method_id = sm.method_id WHERE w.pos = 1""",
    ),
)
def representation_votes(spark, sf):
    """Suppliers of one nation are repeated audits of one dataset and vote on its representation."""
    thresholds, calibration = _low_calibration(spark, sf)
    owners = I.table(spark, sf, "supplier").select(
        I.padded("s_suppkey").alias("report_id"), F.col("s_nationkey").cast("string").alias("dataset_id")
    )
    metrics = _audited(spark, sf).drop("dataset_id").join(owners, "report_id")
    chosen = S.select_representation(metrics, thresholds, calibration)
    return chosen.select(
        "dataset_id", "decision", r6("decision_confidence").alias("confidence"), "uncertain",
        "selected_method", r6("q_score").alias("q_score"), r6("null_threshold").alias("null_threshold"),
    )


@register(
    "eligible_alternatives",
    L.query(
        _LOW,
        """SELECT f.report_id AS dataset_id, e.method_id AS alternative FROM fin f JOIN elig e USING (report_id)
        WHERE e.reason IS NULL AND e.method_id IS DISTINCT FROM f.method_id""",
    ),
)
def eligible_alternatives(spark, sf):
    thresholds, calibration = _low_calibration(spark, sf)
    chosen = S.select_representation(_audited(spark, sf), thresholds, calibration)
    return chosen.select("dataset_id", F.explode("eligible_alternatives").alias("alternative"))


# ---------------------------------------------------------------- evaluation and gates


@register(
    "oracle_and_regret",
    L.query(
        _LOW
        + [
            "orc AS (SELECT report_id, method_id, ari, row_number() OVER (PARTITION BY report_id ORDER BY ari DESC, method_id) AS pos FROM elig)",
        ],
        f"""SELECT f.report_id AS dataset_id, f.decision, {L.r6('coalesce(e.ari, 0.0)')} AS selected_ari, o.method_id AS oracle_method,
        {L.r6('o.ari')} AS oracle_ari, {L.r6('greatest(0.0, o.ari - coalesce(e.ari, 0.0))')} AS regret
        FROM fin f JOIN orc o ON o.report_id = f.report_id AND o.pos = 1
        LEFT JOIN elig e ON e.report_id = f.report_id AND e.method_id = f.method_id""",
    ),
)
def oracle_and_regret(spark, sf):
    thresholds, calibration = _low_calibration(spark, sf)
    audited = _audited(spark, sf)
    chosen = S.select_representation(audited, thresholds, calibration).select("dataset_id", "decision", "selected_method")
    judged = G.regret(audited.select("dataset_id", "method_id", "ari"), chosen, ["dataset_id"], "ari")
    return judged.select(
        "dataset_id", "decision", r6("selected_ari").alias("selected_ari"), "oracle_method",
        r6("oracle_ari").alias("oracle_ari"), r6("regret").alias("regret"),
    )


@register(
    "family_maxima",
    L.query(
        [_REPORT],
        f"""SELECT report_id AS dataset_id, {', '.join(
            f"{L.r6(f'max({c}) FILTER (family = {chr(39)}{f}{chr(39)})')} AS {p}_{f.lower()}"
            for c, p in (('q_score', 'q'), ('ari', 'ari')) for f in ('VALUE', 'RELATIONAL', 'HYBRID'))}
        FROM rep WHERE status = 'O' GROUP BY report_id""",
    ),
)
def family_maxima(spark, sf):
    best = G.family_maxima(_audited(spark, sf), ["dataset_id"], {"q_score": "q", "ari": "ari"})
    return best.select("dataset_id", *[r6(c).alias(c) for c in best.columns if c != "dataset_id"])


@register(
    "method_metrics",
    """WITH acc AS (SELECT substr(o_orderpriority, 1, 1) AS method_id, o_orderstatus AS label, (o_custkey % 3)::int AS forced,
          CASE WHEN o_totalprice > 50000 THEN (o_custkey % 3)::int END AS accepted FROM orders),"""
    + ",".join(
        [
            "\nt AS (SELECT method_id, label AS truth, forced AS predicted, count(*) AS n FROM acc GROUP BY ALL)",
            "\nu AS (SELECT method_id, label AS truth, accepted AS predicted, count(*) AS n FROM acc WHERE accepted IS NOT NULL GROUP BY ALL)",
            *["\n" + p for p in L.rand_index("t", "method_id", "ari")],
            *["\n" + p for p in L.rand_index("u", "method_id", "acc_ari")],
            """
hh AS (SELECT method_id, total, sum(n / total::double * ln(n * total::double / (r::double * c))) AS mi FROM t
  JOIN (SELECT method_id, truth, sum(n) AS r FROM t GROUP BY ALL) USING (method_id, truth)
  JOIN (SELECT method_id, predicted, sum(n) AS c FROM t GROUP BY ALL) USING (method_id, predicted)
  JOIN (SELECT method_id, sum(n) AS total FROM t GROUP BY ALL) USING (method_id) GROUP BY ALL)""",
            """
h1 AS (SELECT method_id, sum(-(r / total) * ln(r / total)) AS h FROM (SELECT method_id, truth, sum(n)::double AS r FROM t GROUP BY ALL)
  JOIN hh USING (method_id) GROUP BY ALL)""",
            """
h2 AS (SELECT method_id, sum(-(r / total) * ln(r / total)) AS h FROM (SELECT method_id, predicted, sum(n)::double AS r FROM t GROUP BY ALL)
  JOIN hh USING (method_id) GROUP BY ALL)""",
        ]
    )
    + f"""
SELECT method_id, {L.r6('ari')} AS ari_forced, {L.r6('mi / ((h1.h + h2.h) / 2)')} AS nmi_forced,
  {L.r6('(SELECT avg((accepted IS NOT NULL)::int) FROM acc WHERE acc.method_id = ari_t.method_id)')} AS coverage, {L.r6('acc_ari')} AS accepted_ari
FROM ari_t JOIN hh USING (method_id) JOIN h1 USING (method_id) JOIN h2 USING (method_id) JOIN acc_ari_t USING (method_id)""",
)
def method_metrics(spark, sf):
    orders = I.table(spark, sf, "orders")
    forced = (F.col("o_custkey") % 3).cast("int")
    assigned = orders.select(
        F.substring("o_orderpriority", 1, 1).alias("method_id"),
        F.col("o_orderkey").alias("sample_id"),
        forced.alias("forced_cluster"),
        F.when(F.col("o_totalprice") > 50000, forced).alias("accepted_cluster"),
    )
    labels = orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("label"))
    out = G.method_metrics(assigned, labels, ["method_id"])
    return out.select("method_id", *[r6(c).alias(c) for c in ("ari_forced", "nmi_forced", "coverage", "accepted_ari")])


@register(
    "class_match",
    "SELECT event_type AS dataset_id, count(DISTINCT dayofweek(ts))::bigint AS classes, count(DISTINCT dayofweek(ts)) = 7 AS k_matches FROM events GROUP BY ALL",
)
def class_match(spark, sf):
    events = I.table(spark, sf, "events")
    labels = events.select(F.col("event_type").alias("dataset_id"), F.dayofweek("ts").cast("string").alias("label"))
    selection = labels.select("dataset_id").distinct().withColumn("selected_k", F.lit(7))
    return G.class_match(labels, selection).select("dataset_id", n("classes").alias("classes"), "k_matches")


_RUNS = """runs AS (SELECT *, decision = expected_decision AS decision_correct FROM (
  SELECT *, CASE WHEN regime = 'NULL' THEN 'NO_STABLE_STRUCTURE' ELSE regime END AS expected_decision,
    CASE WHEN o_orderstatus = 'F' AND regime <> 'NULL' THEN regime WHEN o_totalprice > 400000 THEN 'HYBRID'
         WHEN o_totalprice > 300000 THEN 'VALUE' ELSE 'NO_STABLE_STRUCTURE' END AS decision,
    round(greatest(0.0, greatest(coalesce(ari_value, 0.0), coalesce(ari_relational, 0.0), coalesce(ari_hybrid, 0.0)) - coalesce(ari_value, 0.0)), 6) AS regret,
    CASE WHEN o_orderstatus = 'P' THEN 'moderate' ELSE 'strong' END AS signal, lower(o_orderstatus) AS shift
  FROM (SELECT o.*, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'VALUE' WHEN '2' THEN 'RELATIONAL' WHEN '3' THEN 'HYBRID' ELSE 'NULL' END AS regime,
    l.* FROM orders o LEFT JOIN (SELECT l_orderkey,
      round(max(l_discount) FILTER ((l_linenumber - 1) % 3 = 0) * 10.0, 6) AS q_value, round(max(l_quantity) FILTER ((l_linenumber - 1) % 3 = 0) / 50.0, 6) AS ari_value,
      round(max(l_discount) FILTER ((l_linenumber - 1) % 3 = 1) * 10.0, 6) AS q_relational, round(max(l_quantity) FILTER ((l_linenumber - 1) % 3 = 1) / 50.0, 6) AS ari_relational,
      round(max(l_discount) FILTER ((l_linenumber - 1) % 3 = 2) * 10.0, 6) AS q_hybrid, round(max(l_quantity) FILTER ((l_linenumber - 1) % 3 = 2) / 50.0, 6) AS ari_hybrid
      FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey)))"""


@register(
    "primary_gate",
    L.query(
        [
            _RUNS,
            """con AS (SELECT q_value - q_relational AS dq, ari_value - ari_relational AS da FROM runs WHERE regime <> 'NULL'
              UNION ALL SELECT q_hybrid - q_value, ari_hybrid - ari_value FROM runs WHERE regime <> 'NULL'
              UNION ALL SELECT q_hybrid - q_relational, ari_hybrid - ari_relational FROM runs WHERE regime <> 'NULL')""",
            """rk AS (SELECT rank() OVER (ORDER BY dq) + (count(*) OVER (PARTITION BY dq) - 1) / 2.0 AS a,
              rank() OVER (ORDER BY da) + (count(*) OVER (PARTITION BY da) - 1) / 2.0 AS b FROM (SELECT * FROM con WHERE dq IS NOT NULL AND da IS NOT NULL))""",
            """m AS (SELECT count(*) AS runs, avg(decision_correct::int) FILTER (regime <> 'NULL') AS ident,
              quantile_cont(regret, 0.5) FILTER (regime <> 'NULL') AS med, avg((decision <> 'NO_STABLE_STRUCTURE')::int) FILTER (regime = 'NULL') AS nf,
              avg((decision = 'HYBRID')::int) FILTER (regime IN ('VALUE', 'RELATIONAL')) AS hp FROM runs)""",
            "s AS (SELECT corr(a, b) AS rho FROM rk)",
        ],
        f"""SELECT runs::bigint AS runs, {L.r6('ident')} AS identification_rate, {L.r6('med')} AS median_regret, {L.r6('nf')} AS null_false_structure_rate,
        {L.r6('hp')} AS hybrid_on_pure_rate, {L.r6('rho')} AS spearman, (ident >= 0.7) AS identification_ok, (med <= 0.05) AS regret_ok,
        (nf <= 0.1) AS null_ok, (hp <= 0.2) AS hybrid_ok, (rho >= 0.4) AS spearman_ok FROM m, s""",
    ),
)
def primary_gate(spark, sf):
    runs = cut(I.gate_runs(spark, sf))
    report = G.primary_gate(runs, 630)
    rates = ("identification_rate", "median_regret", "null_false_structure_rate", "hybrid_on_pure_rate", "spearman")
    checks = ("identification_ok", "regret_ok", "null_ok", "hybrid_ok", "spearman_ok")
    return report.select(n("runs").alias("runs"), *[r6(c).alias(c) for c in rates], *checks)


@register(
    "gate_cells",
    L.query(
        [_RUNS, "spread AS (SELECT unnest(['all', regime, regime || '/' || signal || '/' || shift]) AS cell, * FROM runs)"],
        f"""SELECT cell, count(*)::bigint AS n, {L.r6('avg(decision_correct::int)')} AS decision_accuracy, {L.r6('quantile_cont(regret, 0.5)')} AS median_regret,
        count(*) FILTER (decision = 'VALUE')::bigint AS n_value, count(*) FILTER (decision = 'NO_STABLE_STRUCTURE')::bigint AS n_none FROM spread GROUP BY cell""",
    ),
)
def gate_cells(spark, sf):
    cells = G.cell_report(cut(I.gate_runs(spark, sf)))
    return cells.select(
        "cell", n("n").alias("n"), r6("decision_accuracy").alias("decision_accuracy"), r6("median_regret").alias("median_regret"),
        n("n_value").alias("n_value"), n("n_no_stable_structure").alias("n_none"),
    )


@register(
    "smoke_gate",
    L.query(
        [
            _RUNS,
            """m AS (SELECT count(*) AS runs, avg(decision_correct::int) FILTER (regime <> 'NULL') AS ident,
              avg((decision <> 'NO_STABLE_STRUCTURE')::int) FILTER (regime = 'NULL') AS nf,
              avg((decision = 'HYBRID')::int) FILTER (regime IN ('VALUE', 'RELATIONAL')) AS hp FROM runs)""",
        ],
        f"""SELECT runs::bigint AS runs, {L.r6('ident')} AS identification_rate, {L.r6('nf')} AS null_false_structure_rate, {L.r6('hp')} AS hybrid_on_pure_rate,
        (runs = 40 AND ident >= 0.7 AND nf <= 0.1 AND hp <= 0.2) AS go FROM m""",
    ),
)
def smoke_gate(spark, sf):
    report = G.smoke_gate(I.gate_runs(spark, sf), 40)
    rates = ("identification_rate", "null_false_structure_rate", "hybrid_on_pure_rate")
    return report.select(n("runs").alias("runs"), *[r6(c).alias(c) for c in rates], "go")


@register(
    "regime_report",
    L.query([_RUNS], f"SELECT regime, decision, count(*)::bigint AS n, {L.r6('avg(decision_correct::int)')} AS decision_accuracy FROM runs GROUP BY ALL"),
)
def regime_report(spark, sf):
    report = G.regime_report(I.gate_runs(spark, sf))
    return report.select("regime", "decision", n("n").alias("n"), r6("decision_accuracy").alias("decision_accuracy"))


@register(
    "expected_decisions",
    L.query([_RUNS], "SELECT run_id, decision, expected_decision, decision_correct FROM (SELECT o_orderkey::varchar AS run_id, * FROM runs)"),
)
def expected_decisions(spark, sf):
    runs = I.gate_runs(spark, sf).withColumn("run_id", F.col("run_id").cast("string"))
    expected = runs.select("run_id", "expected_decision")
    found = G.expected_decision(runs.select("run_id", "decision"), expected, ["run_id"])
    return found.select("run_id", "decision", "expected_decision", "decision_correct")


def _evaluations(spark, sf):
    runs = I.gate_runs(spark, sf)
    return runs.select(
        F.col("run_id").alias("dataset_id"), "decision", F.col("expected_decision").alias("oracle_family"),
        F.coalesce("ari_value", F.lit(0.0)).alias("selected_ari"), "regret",
        (F.col("signal") == "strong").alias("k_matches"),
    )


@register(
    "within_summary",
    L.query(
        [_RUNS],
        f"""SELECT count(*)::bigint AS datasets, bool_and(signal = 'strong') AS all_k_match, {L.r6('quantile_cont(coalesce(ari_value, 0.0), 0.5)')} AS median_selected_ari,
        {L.r6('quantile_cont(regret, 0.5)')} AS median_regret, {L.r6('avg((regret <= 0.05)::int)')} AS within_005_rate FROM runs""",
    ),
)
def within_summary(spark, sf):
    report = G.within_summary(_evaluations(spark, sf))
    return report.select(
        n("datasets").alias("datasets"), "all_k_match",
        *[r6(c).alias(c) for c in ("median_selected_ari", "median_regret", "within_005_rate")],
    )


@register(
    "decision_counts",
    L.query(
        [_RUNS],
        """SELECT 'decision' AS kind, decision AS name, count(*)::bigint AS n FROM runs GROUP BY ALL
        UNION ALL SELECT 'oracle_family', expected_decision, count(*) FROM runs GROUP BY ALL""",
    ),
)
def decision_counts(spark, sf):
    return G.decision_counts(_evaluations(spark, sf)).select("kind", "name", n("n").alias("n"))


@register(
    "transfer_gate",
    """WITH d AS (SELECT l_linestatus, l_returnflag, abs(avg(l_discount) - 0.05) AS regret, avg((l_quantity > 5)::int) AS coverage, min(l_tax) + 0.2 AS share FROM lineitem GROUP BY ALL),
       r AS (SELECT list_sort(list(regret)) AS rs, count(*) AS c, bool_and(coverage >= 0.8) AS cov, bool_and(share >= 0.1) AS shr FROM d)
       SELECT c::bigint AS directions, (c >= 2 AND rs[1] <= 0.05 AND rs[-1] <= 0.1) AS regret_ok, cov AS coverage_ok, shr AS cluster_share_ok,
       (c >= 2 AND rs[1] <= 0.05 AND rs[-1] <= 0.1 AND cov AND shr) AS go FROM r""",
)
def transfer_gate(spark, sf):
    directions = I.table(spark, sf, "lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("direction_id")).agg(
        F.abs(F.avg("l_discount") - 0.05).alias("regret"),
        F.avg((F.col("l_quantity") > 5).cast("double")).alias("coverage"),
        (F.min("l_tax") + 0.2).alias("min_accepted_share"),
        F.lit(True).alias("frozen"),
    )
    return G.transfer_gate(directions).select(
        n("directions").alias("directions"), "regret_ok", "coverage_ok", "cluster_share_ok", "go"
    )


@register(
    "paired_difference",
    L.query(
        [_REPORT],
        f"""SELECT a.report_id AS dataset_id, {L.r6('a.ari - b.ari')} AS difference FROM rep a JOIN rep b USING (report_id, status)
        WHERE a.status = 'O' AND a.method_id = 'R_PAIR_PAM' AND b.method_id = 'V_EUC_PAM'""",
    ),
)
def paired_difference(spark, sf):
    table = _audited(spark, sf).drop("report_id")
    return G.paired_difference(table, "R_PAIR_PAM", "V_EUC_PAM").select("dataset_id", r6("difference").alias("difference"))


_RULE_ROWS = f"""rr AS (SELECT l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'REL' ELSE 'NULL' END AS kind,
    CASE WHEN l_returnflag = 'R' THEN 'RR_DIRECT' ELSE 'RELATION_PAM' END AS method_id,
    round({L.mean('l_quantity')} / 30.0, 6) AS ari, round({L.mean('l_discount')} * 12.0, 6) AS rec, round({L.mean('l_tax')} * 5.0, 6) AS mar
  FROM lineitem GROUP BY ALL)"""


def _rule_rows(spark, sf):
    keys = [
        F.col("l_suppkey"),
        F.when(F.col("l_linestatus") == "F", "REL").otherwise("NULL").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "RR_DIRECT").otherwise("RELATION_PAM").alias("method_id"),
    ]
    return cut(
        I.table(spark, sf, "lineitem").groupBy(*keys).agg(
            F.round(I.exact_mean("l_quantity") / 30.0, 6).alias("ari"),
            F.round(I.exact_mean("l_discount") * 12.0, 6).alias("pair_recovery"),
            F.round(I.exact_mean("l_tax") * 5.0, 6).alias("score_margin"),
        )
    )


@register(
    "rule_gate",
    L.query(
        [
            _RULE_ROWS,
            """pd AS (SELECT a.ari - b.ari AS diff FROM rr a JOIN rr b USING (l_suppkey, kind) WHERE kind = 'REL' AND a.method_id = 'RR_DIRECT' AND b.method_id = 'RELATION_PAM')""",
            "tr AS (SELECT ari, rec AS coverage FROM rr WHERE kind = 'REL' AND method_id = 'RELATION_PAM')",
            """m AS (SELECT quantile_cont(ari, 0.5) FILTER (kind = 'REL') AS a, quantile_cont(rec, 0.5) FILTER (kind = 'REL') AS r,
              avg((ari > 0.5 AND mar > 0.15)::int) FILTER (kind = 'NULL') AS nc FROM rr WHERE method_id = 'RR_DIRECT')""",
        ],
        f"""SELECT {L.r6('a')} AS rel_median_ari, {L.r6('r')} AS rel_median_recovery, {L.r6('nc')} AS null_confident_rate,
        {L.r6('(SELECT quantile_cont(diff, 0.5) FROM pd)')} AS real_median_difference, {L.r6('(SELECT max(ari) FROM tr)')} AS best_transfer_ari,
        (a >= 0.75) AS ari_ok, (r >= 0.6) AS recovery_ok, (nc <= 0.1) AS null_ok, ((SELECT quantile_cont(diff, 0.5) FROM pd) >= -0.05) AS noninferior_ok,
        coalesce((SELECT bool_or(ari >= 0.7 AND coverage >= 0.7) FROM tr), false) AS transfer_ok FROM m""",
    ),
)
def rule_gate(spark, sf):
    rows = _rule_rows(spark, sf)
    real = rows.where("kind = 'REL'").withColumn("dataset_id", F.col("l_suppkey").cast("string"))
    transfers = real.where("method_id = 'RELATION_PAM'").select("ari", F.col("pair_recovery").alias("coverage"))
    report = G.rule_gate(rows, real, transfers)
    values = ("rel_median_ari", "rel_median_recovery", "null_confident_rate", "real_median_difference", "best_transfer_ari")
    return report.select(
        *[r6(c).alias(c) for c in values], "ari_ok", "recovery_ok", "null_ok", "noninferior_ok", "transfer_ok"
    )


@register(
    "identifiability_summary",
    L.query(
        [_RULE_ROWS],
        f"""SELECT {L.r6('quantile_cont(ari, 0.5)')} AS median_source_ari, {L.r6('quantile_cont(rec, 0.5)')} AS median_pair_recovery,
        {L.r6('quantile_cont(mar, 0.5)')} AS median_target_ari, bool_and(rec = 1.0) AS all_pairs_recovered, bool_and(ari >= 0.75) AS all_source_ari_ok FROM rr""",
    ),
)
def identifiability_summary(spark, sf):
    frame = _rule_rows(spark, sf).select(
        F.col("ari").alias("source_ari"), "pair_recovery", F.col("score_margin").alias("target_ari"), F.col("ari").alias("coverage")
    )
    report = G.identifiability_summary(frame)
    return report.select(
        *[r6(c).alias(c) for c in ("median_source_ari", "median_pair_recovery", "median_target_ari")],
        "all_pairs_recovered", "all_source_ari_ok",
    )


# ---------------------------------------------------------------- integrity


@register(
    "measurement_violations",
    """WITH m AS (SELECT l_orderkey::varchar AS sample_id, l_linenumber::varchar AS feature_id FROM lineitem)
       SELECT violation, count(*)::bigint AS n FROM (SELECT 'repeated cell' AS violation FROM m GROUP BY sample_id, feature_id HAVING count(*) > 1) GROUP BY ALL""",
)
def measurement_violations(spark, sf):
    """Order lines as cells: several lines of one order share a line number, which the contract forbids."""
    cells = I.table(spark, sf, "lineitem").select(
        F.lit("lines").alias("dataset_id"), F.col("l_orderkey").cast("string").alias("sample_id"),
        F.col("l_linenumber").cast("string").alias("feature_id"), F.col("l_quantity").alias("value"),
    )
    return V.measurement_violations(cells).groupBy("violation").agg(n(F.count(F.lit(1))).alias("n"))


@register(
    "sample_differences",
    """SELECT 'left' AS side, count(*)::bigint AS n FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
       UNION ALL SELECT 'right', count(*) FROM (SELECT DISTINCT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) HAVING count(*) > 0""",
)
def sample_differences(spark, sf):
    left = I.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    right = I.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    return V.sample_differences(left, right).groupBy("side").agg(n(F.count(F.lit(1))).alias("n"))


_LINE = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
_FINGER = "concat_ws('|', " + ", ".join(f"coalesce('v' || {c}::varchar, 'n')" for c in _LINE) + ")"


@register(
    "fingerprints",
    f"""WITH h AS (SELECT l_returnflag, md5({_FINGER}) AS h FROM lineitem)
        SELECT l_returnflag, count(*)::bigint AS n_rows, sum(('0x' || substr(h, 1, 13))::bigint)::varchar || '-' || sum(('0x' || substr(h, 14, 13))::bigint)::varchar AS fingerprint
        FROM h GROUP BY l_returnflag""",
)
def fingerprints(spark, sf):
    found = V.fingerprint(I.table(spark, sf, "lineitem"), ["l_returnflag"], list(_LINE))
    return found.select("l_returnflag", n("n_rows").alias("n_rows"), "fingerprint")


@register(
    "artifact_differences",
    """SELECT status, count(*)::bigint AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'missing right' WHEN a.doc_id IS NULL THEN 'missing left'
         WHEN a.h IS DISTINCT FROM b.h THEN 'different' END AS status
       FROM (SELECT doc_id, quality::varchar AS h FROM labels) a FULL JOIN (SELECT doc_id, (n_chars % 2)::varchar AS h FROM documents) b ON a.doc_id = b.doc_id)
       WHERE status IS NOT NULL GROUP BY status""",
)
def artifact_differences(spark, sf):
    """Two keyed tables compared like two sets of (path, hash)."""
    left = I.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("h"))
    right = I.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("string").alias("h"))
    return V.table_differences(left, right, ["doc_id"], "h").groupBy("status").agg(n(F.count(F.lit(1))).alias("n"))


@register(
    "unfinished_runs",
    "SELECT o_orderkey::varchar AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def unfinished_runs(spark, sf):
    expected = I.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"))
    done = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"))
    return V.unfinished(expected, done, ["run_id"])


@register(
    "record_problems",
    """SELECT problem, count(*)::bigint AS n FROM (
         SELECT 'checksum' AS problem FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE md5(o_orderstatus) IS DISTINCT FROM md5(substr(c_mktsegment, 1, 1))
         UNION ALL SELECT 'schema' FROM orders WHERE o_orderstatus <> 'F'
         UNION ALL SELECT 'runtime' FROM orders WHERE o_totalprice - 1000 < 0) GROUP BY problem""",
)
def record_problems(spark, sf):
    orders = I.table(spark, sf, "orders")
    done = orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("schema_tag"),
        F.md5("o_orderstatus").alias("sha256"), (F.col("o_totalprice") - 1000).alias("seconds"),
    )
    inventory = orders.join(I.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.md5(F.substring("c_mktsegment", 1, 1)).alias("sha256")
    )
    return V.record_problems(done, inventory, "F").groupBy("problem").agg(n(F.count(F.lit(1))).alias("n"))


@register(
    "stale_reports",
    """SELECT user_id::varchar AS report_id, CASE WHEN bool_or(event_type = 'error' AND value > 250) THEN 'config' ELSE 'samples' END AS reason
       FROM events GROUP BY user_id HAVING bool_or(event_type = 'error' AND value > 250) OR count(DISTINCT dayofweek(ts)) <> 7""",
)
def stale_reports(spark, sf):
    events = I.table(spark, sf, "events")
    reports = events.select(
        F.col("user_id").cast("string").alias("report_id"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 250), "other").otherwise("current").alias("config_sha"),
        F.dayofweek("ts").cast("string").alias("sample_id"),
    )
    expected = reports.select("report_id").distinct().withColumn("n_samples", F.lit(7).cast("bigint"))
    return V.stale_reports(reports, "current", expected)


@register(
    "recomputed_differences",
    """SELECT 'recomputed only' AS side, count(*)::bigint AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)""",
)
def recomputed_differences(spark, sf):
    """A stored summary that lost the groups with a large sum, against its recomputation from detail."""
    lines = I.table(spark, sf, "lineitem")
    again = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    stored = again.where("total <= 200")
    return V.recomputed_differences(stored, again).groupBy("side").agg(n(F.count(F.lit(1))).alias("n"))


@register(
    "wrong_claims",
    """SELECT count(*)::bigint AS n, status FROM (SELECT CASE WHEN b.m IS NULL THEN 'missing right' WHEN a.m IS NULL THEN 'missing left' WHEN a.v IS DISTINCT FROM b.v THEN 'different' END AS status
       FROM (SELECT p_partkey AS m, p_size AS v FROM part) a FULL JOIN (SELECT l_partkey AS m, max(l_quantity)::int AS v FROM lineitem GROUP BY ALL) b ON a.m = b.m)
       WHERE status IS NOT NULL GROUP BY status""",
)
def wrong_claims(spark, sf):
    claims = I.table(spark, sf, "part").select(F.col("p_partkey").alias("metric"), F.col("p_size").alias("value"))
    evidence = I.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("metric")).agg(
        F.max("l_quantity").cast("int").alias("value")
    )
    return V.wrong_claims(claims, evidence).groupBy("status").agg(n(F.count(F.lit(1))).alias("n"))


@register(
    "label_alignment",
    "SELECT 'no label' AS problem, count(*)::bigint AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def label_alignment(spark, sf):
    samples = I.table(spark, sf, "documents").select(
        F.lit("documents").alias("dataset_id"), F.col("doc_id").cast("string").alias("sample_id")
    )
    labels = I.table(spark, sf, "labels").select(
        F.lit("documents").alias("dataset_id"), F.col("doc_id").cast("string").alias("sample_id")
    )
    return SL.align_labels(labels, samples).groupBy("problem").agg(n(F.count(F.lit(1))).alias("n"))


# ---------------------------------------------------------------- exports


@register(
    "assignment_export",
    """SELECT source AS dataset_id, doc_id::varchar AS sample_id, CASE WHEN source IN (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND n_chars > 5000)
       THEN (n_chars % 3)::varchar ELSE 'UNASSIGNED' END AS cluster FROM documents""",
)
def assignment_export(spark, sf):
    """Documents of a source with a long German text are assigned, the other sources abstain."""
    documents = I.table(spark, sf, "documents")
    rows = documents.select(
        F.col("source").alias("dataset_id"), F.lit("V_EUC_PAM").alias("method_id"),
        F.col("doc_id").cast("string").alias("sample_id"), (F.col("n_chars") % 3).cast("int").alias("cluster"),
    )
    long_german = (F.col("lang") == "de") & (F.col("n_chars") > 5000)
    selection = documents.groupBy(F.col("source").alias("dataset_id")).agg(
        F.max(F.when(long_german, "V_EUC_PAM")).alias("selected_method")
    )
    return ST.assignment_export(rows, rows, selection)


@register(
    "assignment_payload",
    """SELECT o_orderstatus AS dataset_id, substr(o_orderpriority, 1, 1) AS method_id, count(*)::bigint AS n_assignments, sum(o_custkey % 3)::bigint AS cluster_total
       FROM orders GROUP BY ALL""",
)
def assignment_payload(spark, sf):
    rows = I.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("dataset_id"), F.substring("o_orderpriority", 1, 1).alias("method_id"),
        F.col("o_orderkey").cast("string").alias("sample_id"), (F.col("o_custkey") % 3).cast("int").alias("cluster"),
    )
    parts = ST.assignment_payload(rows)
    total = F.aggregate("assignments", F.lit(0).cast("bigint"), lambda acc, a: acc + a["cluster"])
    return parts.groupBy("dataset_id", "method_id").agg(
        n(F.sum(F.size("assignments"))).alias("n_assignments"), n(F.sum(total)).alias("cluster_total")
    )


@register("alpha_grid", "SELECT DISTINCT l_tax + 0.0 AS alpha, format('H_EUC_PAIR_A{:03d}_PAM', round(l_tax * 100)::int) AS method_id FROM lineitem")
def alpha_grid(spark, sf):
    taxes = I.table(spark, sf, "lineitem").select(F.col("l_tax").alias("alpha")).distinct()
    return taxes.select((F.col("alpha") + 0.0).alias("alpha"), X.hybrid_method_of(F.col("alpha")).alias("method_id"))
