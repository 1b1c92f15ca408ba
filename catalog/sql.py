"""SQL building blocks (common table expressions) used by the comparison texts."""

from __future__ import annotations

M1 = """m1 AS (
  SELECT 'embeddings' AS dataset_id, lpad(vec_id::varchar, 20, '0') AS sample_id,
         format('f{:03d}', pos) AS feature_id, v::double AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""

M2 = """m2 AS (
  SELECT 'events' AS dataset_id, lpad(user_id::varchar, 20, '0') AS sample_id,
         event_type || '_' || dayofweek(ts)::varchar AS feature_id, quantile_cont(value, 0.5) AS value
  FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type, dayofweek(ts))"""


def mean(column: str) -> str:
    return f"sum({column}::decimal(18,2))::double / count({column})"


M3 = f"""m3 AS (
  SELECT l_linestatus AS dataset_id, lpad(l_suppkey::varchar, 20, '0') AS sample_id,
         l_returnflag || '_' || measure AS feature_id, value
  FROM (SELECT l_suppkey, l_linestatus, l_returnflag, {mean('l_quantity')} AS quantity,
               {mean('l_extendedprice')} AS extendedprice, {mean('l_discount')} AS discount, {mean('l_tax')} AS tax
        FROM lineitem GROUP BY ALL)
  UNPIVOT (value FOR measure IN (quantity, extendedprice, discount, tax)))"""

MATRIX = {"m1": M1, "m2": M2, "m3": M3}


def matrix(m: str) -> list[str]:
    return [MATRIX[m]]


def stats(m: str) -> list[str]:
    """Feature statistics of a measurement table as ``stats`` and its grid as ``grid``."""
    return [
        f"samples AS (SELECT DISTINCT dataset_id, sample_id FROM {m})",
        f"""med AS (SELECT dataset_id, feature_id, quantile_cont(value, 0.5) AS median, count(value) AS n_observed
          FROM {m} WHERE value IS NOT NULL GROUP BY ALL)""",
        f"""madt AS (SELECT dataset_id, feature_id, quantile_cont(abs(value - median), 0.5) AS mad
          FROM {m} JOIN med USING (dataset_id, feature_id) WHERE value IS NOT NULL GROUP BY ALL)""",
        f"""grid AS (SELECT s.dataset_id, s.sample_id, f.feature_id, f.median, x.value
          FROM samples s JOIN med f USING (dataset_id)
          LEFT JOIN {m} x ON x.dataset_id = s.dataset_id AND x.sample_id = s.sample_id AND x.feature_id = f.feature_id)""",
        """iqrt AS (SELECT dataset_id, feature_id,
            quantile_cont(coalesce(value, median), 0.75) - quantile_cont(coalesce(value, median), 0.25) AS iqr
          FROM grid GROUP BY ALL)""",
        """stats AS (SELECT dataset_id, feature_id, median, mad, iqr,
            CASE WHEN iqr <= 0 THEN 1.0 ELSE iqr END AS scale, iqr <= 0 AS iqr_fallback, n_observed
          FROM med JOIN madt USING (dataset_id, feature_id) JOIN iqrt USING (dataset_id, feature_id))""",
    ]


def selected(m: str, budget: int | None) -> list[str]:
    kept = "" if budget is None else f" WHERE feature_rank <= {budget}"
    return stats(m) + [
        f"""sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
            ORDER BY mad DESC, feature_id) AS feature_rank FROM stats){kept})"""
    ]


def scaled(m: str, budget: int | None) -> list[str]:
    """``zed``: imputed and scaled values of the selected (without a budget: all) features, ``raw`` NULL where missing."""
    return selected(m, budget) + [
        """zed AS (SELECT g.dataset_id, g.sample_id, s.feature_rank, g.feature_id, g.value AS raw,
            (coalesce(g.value, s.median) - s.median) / s.scale AS z
          FROM grid g JOIN sel s USING (dataset_id, feature_id))"""
    ]


def ranked(source: str = "zed", value: str = "raw", out: str = "ranks", extra: str = "") -> list[str]:
    """Normalised average ranks of the observed cells of each sample."""
    part = f"dataset_id, sample_id{extra}"
    return [
        f"""{out} AS (SELECT {part}, feature_id,
            (rank() OVER (PARTITION BY {part} ORDER BY {value}) - 1
             + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)
            / greatest(count(*) OVER (PARTITION BY {part}) - 1, 1) AS q
          FROM {source} WHERE {value} IS NOT NULL)"""
    ]


def pairs() -> list[str]:
    return [
        """pairs AS (SELECT a.dataset_id, a.feature_id AS "left", b.feature_id AS "right"
          FROM sel a JOIN sel b ON a.dataset_id = b.dataset_id AND a.feature_id < b.feature_id)"""
    ]


def states(ranks: str = "ranks", out: str = "states", extra: str = "", margin: float = 0.0) -> list[str]:
    """Ternary state of every sample (and ``extra`` key) and pair; missing where an end is missing."""
    cols = "".join(f", a.{c.strip()}" for c in extra.split(",") if c.strip())
    same = "".join(f" AND b.{c.strip()} = a.{c.strip()}" for c in extra.split(",") if c.strip())
    return [
        f"""{out} AS (SELECT a.dataset_id, a.sample_id{cols}, p."left", p."right",
            CASE WHEN a.q - b.q > {margin} THEN 1 WHEN a.q - b.q < -{margin} THEN -1 ELSE 0 END AS state
          FROM pairs p JOIN {ranks} a ON a.dataset_id = p.dataset_id AND a.feature_id = p."left"
          JOIN {ranks} b ON b.dataset_id = p.dataset_id AND b.sample_id = a.sample_id
            AND b.feature_id = p."right"{same})"""
    ]


def u01(*parts: str) -> str:
    """Seeded uniform draw, the same number as the Spark expression."""
    text = "concat_ws('|', " + ", ".join(f"({p})::varchar" for p in parts) + ")"
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint / 4503599627370496.0)"


def normal(*parts: str) -> str:
    u = u01("'r'", *parts)
    v = u01("'t'", *parts)
    return f"(sqrt(-2.0 * ln(greatest({u}, 1.0 / 4503599627370496.0))) * cos(2.0 * pi() * {v}))"


def perturbed(source: str, specs: list[tuple[int, str, float]], seed: int, out: str = "moved") -> list[str]:
    """Perturbed copies of ``source``; scales are IQRs over its observed values."""
    rows = ", ".join(f"({rep}, '{kind}', {strength}::double)" for rep, kind, strength in specs)
    s = str(seed)
    gamma = f"least(greatest(1.0 + strength * {normal(s, 'rep', chr(39) + 'gamma' + chr(39), 'sample_id')}, 0.75), 1.25)"
    offset = normal(s, "rep", "'offset'", "feature_id")
    noise = normal(s, "rep", "'noise'", "sample_id", "feature_id")
    drop = u01(s, "rep", "'drop'", "sample_id", "feature_id")
    return [
        f"""{out}_scales AS (SELECT dataset_id, feature_id,
            CASE WHEN count(value) >= 2 AND quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 0
                 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1.0 END AS scale
          FROM {source} GROUP BY ALL)""",
        f"""{out} AS (SELECT dataset_id, rep, kind, sample_id, feature_id,
            CASE kind
              WHEN 'sample_monotone' THEN sign(value) * pow(abs(value), {gamma})
              WHEN 'gene_offset' THEN value + strength * scale * {offset}
              WHEN 'additive_noise' THEN value + strength * scale * {noise}
              WHEN 'feature_dropout' THEN CASE WHEN {drop} >= strength THEN value END
              WHEN 'quantization' THEN round_even(value / greatest(strength * scale, 2.220446049250313e-16), 0)::double
                   * greatest(strength * scale, 2.220446049250313e-16)
            END AS value
          FROM {source} JOIN {out}_scales USING (dataset_id, feature_id),
               (VALUES {rows}) AS spec(rep, kind, strength))""",
    ]


def query(parts: list[str], body: str) -> str:
    """``WITH`` chain without repeated names."""
    seen, kept = set(), []
    for part in parts:
        name = part.split(" AS", 1)[0].strip()
        if name not in seen:
            seen.add(name)
            kept.append(part)
    return "WITH " + ",\n".join(kept) + "\n" + body


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


TRADE = """trade AS (
  SELECT lpad(s_nationkey::varchar, 2, '0') AS i, lpad(c_nationkey::varchar, 2, '0') AS j,
         sum(l_extendedprice::decimal(18,2))::double / count(l_extendedprice) AS price,
         sum(l_quantity::decimal(18,2))::double / count(l_quantity) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, c_nationkey)"""


def trade_edges(column: str, out: str) -> list[str]:
    return [
        TRADE,
        f"""{out} AS (SELECT least(i, j) AS i, greatest(i, j) AS j, greatest(avg({column}), 0.0) AS d
          FROM trade WHERE i <> j GROUP BY ALL)""",
    ]


def rand_index(table: str, keys: str, out: str = "ari") -> list[str]:
    """Adjusted Rand index of a contingency table ``keys, truth, predicted, n`` as ``{out}_t``."""
    k = keys + "," if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    c2 = "sum(n::double * (n - 1) / 2)"
    return [
        f"{out}_ij AS (SELECT {k} {c2} AS ij, sum(n) AS total FROM {table} {group})",
        f"{out}_a AS (SELECT {k} {c2} AS a FROM (SELECT {k} truth, sum(n) AS n FROM {table} GROUP BY ALL) {group})",
        f"{out}_b AS (SELECT {k} {c2} AS b FROM (SELECT {k} predicted, sum(n) AS n FROM {table} GROUP BY ALL) {group})",
        f"""{out}_t AS (SELECT {k} total AS n_samples, CASE WHEN ij = a AND ij = b THEN 1.0
            ELSE (ij - a * b / (total::double * (total - 1) / 2)) / ((a + b) / 2 - a * b / (total::double * (total - 1) / 2)) END AS {out}
          FROM {out}_ij JOIN {out}_a {using} JOIN {out}_b {using})""",
    ]
