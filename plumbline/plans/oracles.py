"""ANSI SQL that computes the registered queries' rows in another engine."""

from __future__ import annotations

LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
LABELLED_TYPES = {"doc_id": "numeric", "text": "categorical", "lang": "categorical", "source": "categorical",
                  "n_chars": "numeric", "quality": "numeric", "toxic": "numeric"}
LINE_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
              "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
              "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _class(dtype: str) -> str:
    return {"string": "categorical", "timestamp_ntz": "datetime"}.get(dtype, "numeric")


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _tall(table: str, cols: list[str], cast: str = "DOUBLE", extra: str = "") -> str:
    """(col, v) rows of several columns."""
    return "(" + _union([f"SELECT {extra}'{c}' AS col, {c}::{cast} AS v FROM {table}" for c in cols]) + ")"


EVENT_IDX = "(SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events)"
MONTHLY = ("(SELECT date_trunc('month', o_orderdate) AS ts, sum(o_totalprice) AS total, count(*) AS n "
           "FROM orders GROUP BY 1)")


def _phi(z: str) -> str:
    """Normal distribution function by its series around 0."""
    x = f"least(abs({z}), 8.0)"
    terms = f"list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln({x}) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    return f"(0.5 + sign({z}) * CASE WHEN {z} = 0 THEN 0 ELSE exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {terms} END)"


def _lilliefors(table: str, cols: list[str]) -> str:
    """Largest gap to the normal with the column's own mean and deviation, and its p-value."""
    return f"""WITH tall AS (SELECT * FROM {_tall(table, cols)} WHERE v IS NOT NULL),
m AS (SELECT col, count(*)::DOUBLE AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM tall GROUP BY col),
c AS (SELECT col, v, count(*) AS k FROM tall GROUP BY col, v),
r AS (SELECT col, v, k, sum(k) OVER (PARTITION BY col ORDER BY v) AS upto FROM c),
g AS (SELECT col, n, greatest(upto / n - share, share - (upto - k) / n) AS gap
  FROM (SELECT col, n, upto, k, {_phi("z")} AS share FROM (SELECT r.*, n, (v - mean) / sd AS z FROM r JOIN m USING (col)))),
s AS (SELECT col, n, max(gap) AS d, least(n, 100) AS size, max(gap) * pow(greatest(n / 100, 1), 0.49) AS scaled,
  (sqrt(n) - 0.01 + 0.85 / sqrt(n)) * max(gap) AS k FROM g GROUP BY col, n),
p AS (SELECT *, exp(-7.01256 * scaled * scaled * (size + 2.78019) + 2.99587 * scaled * sqrt(size + 2.78019) - 0.122119
  + 0.974598 / sqrt(size) + 1.67997 / size) AS small FROM s)
SELECT col AS "column", n::BIGINT AS n, round(d, 6) AS statistic, round(CASE WHEN small <= 0.1 THEN small WHEN k <= 0.302 THEN 1
  WHEN k <= 0.5 THEN 2.76773 - 19.828315 * k + 80.709644 * k * k - 138.55152 * k ** 3 + 81.218052 * k ** 4
  WHEN k <= 0.9 THEN -4.901232 + 40.662806 * k - 97.490286 * k * k + 94.029866 * k ** 3 - 32.355711 * k ** 4
  WHEN k <= 1.31 THEN 6.198765 - 19.558097 * k + 23.186922 * k * k - 12.234627 * k ** 3 + 2.423045 * k ** 4 ELSE 0 END, 6)::DOUBLE AS p_value FROM p"""


def _told(sections: dict[str, tuple[str, str, str, str]]) -> str:
    """Sections (SQL, names of numbers, texts, flags) told column by column: rows with a value, and their sum or different values."""
    parts = []
    for name, (sql, numbers, texts, flags) in sections.items():
        fields = [(c, f'round(sum("{c}"::DOUBLE), 2)') for c in numbers.split()]
        fields += [(c, f'count(DISTINCT "{c}")::DOUBLE') for c in (texts + " " + flags).split()]
        listed = ", ".join(f"""{{'field': '{c}', 'n': count("{c}"), 'total': {total}}}""" for c, total in fields)
        parts.append(f"SELECT '{name}' AS section, u.field AS field, u.n AS n, u.total AS total FROM (SELECT unnest(l) AS u FROM (SELECT [{listed}] AS l FROM ({sql})))")
    return _union(parts)


def _steps() -> str:
    return f"""s AS (SELECT idx, ts, value - lag(value) OVER (ORDER BY idx) AS step FROM {EVENT_IDX}),
u AS (SELECT avg(step) AS m, stddev_pop(step) AS sd FROM s),
c AS (SELECT s.idx, s.ts, s.step FROM s, u WHERE abs(step - m) > m + 2.0 * sd)"""


def _decompose(rows: str, period: int, ratio: bool, series: str) -> str:
    """WITH part of a classical decomposition of (idx, ts, value) rows with an even period."""
    h, op = period // 2, "/" if ratio else "-"
    return f"""r AS {rows},
f AS (SELECT *, sum(value) OVER w AS total, count(*) OVER w AS held,
        lag(value, {h}) OVER (ORDER BY idx) AS a, lead(value, {h}) OVER (ORDER BY idx) AS b FROM r
      WINDOW w AS (ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
t AS (SELECT idx, ts, value, idx % {period} AS phase,
        CASE WHEN held = {period + 1} THEN (total - (a + b) / 2) / {period} END AS trend FROM f),
p AS (SELECT phase, avg(value {op} trend) AS raw FROM t WHERE trend IS NOT NULL GROUP BY phase),
q AS (SELECT phase, raw {op} (SELECT avg(raw) FROM p) AS seasonal FROM p),
o AS (SELECT '{series}' AS series, '{"multiplicative" if ratio else "additive"}' AS method, idx, ts, value, trend,
        seasonal, value {op} seasonal {op} trend AS residual FROM t JOIN q USING (phase))"""


def _flags(table: str, cols: list[str], key: str = "") -> str:
    """WITH part: per-column statistics ``st`` and flagged long rows ``fl``."""
    extra = f"{key}, " if key else ""
    return f"""tall AS (SELECT * FROM {_tall(table, cols, extra=extra)} WHERE v IS NOT NULL),
st0 AS (SELECT col, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1,
          quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3, min(v) AS lo, max(v) AS hi FROM tall GROUP BY col),
st AS (SELECT st0.*, d.mad FROM st0 JOIN (
          SELECT col, quantile_cont(abs(v - med), 0.5) AS mad FROM tall JOIN st0 USING (col) GROUP BY col) d USING (col)),
fl AS (SELECT tall.*, v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS iqr,
          CASE WHEN sd > 0 THEN abs((v - mean) / sd) > 3.0 ELSE false END AS zscore,
          CASE WHEN mad > 0 THEN abs(0.6745 * (v - med) / mad) > 3.5 ELSE false END AS mad
        FROM tall JOIN st USING (col))"""


def _auto_bins(table: str, cols: list[tuple[str, bool]]) -> str:
    parts = []
    for c, whole in cols:
        floor = "greatest(w, 1.0)" if whole else "w"
        parts.append(f"""SELECT '{c}' AS "column", bin::BIGINT AS bin, n_bins::BIGINT AS n_bins, round(lo + bin * w2, 6) AS lo,
  round(lo + (bin + 1) * w2, 6) AS hi, count(*) AS count FROM (
  SELECT least(floor(({c} - lo) / w2), n_bins - 1) AS bin, n_bins, lo, w2 FROM {table}, (
    SELECT lo, ceil((hi - lo) / {floor}) AS n_bins, (hi - lo) / ceil((hi - lo) / {floor}) AS w2 FROM (
      SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
        least(greatest(2 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) * pow(count(*), -1.0 / 3),
                       (max({c}) - min({c})) / sqrt(count(*)) / 2),
              (max({c}) - min({c})) / (log2(count(*)) + 1)) AS w FROM {table})))
GROUP BY bin, n_bins, lo, w2""")
    return _union(parts)


def _moments(table: str, pairs: list[tuple[str, str]]) -> str:
    return "(" + _union([f"SELECT '{c}' AS cat, {c}::VARCHAR AS level, '{x}' AS num, count({x}) AS n, avg({x}) AS m, "
                         f"var_samp({x}) AS v FROM {table} WHERE {c} IS NOT NULL AND {x} IS NOT NULL GROUP BY {c}"
                         for c, x in pairs]) + ")"


def _verdict(p: str, digits: int) -> str:
    return f"round({p}, {digits})::DOUBLE AS p_value, {p} < 0.05 AS significant, 0.05::DOUBLE AS alpha"


def _rank_sum(table: str, cat: str, num: str, g1: str, g2: str, digits: int = 5) -> str:
    """The normal p-value: for groups that are large or have ties."""
    return f"""SELECT cat, num, group1, group2, n_g1, n_g2, round(statistic, {digits}) AS statistic, round(tie_term, {digits}) AS tie_term, round(z, {digits}) AS z,
  {_verdict(f'least(1.0, 2 * (1 - {_phi("z")}))', digits)}
FROM (SELECT '{cat}' AS cat, '{num}' AS num, '{g1}' AS group1, '{g2}' AS group2, n1 AS n_g1, n2 AS n_g2, u AS statistic, tie AS tie_term,
  (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5)
        / sqrt(n1::DOUBLE * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z
FROM (SELECT count(*) FILTER (g = '{g1}') AS n1, count(*) FILTER (g = '{g2}') AS n2,
        sum(CASE WHEN g = '{g1}' THEN mid ELSE 0.0 END)
          - count(*) FILTER (g = '{g1}')::DOUBLE * (count(*) FILTER (g = '{g1}') + 1) / 2 AS u,
        sum((t::DOUBLE * t * t - t) / t) AS tie
      FROM (SELECT {cat} AS g, count(*) OVER (PARTITION BY {num}) AS t,
              rank() OVER (ORDER BY {num}) + (count(*) OVER (PARTITION BY {num}) - 1) / 2.0::DOUBLE AS mid
            FROM {table} WHERE {cat} IN ('{g1}', '{g2}'))))"""


def _welch(table: str, pairs: list[tuple[str, str]], digits: int = 5) -> str:
    """p by Simpson's rule over the t density from 0 to the statistic."""
    steps = 2000
    area = (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(1 + pow(i * h, 2) / v, -(v + 1) / 2))) * h / 3 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi())")
    return f"""SELECT cat, num, group1, group2, n_g1, n_g2, round(s, {digits}) AS statistic, round(v, {digits}) AS df, {_verdict("p", digits)}
FROM (SELECT *, greatest(1 - 2 * {area}, 0) AS p FROM (SELECT *, least(abs(s), 40.0) / {steps} AS h FROM (
  SELECT a.cat, a.num, a.level AS group1, b.level AS group2, a.n AS n_g1, b.n AS n_g2, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS s,
    (a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) AS v
  FROM {_moments(table, pairs)} a JOIN {_moments(table, pairs)} b ON a.cat = b.cat AND a.num = b.num AND a.level < b.level
  WHERE (SELECT count(DISTINCT level) FROM {_moments(table, pairs)} c WHERE c.cat = a.cat AND c.num = a.num) = 2)))"""


def _f_test(table: str, pairs: list[tuple[str, str]], digits: int = 5) -> str:
    """p in closed form: an even number of groups less one by the finite sum, one by the t density."""
    x = "(d2 / (d2 + d1 * f))"
    steps = 2000
    area = (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(1 + pow(i * h, 2) / d2, -(d2 + 1) / 2))) * h / 3 * exp(lgamma((d2 + 1) / 2) - lgamma(d2 / 2)) / sqrt(d2 * pi())")
    whole = (f"pow({x}, d2 / 2) * list_sum(list_transform(range(0, (d1 / 2)::BIGINT), lambda i: "
             f"exp(lgamma(d2 / 2 + i) - lgamma(d2 / 2) - lgamma(i + 1)) * pow(1 - {x}, i)))")
    return f"""SELECT cat, num, k AS n_groups, total AS n_total, round(f, {digits}) AS statistic, k - 1 AS df1, total - k AS df2, {_verdict("p", digits)}
FROM (SELECT *, CASE WHEN d1 = 1 THEN greatest(1 - 2 * {area}, 0) ELSE {whole} END AS p FROM (SELECT *, least(sqrt(f), 40.0) / {steps} AS h FROM (
  SELECT cat, num, k, total, (k - 1)::DOUBLE AS d1, (total - k)::DOUBLE AS d2,
    (sum(n * (m - grand) * (m - grand)) / (k - 1)) / (sum((n - 1) * v) / (total - k)) AS f
  FROM {_moments(table, pairs)} g JOIN (SELECT cat, num, count(*) AS k, sum(n)::BIGINT AS total, sum(n * m) / sum(n) AS grand
    FROM {_moments(table, pairs)} GROUP BY cat, num) gm USING (cat, num) GROUP BY cat, num, k, total)))"""


def _chi_result(table: str, a: str, b: str, yates: bool, digits: int = 6) -> str:
    """p in closed form for one degree of freedom and for even numbers of them."""
    p = (f"CASE WHEN df = 1 THEN 2 * (1 - {_phi('sqrt(statistic)')}) ELSE exp(-statistic / 2) * "
         "list_sum(list_transform(range(0, (df / 2)::BIGINT), lambda i: pow(statistic / 2, i) / exp(lgamma(i + 1)))) END")
    return f"""SELECT cat1, cat2, n_rows, n_cols, n_total, round(statistic, {digits}) AS statistic, df, {_verdict("p", digits)}
FROM (WITH {_chi(table, a, b, yates)} SELECT *, {p} AS p FROM res)"""


def _tests_table(parts: dict[str, str]) -> str:
    """One line per test of several kinds."""
    names = {"chi2": ("cat1", "cat2")}
    return _union([f"SELECT '{kind}' AS test, {names.get(kind, ('cat', 'num'))[0]} AS var1, {names.get(kind, ('cat', 'num'))[1]} AS var2, "
                   f"statistic, p_value, significant FROM ({sql})" for kind, sql in parts.items()])


def _chi(table: str, a: str, b: str, yates: bool) -> str:
    miss = "greatest(abs(n - e) - 0.5, 0)" if yates else "(n - e)"
    return f"""cells AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(n)::DOUBLE AS r FROM cells GROUP BY a), cb AS (SELECT b, sum(n)::DOUBLE AS c FROM cells GROUP BY b),
tot AS (SELECT sum(n)::DOUBLE AS total FROM cells),
full_table AS (SELECT coalesce(n, 0) AS n, r * c / total AS e FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN cells USING (a, b)),
x AS (SELECT sum({miss} * {miss} / e) AS statistic FROM full_table),
res AS (SELECT '{a}' AS cat1, '{b}' AS cat2, (SELECT count(*) FROM ra) AS n_rows, (SELECT count(*) FROM cb) AS n_cols,
  (SELECT total FROM tot)::BIGINT AS n_total, statistic,
  ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS df FROM x)"""


def _classes(table: str, types: dict[str, tuple[str, str]]) -> str:
    return _union([f"""SELECT '{c}' AS "column", '{t}' AS type_category, '{p}' AS selector,
  count({c}) AS non_null_count FROM {table}""" for c, (t, p) in types.items()])


def _info(table: str, types: dict[str, tuple[str, str]]) -> str:
    return _union([f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{k}' AS type_category, count(DISTINCT {c}) AS n_unique,
  count(*) - count({c}) AS n_missing, round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percent,
  count(DISTINCT {c}) <= 1 AS is_constant FROM {table}""" for c, (t, k) in types.items()])


def registry() -> dict[str, str]:
    q: dict[str, str] = {}
    lab_cols = list(LABELLED_TYPES)

    q["csv_round_trip"] = f"SELECT doc_id, text, lang, source, n_chars, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM {LABELLED}"
    q["table_guard"] = "SELECT count(*) AS n_rows FROM lineitem"
    q["column_types"] = _classes("lineitem", {c: (_class(t), _class(t)) for c, t in LINE_TYPES.items()})
    q["column_types_bool"] = _classes(
        f"(SELECT doc_id, lang, quality = 1 AS good FROM {LABELLED})",
        {"doc_id": ("numeric", "numeric"), "lang": ("categorical", "categorical"), "good": ("numeric", "categorical")})
    q["missing_values"] = "SELECT * FROM (" + _union([
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
  round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percent FROM {LABELLED}""" for c in lab_cols
    ]) + ") WHERE missing_count > 0"
    misses = " + ".join(f"(count(*) - count({c}))" for c in lab_cols)
    q["table_summary"] = f"""SELECT count(*) AS n_rows, 7::BIGINT AS n_cols, 4::BIGINT AS n_numeric, 3::BIGINT AS n_categorical,
  0::BIGINT AS n_datetime, ({misses})::BIGINT AS total_missing,
  round_even(100.0 * ({misses}) / (count(*) * 7), 2) AS missing_percent FROM {LABELLED}"""
    names = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
             "quality": "int", "toxic": "int"}
    q["column_info"] = _info(LABELLED, {c: (names[c], LABELLED_TYPES[c]) for c in lab_cols})
    q["column_info_lineitem"] = _info("lineitem", {c: (t, _class(t)) for c, t in LINE_TYPES.items()})

    q["quality_completeness"] = _union([f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
  round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percentage, count({c}) AS complete_count,
  round(100.0 - 100.0 * ({misses}) / (count(*) * 7), 6) AS overall_completeness FROM {LABELLED}""" for c in lab_cols])
    q["quality_consistency"] = _union([f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values,
  count(*) - count(DISTINCT {c}) AS duplicate_count,
  round(100.0 * (count(*) - count(DISTINCT {c})) / count(*), 6) AS duplicate_percentage FROM {LABELLED}""" for c in lab_cols])
    broken = {
        "l_quantity": [("l_quantity < 3", " values below minimum 3"), ("l_quantity > 45", " values above maximum 45")],
        "l_extendedprice": [("l_extendedprice < 2000", " values below minimum 2000.0")],
        "l_returnflag": [("l_returnflag NOT IN ('A', 'N')", " values outside the allowed set")]}
    parts = []
    for c in LINE_TYPES:
        checks = broken.get(c, [])
        bad = " OR ".join(t for t, _ in checks) or "false"
        total = " + ".join(f"count(*) FILTER ({t})" for t, _ in checks) or "0"
        notes = ", ".join(f"CASE WHEN count(*) FILTER ({t}) > 0 THEN count(*) FILTER ({t}) || '{m}' END" for t, m in checks)
        parts.append(f"""SELECT '{c}' AS "column", count(*) FILTER (NOT ({bad})) AS valid_count, ({total})::BIGINT AS invalid_count,
  {f"concat_ws('; ', {notes})" if checks else "''"} AS issues FROM lineitem""")
    q["quality_validity"] = _union(parts)

    def field(name: str, kind: str, required: bool, wrong: str) -> str:
        miss = f"(count(*) - count({name}))"
        short = f"{miss} > 0" if required else "false"
        return f"""SELECT '{name}' AS field, '{kind}' AS type_expected,
  CASE WHEN {short} OR {wrong} > 0 THEN 'WARN' ELSE 'OK' END AS status,
  concat_ws('; ', CASE WHEN {short} THEN printf('Missing values: %d (%.2f%%)', {miss}, 100.0::DOUBLE * {miss} / count(*)) END,
    CASE WHEN {wrong} > 0 THEN printf('Type mismatch: %d values', {wrong}) END) AS issues,
  {miss} AS null_count, round(100.0 * {miss} / count(*), 4) AS null_percentage, count({name}) AS non_null_count FROM {LABELLED}"""

    q["quality_check_fields"] = _union([
        field("doc_id", "int", True, "0"), field("quality", "int", True, "0"), field("toxic", "float", False, "0"),
        field("lang", "int", True, "count(*) FILTER (lang IS NOT NULL AND try_cast(lang AS BIGINT) IS NULL)"),
        field("source", "str", True, "0"),
        "SELECT 'author', 'str', 'FAIL', 'Column ''author'' not found', NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT"])
    q["quality_type_compliance"] = """SELECT 'text' AS "column", 'datetime' AS type_expected, count(text) AS checked_count,
  CASE WHEN count(*) FILTER (try_cast(text AS TIMESTAMP) IS NULL) > 0 THEN count(text) ELSE 0 END AS mismatch_count FROM documents
UNION ALL SELECT 'url', 'int', count(url), count(*) FILTER (try_cast(url AS BIGINT) IS NULL) FROM pages"""
    kinds = ",".join(sorted(f"{c}={k}" for c, k in LABELLED_TYPES.items()))
    q["quality_data_summary"] = f"SELECT *, '{kinds}' AS column_types FROM ({q['table_summary']})"
    q["quality_report_header"] = """SELECT 'lineitem' AS dataset_name, count(*) AS total_rows, 11::BIGINT AS total_columns FROM lineitem"""
    q["quality_allowed_values"] = """SELECT c_mktsegment AS value, count(*) AS n FROM customer
WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1"""
    q["quality_allowed_values_lookup"] = """SELECT o_custkey AS value, count(*) AS n FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1"""
    q["quality_duplicate_records"] = """SELECT md5(text) AS text_md5, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1"""
    q["quality_issue_records"] = _union([f"""SELECT l_orderkey, l_linenumber, '{c}' AS "column", '{label}' AS issue, {text} AS value
FROM lineitem WHERE {cond}""" for c, label, text, cond in (
        ("l_quantity", "below minimum", "l_quantity::VARCHAR", "l_quantity < 3"),
        ("l_quantity", "above maximum", "l_quantity::VARCHAR", "l_quantity > 45"),
        ("l_extendedprice", "below minimum", "l_extendedprice::VARCHAR", "l_extendedprice < 2000"),
        ("l_returnflag", "not allowed", "l_returnflag", "l_returnflag NOT IN ('A', 'N')"))])
    q["quality_gates"] = _union([f"""SELECT '{c}' AS "column", round(m, 6) AS missing_rate, round(u, 6) AS unique_ratio,
  m <= 0.3 AS missing_ok, u >= 0.01 AND u <= 0.95 AS unique_ok FROM (
  SELECT (count(*) - count({c}))::DOUBLE / count(*) AS m, count(DISTINCT {c})::DOUBLE / count(*) AS u FROM {LABELLED})""" for c in lab_cols])

    def num_summary(table: str, cols: list[str]) -> str:
        return _union([f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
  round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS max, count(*) - count({c}) AS missing,
  round(round_even(100.0 * (count(*) - count({c})) / count(*), 2), 4) AS missing_percent FROM {table}""" for c in cols])

    q["dist_numeric_summary"] = num_summary("lineitem", LINE_NUMBERS)
    q["dist_numeric_summary_missing"] = num_summary(LABELLED, ["n_chars", "quality", "toxic"])
    freq = _union([f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count,
  round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM {LABELLED} GROUP BY {c}""" for c in ("lang", "source", "quality")])
    q["dist_frequencies"] = freq
    q["dist_modes"] = f"""SELECT "column", value AS top, count AS top_count,
  coalesce((SELECT count FROM ({freq}) n WHERE n."column" = f."column" AND n.value IS NULL), 0) AS missing,
  coalesce(round_even((SELECT 100.0 * n.count FROM ({freq}) n WHERE n."column" = f."column" AND n.value IS NULL)
    / (SELECT count(*) FROM documents), 2), 0.0) AS missing_percent
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS LAST) AS rn FROM ({freq})) f WHERE rn = 1"""
    q["dist_top_values"] = """SELECT "column", value, count, round(100.0 * count / (SELECT count(*) FROM part), 6) AS percent FROM (
  SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS count FROM part GROUP BY 2
  UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2) ORDER BY count DESC, "column", value NULLS LAST LIMIT 10"""
    q["dist_histogram"] = _auto_bins("events", [("value", False), ("user_id", True)])
    q["dist_density"] = """WITH s AS (SELECT count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events),
g AS (SELECT i, lo + i * ((hi - lo) / 199) AS x, sd * pow(n, -0.2) AS h, n FROM s, range(200) t(i))
SELECT 'value' AS "column", i AS point, round(x, 6) AS x,
  round(sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g, events GROUP BY i, x, h, n"""
    q["dist_box_stats"] = _union([f"""SELECT '{c}' AS "column", round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3,
  round(min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1))::DOUBLE, 4) AS whisker_low,
  round(max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1))::DOUBLE, 4) AS whisker_high,
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outside FROM events, (
  SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS md, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)
GROUP BY q1, md, q3""" for c in ("value", "user_id")])

    def jb(table: str, c: str) -> str:
        return f"""(SELECT n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM (
  SELECT count(*) AS n, avg(pow({c} - m, 2)) AS m2, avg(pow({c} - m, 3)) AS m3, avg(pow({c} - m, 4)) AS m4
  FROM {table}, (SELECT avg({c}) AS m FROM {table})))"""

    q["dist_shape"] = f"""SELECT 'value' AS "column", n, round(skew, 6) AS skewness, round(kurt, 6) AS kurtosis,
  round(exp(-n / 6.0 * (skew * skew + kurt * kurt / 4) / 2), 6) AS jarque_bera_p FROM {jb("events", "value")}"""
    q["dist_normality_jarque_bera"] = f"""SELECT 's_acctbal' AS "column", n, round(n / 6.0 * (skew * skew + kurt * kurt / 4), 6) AS jarque_bera,
  round(exp(-n / 6.0 * (skew * skew + kurt * kurt / 4) / 2), 6) AS jarque_bera_p FROM {jb("supplier", "s_acctbal")}"""
    q["dist_normality_ks"] = _lilliefors("events", ["value", "user_id"])
    q["dist_normality_ks_small"] = _lilliefors("supplier", ["s_acctbal"])
    q["dist_tails"] = _union([f"""SELECT '{c}' AS "column", count(*) AS n, """ + ", ".join(
        f"""round(p[{i}], 6) AS p{k}, round(count(*) FILTER ({c} {op} p[{i}]) / count(*)::DOUBLE, 6) AS share_beyond_p{k}"""
        for i, (k, op) in enumerate((("01", "<"), ("05", "<"), ("95", ">"), ("99", ">")), 1))
        + f""" FROM lineitem, (SELECT quantile_cont({c}, [0.01, 0.05, 0.95, 0.99]) AS p FROM lineitem) GROUP BY p""" for c in LINE_NUMBERS])

    ev = ["event_id", "user_id", "value"]

    def detected(cols_flags: str, method: str, extra: str) -> str:
        return f"""SELECT fl.col AS "column", {extra} FROM fl JOIN st ON fl.col = st.col GROUP BY ALL"""

    def outlier_rows(method: str) -> str:
        keep = {"iqr": ("q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)", "q1", "q3", "q3 - q1", "NULL", "NULL", "NULL", "NULL"),
                "zscore": ("NULL",) * 5 + ("mean", "sd", "NULL", "NULL"),
                "mad": ("NULL",) * 7 + ("med", "st.mad")}[method]
        cols = ", ".join(f"round(({e})::DOUBLE, 4) AS {k}" for e, k in zip(
            keep, ("lower", "upper", "q1", "q3", "iqr", "mean", "std", "median", "mad")))
        return f"""SELECT st.col AS "column", '{method}' AS method, st.n, hits AS outlier_count,
  round(100.0 * hits / st.n, 4) AS outlier_percentage, {cols}, NULL::VARCHAR AS note
FROM st JOIN (SELECT col, count(*) FILTER ({method}) AS hits FROM fl GROUP BY col) h USING (col)"""

    q["outliers_detect"] = f"WITH {_flags('events', ev)}\n" + _union([outlier_rows(m) for m in ("iqr", "zscore", "mad")])
    for m, keep in (("iqr", "lower, upper, q1, q3, iqr"), ("zscore", "mean, std"), ("mad", "median, mad")):
        q[f"outliers_{m}"] = (f"""WITH {_flags('lineitem', LINE_NUMBERS)}
SELECT "column", n, outlier_count, outlier_percentage, {keep} FROM ({outlier_rows(m)})""")
    q["outliers_column_statistics"] = f"""WITH {_flags('events', ev)}
SELECT col AS "column", CASE WHEN col = 'value' THEN 'double' ELSE 'bigint' END AS dtype, n AS total_values, 0::BIGINT AS null_count,
  round(lo, 4) AS min, round(hi, 4) AS max, round(mean, 4) AS mean, round(med, 4) AS median, round(sd, 4) AS std FROM st"""
    votes = "iqr::INT + zscore::INT + mad::INT"
    q["outliers_rows"] = f"""WITH {_flags('events', ['value'], 'event_id')}
SELECT event_id, col AS "column", v AS value, iqr, zscore, mad, {votes} AS votes FROM fl WHERE {votes} >= 1"""
    q["outliers_consensus"] = f"""WITH {_flags('events', ['value', 'user_id'], 'event_id')}
SELECT event_id, col AS "column", v AS value FROM fl WHERE {votes} >= 2"""
    q["outliers_consensus_counts"] = f"""WITH {_flags('events', ev)}
SELECT col AS "column", count(*) AS consensus_count FROM fl WHERE {votes} >= 2 GROUP BY col"""
    q["outliers_summary"] = f"""WITH {_flags('events', ev)}
SELECT 'events' AS dataset_name, 3::BIGINT AS numeric_columns_analyzed, count(*) FILTER (iqr) AS iqr_outliers,
  count(*) FILTER (zscore) AS zscore_outliers, count(*) FILTER (mad) AS mad_outliers,
  count(DISTINCT CASE WHEN {votes} >= 2 THEN col END) AS consensus_columns, 1.5::DOUBLE AS iqr_multiplier,
  3.0::DOUBLE AS zscore_threshold, 3.5::DOUBLE AS mad_threshold FROM fl"""
    q["outliers_impact"] = f"WITH {_flags('events', ['value'])}\n" + _union([f"""SELECT 'value' AS "column", '{m}' AS method,
  round(avg(v), 4) AS mean_all, round(stddev_samp(v), 4) AS std_all, round(avg(v) FILTER (NOT {m}), 4) AS mean_without,
  round(stddev_samp(v) FILTER (NOT {m}), 4) AS std_without FROM fl""" for m in ("iqr", "zscore", "mad")])

    q["tests_group_sizes"] = f"""SELECT cat, num, level, n FROM {_moments('events', [('event_type', 'value'), ('event_type', 'user_id')])}"""
    pairs = [("l_linestatus", x) for x in LINE_NUMBERS]
    both = [(c, x) for c in ("l_returnflag", "l_linestatus") for x in LINE_NUMBERS]
    ranks = lambda digits: _union([_rank_sum("lineitem", "l_linestatus", x, "F", "O", digits) for x in LINE_NUMBERS])
    q["tests_welch_t"] = _welch("lineitem", pairs)
    q["tests_mann_whitney"] = ranks(5)
    q["tests_mann_whitney_named_groups"] = _rank_sum("customer", "c_mktsegment", "c_acctbal", "MACHINERY", "BUILDING")
    q["tests_anova"] = _f_test("lineitem", both)
    q["tests_chi_square"] = _chi_result("lineitem", "l_returnflag", "l_linestatus", False)
    q["tests_chi_square_orders"] = _chi_result("orders", "o_orderstatus", "o_orderpriority", False)
    q["tests_chi_square_yates"] = _chi_result(LABELLED, "quality", "toxic", True)
    q["tests_run_all"] = _tests_table({"ttest": _welch("lineitem", pairs, 6), "mannwhitney": ranks(6), "anova": _f_test("lineitem", both, 6),
                                       "chi2": q["tests_chi_square"]})
    q["tests_all_statistics"] = "SELECT test, var1, var2, round(statistic, 5) AS statistic FROM (" + _tests_table({
        "ttest": q["tests_welch_t"], "mannwhitney": q["tests_mann_whitney"], "anova": q["tests_anova"],
        "chi2": _chi_result("lineitem", "l_returnflag", "l_linestatus", False, 5)}) + ")"
    q["tests_significance_counts"] = "SELECT test, count(*) FILTER (significant) AS n_significant, count(*) AS n_tests FROM (" + _tests_table({
        "anova": _f_test("orders", [("o_orderstatus", "o_totalprice"), ("o_orderpriority", "o_totalprice")]),
        "chi2": q["tests_chi_square_orders"]}) + ") GROUP BY test"
    q["tests_contingency"] = """SELECT 'o_orderstatus' AS cat1, 'o_orderpriority' AS cat2, o_orderstatus AS level1,
  o_orderpriority AS level2, count(*) AS n FROM orders GROUP BY 3, 4"""

    q["series_index"] = f"SELECT 'value' AS series, ts, value, idx FROM {EVENT_IDX}"
    q["series_profile"] = _union([f"""SELECT '{c}' AS series, count(*) AS total_observations, count(*) - count({c}) AS missing_values,
  round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percentage, min(ts) AS start, max(ts) AS "end",
  floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS span_days FROM events""" for c in ("value", "user_id")])
    way = ("CASE WHEN stddev_pop({v}) = 0 OR abs(regr_slope({v}, idx)) < stddev_pop({v}) / count(*) THEN 'flat' "
           "WHEN regr_slope({v}, idx) > 0 THEN 'upward' ELSE 'downward' END AS direction")
    q["series_trend"] = f"""SELECT 'value' AS series, count(*) AS n_obs, 'ok' AS status, round(regr_slope(value, idx), 6) AS slope,
  {way.format(v='value')}, round(regr_r2(value, idx), 6) AS r_squared, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM {EVENT_IDX}"""
    q["series_trend_monthly"] = _union([f"""SELECT '{s}' AS series, count(*) AS n_obs, 'ok' AS status, {way.format(v=c)},
  round(regr_r2({c}, idx), 6) AS r_squared, round(regr_slope({c}, idx), 2) AS slope, round(avg({c}), 2) AS mean, round(stddev_pop({c}), 2) AS std,
  round(min({c})::DOUBLE, 2) AS min, round(max({c})::DOUBLE, 2) AS max FROM (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx FROM {MONTHLY})"""
                                        for s, c in (("o_totalprice_sum", "total"), ("n_rows", "n"))])
    q["series_changepoints"] = f"""WITH {_steps()} SELECT 'value' AS series, (SELECT count(*) FROM events) AS n_obs, 'ok' AS status,
  (SELECT count(*) FROM c) AS n_changepoints, round(m, 6) AS mean_change, round(sd, 6) AS std_change FROM u"""
    q["series_changepoint_rows"] = f"WITH {_steps()} SELECT 'value' AS series, idx, ts, round(step, 6) AS step FROM c"
    q["series_first_changepoints"] = f"""WITH {_steps()} SELECT 'value' AS series, row_number() OVER (ORDER BY idx) AS rank, idx, ts,
  round(step, 6) AS step FROM c ORDER BY idx LIMIT 20"""
    lags = ", ".join(f"lag(x, {k}) OVER (ORDER BY idx) AS x{k}" for k in range(1, 41))
    acf_parts = _union([f"SELECT {k}::BIGINT AS lag, sum(x * {'x' if k == 0 else f'x{k}'}) / sum(x * x) AS acf FROM l" for k in range(41)])
    acf = f"""WITH x AS (SELECT idx, value - avg(value) OVER () AS x FROM {EVENT_IDX}), l AS (SELECT x, idx, {lags} FROM x), a AS ({acf_parts}),
n AS (SELECT count(*) AS n FROM x)"""
    q["series_autocorrelation"] = f"""{acf} SELECT 'value' AS series, n AS n_obs, 'ok' AS status,
  round(1.96 / sqrt(n), 8) AS confidence_limit, lag, round(acf, 8) AS acf FROM a, n"""
    q["series_significant_lags"] = f"""{acf} SELECT 'value' AS series, lag, round(acf, 8) AS acf FROM a, n
WHERE lag >= 1 AND abs(acf) > 1.96 / sqrt(n) ORDER BY lag LIMIT 10"""
    q["series_decompose_additive"] = f"""WITH {_decompose(EVENT_IDX, 24, False, 'value')}
SELECT series, method, idx, ts, round(value, 6) AS value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
  round(residual, 6) AS residual FROM o"""
    q["series_decompose_multiplicative"] = _union([f"""SELECT * FROM (WITH {_decompose(
        f"(SELECT ts, {c}::DOUBLE AS value, row_number() OVER (ORDER BY ts) - 1 AS idx FROM {MONTHLY})", 12, True, series)}
SELECT series, method, idx, ts, round(value, 2) AS value, round(trend, 2) AS trend, round(seasonal, 6) AS seasonal,
  round(residual, 6) AS residual FROM o)""" for series, c in (("o_totalprice_sum", "total"), ("n_rows", "n"))])
    q["series_partial_autocorrelation"] = f"""{acf.replace("WITH x", "WITH RECURSIVE x")},
r AS (SELECT list(acf ORDER BY lag) AS r FROM a),
d(k, phi, noise, last) AS (SELECT 1::BIGINT, [r[2]], 1 - r[2] * r[2], r[2] FROM r
  UNION ALL SELECT k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - l * phi[k + 1 - j]), [l]), noise * (1 - l * l), l
  FROM (SELECT k, phi, noise, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j]))) / noise AS l
        FROM d, r WHERE k < 40))
SELECT 'value' AS series, n AS n_obs, 'ok' AS status, round(1.96 / sqrt(n), 8) AS confidence_limit, lag, round(acf, 8) AS acf,
  CASE WHEN lag = 0 THEN 1.0 ELSE round(last, 8) END::DOUBLE AS pacf FROM a LEFT JOIN d ON k = lag, n"""
    q["series_component_strengths"] = f"""WITH {_decompose(EVENT_IDX, 24, False, 'value')},
v AS (SELECT var_pop(trend) AS t, var_pop(seasonal) AS s, var_pop(residual) AS r FROM o)
SELECT 'value' AS series, 'additive' AS method, round(t / (t + s + r), 6) AS trend_strength,
  round(s / (t + s + r), 6) AS seasonal_strength, round(r / (t + s + r), 6) AS residual_strength FROM v"""
    q["series_by_period"] = """SELECT date_trunc('hour', ts) AS period, count(*) AS n_rows, round(sum(value), 4) AS value_sum,
  round(avg(value), 4) AS value_mean, round(min(value), 4) AS value_min, round(max(value), 4) AS value_max FROM events GROUP BY 1"""
    q["series_by_window"] = """SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS n_rows,
  round(avg(value), 6) AS value_mean FROM (
  SELECT time_bucket(INTERVAL 6 HOURS, ts) - k * INTERVAL 6 HOURS AS window_start, value FROM events, range(4) t(k)) GROUP BY 1"""
    q["series_missing_periods"] = """SELECT d AS period FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP,
  max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM orders) WHERE d NOT IN (SELECT date_trunc('day', o_orderdate) FROM orders)"""
    q["series_interval_stats"] = """SELECT count(*) AS n_intervals, round(min(g), 4) AS min_seconds, round(avg(g), 4) AS mean_seconds,
  round(max(g), 4) AS max_seconds, round(stddev_pop(g), 4) AS std_seconds, count(*) FILTER (g = 0) AS repeated_stamps
FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS g FROM events) WHERE g IS NOT NULL"""
    q["series_kpss"] = f"""WITH e AS (SELECT idx, value - avg(value) OVER () AS e, count(*) OVER () AS n FROM {EVENT_IDX}),
k AS (SELECT ceil(12 * pow(max(n) / 100.0, 0.25))::BIGINT AS lags, max(n) AS n FROM e),
s AS (SELECT sum(c * c) AS squares FROM (SELECT sum(e) OVER (ORDER BY idx) AS c FROM e)),
g AS (SELECT i AS lag, sum(a.e * b.e) AS total FROM k, range(0, 200) t(i), e a JOIN e b ON a.idx = b.idx + i WHERE i <= lags GROUP BY i),
v AS (SELECT sum(CASE WHEN lag = 0 THEN total ELSE 2 * (1 - lag / (lags + 1.0)) * total END) AS long_run FROM g, k)
SELECT 'value' AS series, n AS n_obs, lags AS n_lags, round(x, 8) AS statistic, round(CASE WHEN x <= 0.347 THEN 0.1 WHEN x <= 0.463 THEN 0.1 - (x - 0.347) / 0.116 * 0.05
  WHEN x <= 0.574 THEN 0.05 - (x - 0.463) / 0.111 * 0.025 WHEN x <= 0.739 THEN 0.025 - (x - 0.574) / 0.165 * 0.015 ELSE 0.01 END, 8)::DOUBLE AS p_value
FROM (SELECT n, lags, squares / (n * long_run) AS x FROM k, s, v)"""

    z = {c: f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)" for c in LINE_NUMBERS}
    q["segments_scaled"] = f"""SELECT l_orderkey, l_linenumber, round({z['l_quantity']}, 5) AS z0, round({z['l_extendedprice']}, 5) AS z1,
  round({z['l_discount']}, 5) AS z2 FROM lineitem"""
    zp = {c: f"({c} - (SELECT avg({c}) FROM part)) / (SELECT stddev_pop({c}) FROM part)" for c in ("p_size", "p_retailprice")}
    def dbscan(table: str, key: str, points: str, near: str, least: int) -> str:
        return f"""WITH RECURSIVE pts AS MATERIALIZED ({points}),
nb AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM pts a JOIN pts b ON {near}),
core AS MATERIALIZED (SELECT a AS k FROM nb GROUP BY a HAVING count(*) >= {least}),
ce AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
reach AS (SELECT k, k AS root FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON reach.k = ce.a),
comp AS (SELECT k, min(root) AS root FROM reach GROUP BY k),
lab AS (SELECT k, dense_rank() OVER (ORDER BY root) - 1 AS c FROM comp),
edge AS (SELECT nb.a AS k, min(lab.c) AS c FROM nb JOIN lab ON lab.k = nb.b WHERE nb.a NOT IN (SELECT k FROM core) GROUP BY 1)
SELECT {key}, coalesce(lab.c, edge.c, -1)::BIGINT AS cluster FROM {table} LEFT JOIN lab ON lab.k = {key} LEFT JOIN edge ON edge.k = {key}"""

    q["segments_dbscan"] = dbscan("part", "p_partkey", f"SELECT p_partkey AS k, {zp['p_size']} AS x, {zp['p_retailprice']} AS y FROM part",
                                  "b.x BETWEEN a.x - 0.11 AND a.x + 0.11 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.1::DOUBLE * 0.1::DOUBLE", 5)
    q["segments_dbscan_six_axes"] = dbscan("embeddings", "vec_id", "SELECT vec_id AS k, embedding[1:6]::DOUBLE[] AS x FROM embeddings",
                                           "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) <= 0.12::DOUBLE * 0.12::DOUBLE", 4)
    q["segments_cluster_summary"] = _union([f"""SELECT l_returnflag AS cluster, count(*) AS size,
  round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percentage, '{c}' AS "column", round(avg({c}), 4) AS mean,
  round(var_samp({c}), 4) AS variance FROM lineitem GROUP BY 1""" for c in LINE_NUMBERS])
    dist = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    points = "p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), sz AS (SELECT label, count(*) AS n FROM p GROUP BY label)"
    sil = f"""WITH {points},
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({dist}) AS total FROM p a, p b GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, own, max(n) FILTER (own = other) AS n, max(total / nullif(n - 1, 0)) FILTER (own = other) AS a,
  min(total / n) FILTER (own <> other) AS b FROM d JOIN sz ON d.other = sz.label GROUP BY 1, 2),
s AS (SELECT vec_id, own, CASE WHEN n = 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS s FROM ab)"""
    q["segments_silhouette"] = f"{sil} SELECT vec_id, own::BIGINT AS cluster, round(s, 6) AS silhouette FROM s"
    unrolled = """u AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM p),
c AS (SELECT label, j, avg(v) AS c FROM u GROUP BY 1, 2)"""
    q["segments_silhouette_squared"] = f"""WITH {points}, {unrolled},
sq AS (SELECT vec_id, label, sum(v * v) AS own_sq FROM u GROUP BY 1, 2), psi AS (SELECT label, avg(own_sq) AS psi FROM sq GROUP BY 1),
dot AS (SELECT u.vec_id, u.label AS own, c.label AS other, sum(u.v * c.c) AS dot FROM u JOIN c ON u.j = c.j GROUP BY 1, 2, 3),
m AS (SELECT dot.vec_id, own, other, n, own_sq + psi - 2 * dot AS mean_sq FROM dot JOIN sq ON sq.vec_id = dot.vec_id
  JOIN psi ON psi.label = other JOIN sz ON sz.label = other),
ab AS (SELECT vec_id, own, max(n) FILTER (own = other) AS n, max(mean_sq * n / nullif(n - 1, 0)) FILTER (own = other) AS a,
  min(mean_sq) FILTER (own <> other) AS b FROM m GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"""
    db = f"""{unrolled},
sp AS (SELECT label, avg(dist) AS s FROM (SELECT u.vec_id, u.label, sqrt(sum((v - c) * (v - c))) AS dist FROM u
  JOIN c ON u.label = c.label AND u.j = c.j GROUP BY 1, 2) GROUP BY 1),
cc AS (SELECT a.label AS i, b.label AS k, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.j = b.j AND a.label <> b.label GROUP BY 1, 2),
w AS (SELECT i, max((x.s + y.s) / m) AS worst FROM cc JOIN sp x ON x.label = i JOIN sp y ON y.label = k GROUP BY 1)"""
    q["segments_davies_bouldin"] = f"WITH {points}, {db} SELECT round(avg(worst), 6) AS davies_bouldin, count(*) AS n_clusters FROM w"
    q["segments_quality"] = f"""SELECT 'label' AS method, count(DISTINCT label) AS n_clusters, 0::BIGINT AS n_noise,
  'euclidean' AS silhouette_kind, (SELECT round(avg(s), 6) FROM ({sil} SELECT * FROM s)) AS silhouette_euclidean,
  (SELECT silhouette FROM ({q['segments_silhouette_squared']})) AS silhouette_squared,
  (SELECT davies_bouldin FROM ({q['segments_davies_bouldin']})) AS davies_bouldin,
  (SELECT avg(s) FROM ({sil} SELECT * FROM s)) >= 0.5 AS quality_acceptable FROM embeddings"""
    r = "(SELECT corr(l_quantity, l_extendedprice) FROM lineitem)"
    q["segments_pca"] = f"""SELECT l_orderkey, l_linenumber,
  round((a + CASE WHEN r > 0 THEN b ELSE -b END) / sqrt(2), 5) AS pc1, round((a - CASE WHEN r > 0 THEN b ELSE -b END) / sqrt(2), 5) AS pc2
FROM (SELECT l_orderkey, l_linenumber, {z['l_quantity']} AS a, {z['l_extendedprice']} AS b, {r} AS r FROM lineitem)"""
    q["segments_pca_variance"] = f"""SELECT 1 AS component, round((1 + abs({r})) / 2, 6) AS explained_variance_ratio
UNION ALL SELECT 2, round((1 - abs({r})) / 2, 6)"""

    # whole jobs: the sections' own SQL, told column by column
    flags = _union([f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent
FROM lineitem GROUP BY {c}""" for c in ("l_returnflag", "l_linestatus")])
    modes = f"""SELECT "column", arg_max(value, count) AS top, max(count) AS top_count, 0::BIGINT AS missing, 0.0 AS missing_percent FROM ({flags}) GROUP BY "column\""""
    q["job_quality"] = _told({
        "completeness": (q["quality_completeness"], "null_count null_percentage complete_count overall_completeness", "column", ""),
        "consistency": (q["quality_consistency"], "unique_values duplicate_count duplicate_percentage", "column", "")})
    q["job_distributions"] = _told({
        "numeric_summary": (q["dist_numeric_summary"], "count mean std min p25 p50 p75 max missing missing_percent", "column", ""),
        "frequencies": (flags, "count percent", "column value", ""), "modes": (modes, "top_count missing missing_percent", "column top", "")})
    q["job_outliers"] = _told({
        "column_statistics": (q["outliers_column_statistics"], "total_values null_count min max mean median std", "column dtype", ""),
        "outliers": (q["outliers_detect"], "n outlier_count outlier_percentage lower upper q1 q3 iqr mean std median mad", "column method note", ""),
        "summary": (q["outliers_summary"], "numeric_columns_analyzed iqr_outliers zscore_outliers mad_outliers consensus_columns iqr_multiplier "
                    "zscore_threshold mad_threshold", "dataset_name", ""),
        "consensus": (f"""WITH {_flags('events', ev)} SELECT col AS "column", round(v, 4) AS value FROM fl WHERE {votes} >= 2""", "value", "column", "")})
    every = _tests_table({"ttest": q["tests_welch_t"], "mannwhitney": q["tests_mann_whitney"], "anova": q["tests_anova"], "chi2": q["tests_chi_square"]})
    q["job_tests"] = _told({
        "ttest": (q["tests_welch_t"], "n_g1 n_g2 statistic df p_value alpha", "cat num group1 group2", "significant"),
        "mannwhitney": (q["tests_mann_whitney"], "n_g1 n_g2 statistic tie_term z p_value alpha", "cat num group1 group2", "significant"),
        "anova": (q["tests_anova"], "n_groups n_total statistic df1 df2 p_value alpha", "cat num", "significant"),
        "chi2": (q["tests_chi_square"], "n_rows n_cols n_total statistic df p_value alpha", "cat1 cat2", "significant"),
        "significant": (f"SELECT test, count(*) FILTER (significant) AS n_significant, count(*) AS n_tests FROM ({every}) GROUP BY test",
                        "n_significant n_tests", "test", "")})
    outside = """SELECT series, lag, pacf FROM ({}) WHERE lag >= 1 AND abs(pacf) > confidence_limit ORDER BY lag LIMIT 10"""
    q["job_series"] = _told({
        "profile": (f"SELECT * FROM ({q['series_profile']}) WHERE series = 'value'", "total_observations missing_values missing_percentage span_days", "series", ""),
        "autocorrelation": (q["series_partial_autocorrelation"], "n_obs confidence_limit lag acf pacf", "series status", ""),
        "significant_acf": (q["series_significant_lags"], "lag acf", "series", ""),
        "significant_pacf": (outside.format(q["series_partial_autocorrelation"]), "lag pacf", "series", ""),
        "trend": (q["series_trend"], "n_obs slope r_squared mean std min max", "series status direction", ""),
        "changepoints": (q["series_changepoints"], "n_obs n_changepoints mean_change std_change", "series status", ""),
        "first_changepoints": (q["series_first_changepoints"], "rank idx step", "series", "")})
    parts = "SELECT p_partkey FROM part"
    shares = "SELECT corr(p_size, p_retailprice) AS r FROM part"
    q["job_segments"] = _told({
        "labels_kmeans": (parts, "p_partkey", "", ""), "labels_hierarchical": (parts, "p_partkey", "", ""),
        "pca_variance": (f"SELECT 1 AS component, round((1 + abs(r)) / 2, 6) AS explained_variance_ratio FROM ({shares}) UNION ALL "
                         f"SELECT 2, round((1 - abs(r)) / 2, 6) FROM ({shares})", "component explained_variance_ratio", "", "")})
    q["series_decompose_table"] = q["series_decompose_additive"]
    return q
