"""DuckDB SQL for the registered queries, built from small pieces."""

from __future__ import annotations

from plumbline.operators import pii, stats
from plumbline.plans import inputs, queries

ORDERS = inputs.DIRTY_ORDERS.format(t="orders")
YEARS = inputs.DIRTY_YEARS.format(t="orders")
DUPS = inputs.DIRTY_DUPS.format(t="orders")
CONTACTS = inputs.DIRTY_CONTACTS.format(t="customer")
LINEITEM = (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"))
DIRTY = (("id", "numeric"), ("name", "text"), ("amount", "numeric"), ("score", "numeric"), ("created_at", "datetime"), ("constant_col", "text"))
CONTACT_COLUMNS = ("contact", "reach", "payment_value", "host", "doc", "token", "segment")
BIG = "CAST({} AS BIGINT)".format


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _pct(part: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN 100.0 * {part} / {total} ELSE 0.0 END"


def _completeness(table: str, columns) -> str:
    return _union(f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, round({_pct(f'(count(*) - count({c}))', 'count(*)')}, 6) AS null_percentage, count(DISTINCT {c}) AS distinct_count, round({_pct(f'count(DISTINCT {c})', 'count(*)')}, 6) AS distinct_percentage FROM ({table})" for c in columns)


def _basic(name: str, table: str, columns) -> str:
    return _union(f"SELECT '{name}' AS table_name, '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 2) AS min_num, round(CAST(max({c}) AS DOUBLE), 2) AS max_num, round(avg({c}), 2) AS avg, round(CAST(sum({c}) AS DOUBLE), 2) AS sum, count(*) FILTER ({c} = 0) AS zero_count FROM ({table})" for c in columns)


def _moments(c: str) -> str:
    return f"SELECT '{c}' AS column_name, round(any_value(v), 4) AS variance, round(sqrt(any_value(v)), 4) AS stddev, round(avg(power(x - m, 3)) / power(any_value(v), 1.5), 4) AS skewness, round(avg(power(x - m, 4)) / power(any_value(v), 2) - 3, 4) AS kurtosis FROM (SELECT {c} AS x, (SELECT avg({c}) FROM lineitem) AS m, (SELECT var_pop({c}) FROM lineitem) AS v FROM lineitem)"


def _quantiles(name: str, c: str) -> str:
    return f"SELECT '{name}' AS table_name, '{c}' AS column_name, " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS p{round(100 * p)}" for p in stats.PERCENTILES) + f" FROM {name}"


def _outliers(name: str, table: str, c: str) -> str:
    return f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) FILTER (s > 0 AND abs({c} - m) > 3 * s) AS outlier_count, round({_pct(f'count(*) FILTER (s > 0 AND abs({c} - m) > 3 * s)', f'count({c})')}, 6) AS outlier_percentage FROM (SELECT {c}, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s FROM ({table}))"


def _histogram(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, bin, round(lo + w * bin / 10, 4) AS lower, round(CASE WHEN bin = 9 OR w = 0 THEN hi ELSE lo + w * (bin + 1) / 10 END, 4) AS upper, n AS count, round(100.0 * n / sum(n) OVER (), 4) AS percentage
FROM (SELECT lo, hi, hi - lo AS w, {BIG("CASE WHEN hi > lo THEN least(9, floor((v - lo) / (hi - lo) * 10)) ELSE 0 END")} AS bin, count(*) AS n FROM (SELECT CAST({c} AS DOUBLE) AS v, CAST(min({c}) OVER () AS DOUBLE) AS lo, CAST(max({c}) OVER () AS DOUBLE) AS hi FROM orders) WHERE v IS NOT NULL GROUP BY ALL)"""


def _dates(name: str, c: str) -> str:
    later = f"count(*) FILTER ({c} > TIMESTAMP '{inputs.AS_OF}')"
    return f"SELECT '{name}' AS table_name, '{c}' AS column_name, CAST(min({c}) AS TIMESTAMP) AS min_ts, CAST(max({c}) AS TIMESTAMP) AS max_ts, {later} AS future_date_count, round({_pct(later, f'count({c})')}, 6) AS future_date_percentage, round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400e6, 6) AS date_range_days FROM {name}"


def _top(name: str, table: str, c: str, tie: str = "") -> str:
    """``tie``: what orders values of equal count."""
    value = f"CAST({c} AS VARCHAR)"
    return f"SELECT '{name}' AS table_name, '{c}' AS column_name, rank, value, count, round(100.0 * count / total, 6) AS percentage FROM (SELECT value, n AS count, total, row_number() OVER (ORDER BY n DESC, {tie or 'value'}) AS rank FROM (SELECT {value} AS value, count(*) AS n, (SELECT count(*) FROM ({table})) AS total FROM ({table}) WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rank <= 10"


def _like(value: str, pattern: str) -> str:
    flags = ", 'i'" if pattern.startswith("(?i)") else ""
    return f"regexp_matches({value}, '{pattern.removeprefix('(?i)')}'{flags})"


def _patterns(name: str, table: str, c: str) -> str:
    case = "CASE " + " ".join(f"WHEN {_like(c, p)} THEN '{k}'" for k, p in stats.PATTERNS) + " ELSE 'mixed' END"
    return f"SELECT '{name}' AS table_name, '{c}' AS column_name, pattern, n AS count, round(100.0 * n / sum(n) OVER (), 6) AS percentage FROM (SELECT {case} AS pattern, count(*) AS n FROM ({table}) WHERE {c} IS NOT NULL GROUP BY 1)"


def _entropy(name: str, c: str) -> str:
    return f"SELECT '{name}' AS table_name, '{c}' AS column_name, round(-sum(n / t * log2(n / t)), 6) AS entropy, round(-sum(n / t * log2(n / t)) / log2(count(*)), 6) AS normalized_entropy FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY {c})) HAVING count(*) BETWEEN 2 AND 10000"


def _correlations() -> str:
    names = [c for c, t in LINEITEM if t in ("bigint", "int", "double")]
    return _union(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS coefficient FROM lineitem" for i, a in enumerate(names) for b in names[i + 1 :])


_DUPLICATES = f"SELECT {BIG('sum(n)')} AS total_rows, {BIG('sum(n - 1)')} AS duplicate_rows, round(100.0 * sum(n - 1) / sum(n), 6) AS duplicate_percentage FROM (SELECT count(*) AS n FROM ({DUPS}) GROUP BY status, priority, bucket)"


def _luhn(d: str) -> str:
    digits = f"list_transform(range(1, length({d}) + 1), lambda i: CAST(substr({d}, CAST(length({d}) + 1 - i AS BIGINT), 1) AS INT) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END))"
    return f"(list_sum(list_transform({digits}, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0)"


def _shape(label: str) -> str:
    d = "regexp_replace(v, '[^0-9]', '', 'g')"
    return {
        "email": _like("v", pii.EMAIL),
        "phone": f"{_like('v', pii.PHONE)} AND length({d}) >= 10",
        "credit_card": f"length({d}) BETWEEN 13 AND 19 AND {_luhn(d)}",
        "government_id": f"({_like('upper(v)', pii.PAN)} OR length({d}) = 12)",
        "uuid": _like("v", pii.UUID),
        "ip_address": f"{_like('v', pii.IPV4)} AND coalesce(list_max(list_transform(string_split(v, '.'), lambda x: TRY_CAST(x AS INT))) <= 255, false)",
    }[label]


def _ratios(values: str) -> str:
    """values: SQL of (column_name, value, n)."""
    parts = [f"SELECT column_name, '{label}' AS label, CAST(sum(CASE WHEN {_shape(label)} THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS ratio FROM (SELECT column_name, trim(value) AS v, n FROM ({values})) WHERE v <> '' GROUP BY 1" for label in pii.VALUE_ORDER]
    return _union(parts)


_CONTACT_VALUES = _union(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM ({CONTACTS}) GROUP BY 2" for c in CONTACT_COLUMNS)
_CONTACT_ALL = _union([f"SELECT 'customer_id' AS column_name, CAST(customer_id AS VARCHAR) AS value, 1 AS n FROM ({CONTACTS})", _CONTACT_VALUES])
_CONTACT_TOP = f"SELECT column_name, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM ({_CONTACT_ALL})) WHERE rank <= 10"
_RANK = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(pii.VALUE_ORDER)) + " END"
# none of these headers holds a rule word
_CONTACT_LABELS = f"SELECT n.column_name, coalesce(l.label, '') AS pii, CAST(CASE WHEN l.label IS NULL THEN 0.0 WHEN l.ratio >= 0.8 THEN 0.9 ELSE 0.8 END AS DOUBLE) AS pii_confidence FROM (SELECT DISTINCT column_name FROM ({_CONTACT_ALL})) n LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY {_RANK}) AS k FROM ({_ratios(_CONTACT_TOP)}) WHERE ratio >= 0.5) WHERE k = 1) l ON l.column_name = n.column_name"


def _header() -> str:
    tables = "'customer', 'supplier', 'part', 'lineitem'"
    n = "regexp_replace(lower(trim(column_name)), '[- ]', '_', 'g')"
    case = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({n}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in pii.HEADER_RULES) + " END"
    return f"SELECT table_name, column_name, label FROM (SELECT table_name, column_name, {case} AS label FROM duckdb_columns() WHERE table_name IN ({tables})) WHERE label IS NOT NULL"


def _profile(table: str, by: str, as_of: str, columns=DIRTY) -> str:
    """A row per column (and ``by``) with what checks and drift need."""
    out = []
    for c, family in columns:
        text, number, date = family == "text", family == "numeric", family == "datetime"
        far = f"count(*) FILTER (s > 0 AND abs({c} - m) > 3 * s)" if number else "0"
        source = f"SELECT *, {f'avg({c}) OVER w AS m, stddev_pop({c}) OVER w AS s' if number else '0 AS m, 0 AS s'}, CASE WHEN {c} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {by}, {c}) END AS top FROM (SELECT * FROM ({table})) WINDOW w AS (PARTITION BY {by})"
        out.append(f"""SELECT {by} AS g, '{c}' AS column_name, '{family}' AS family, count(*) AS total_rows, count(*) - count({c}) AS null_count, 100.0 * (count(*) - count({c})) / count(*) AS null_percentage,
  count(DISTINCT {c}) AS distinct_count, 100.0 * count(DISTINCT {c}) / count(*) AS distinct_percentage, 100.0 * max(top) / count(*) AS top_percentage,
  {f"count(*) FILTER ({c} = '')" if text else 0} AS empty_count, {f"count(*) FILTER ({c} <> '' AND trim({c}) = '')" if text else 0} AS whitespace_count,
  {far} AS outlier_count, {_pct(far, f"count({c})") if number else "0.0"} AS outlier_percentage, {f"count(*) FILTER ({c} > {as_of})" if date else 0} AS future_date_count, {f"count(*) FILTER ({c} = 0)" if number else 0} AS zero_count
FROM ({source}) GROUP BY 1""")
    return _union(out)


def _checks(profile: str, duplicates: str, r) -> str:
    """(g, name, passed, severity, metric, threshold, actual, points)."""
    null_ok = f"null_percentage <= {r.max_null}"
    key = "(lower(column_name) = 'id' OR (length(column_name) > 3 AND lower(column_name) LIKE '%id'))"
    unique = "(total_rows > 0 AND distinct_count = total_rows)"
    passing = "CASE WHEN {} THEN 'pass' ELSE 'fail' END".format
    no_e, no_w = ("true" if r.allow_empty else "empty_count = 0"), ("true" if r.allow_whitespace else "whitespace_count = 0")
    rows = [
        ("true", "completeness", null_ok, passing(null_ok), "null_percentage", r.max_null, "null_percentage", f"CASE WHEN {null_ok} THEN 0 ELSE 10 END"),
        (key, "uniqueness", unique, passing(unique), "distinct_percentage", 100.0, "distinct_percentage", f"CASE WHEN {unique} THEN 0 ELSE 5 END"),
        ("total_rows > 0 AND distinct_count <= 1", "constant", "false", "'warn'", "distinct_count", 1.0, "distinct_count", "0"),
        (f"total_rows > 0 AND distinct_percentage >= {r.high_cardinality} AND NOT {key}", "high_cardinality", "true", "'info'", "distinct_percentage", r.high_cardinality, "distinct_percentage", "0"),
        (f"top_percentage >= {r.dominant_value}", "dominant_value", "true", "'info'", "top_value_percentage", r.dominant_value, "top_percentage", "0"),
        ("family = 'text'", "empty", no_e, "CASE WHEN empty_count = 0 THEN 'pass' ELSE 'warn' END", "empty_count", 0.0, "empty_count", f"CASE WHEN {no_e} THEN 0 ELSE 3 END"),
        ("family = 'text'", "whitespace", no_w, "CASE WHEN whitespace_count = 0 THEN 'pass' ELSE 'warn' END", "whitespace_count", 0.0, "whitespace_count", f"CASE WHEN {no_w} THEN 0 ELSE 2 END"),
        ("family = 'numeric' AND outlier_count > 0", "outliers", "true", "'warn'", "outlier_percentage", None, "outlier_percentage", "0"),
        ("family = 'datetime' AND future_date_count > 0", "future_dates", "false", "'warn'", "future_date_count", 0.0, "future_date_count", "3"),
        ("family = 'numeric' AND zero_count > 0", "zero_values", "true", "'info'", "zero_percentage", None, _pct("zero_count", "(total_rows - null_count)"), "0"),
    ]
    parts = [f"SELECT g, '{n}:' || column_name AS name, {ok} AS passed, {sev} AS severity, '{metric}' AS metric, CAST({'NULL' if t is None else t} AS DOUBLE) AS threshold, round(CAST({actual} AS DOUBLE), 6) AS actual, {BIG(points)} AS points FROM ({profile}) WHERE {when}" for when, n, ok, sev, metric, t, actual, points in rows]
    parts.append(f"SELECT g, 'duplicate_rows' AS name, false AS passed, 'warn' AS severity, 'duplicate_rows' AS metric, CAST(0 AS DOUBLE) AS threshold, CAST(d AS DOUBLE) AS actual, CAST(5 AS BIGINT) AS points FROM ({duplicates}) WHERE d > 0")
    return _union(parts)


_P = _profile(ORDERS, "1", f"TIMESTAMP '{inputs.AS_OF}'")
_D = f"SELECT 1 AS g, sum(n - 1) AS d FROM (SELECT count(*) AS n FROM ({ORDERS}) GROUP BY ALL)".replace("SELECT count(*) AS n FROM", "SELECT id, name, amount, score, created_at, constant_col, count(*) AS n FROM")
_PY = _profile(YEARS, "y", "make_timestamp(y + 1, 1, 1, 0, 0, 0)").replace("make_timestamp(y + 1, 1, 1, 0, 0, 0)", "make_timestamp(CAST(y + 1 AS BIGINT), 1, 1, 0, 0, 0)")
_DY = f"SELECT y AS g, sum(n) AS t, sum(n - 1) AS d FROM (SELECT y, id, name, amount, score, created_at, constant_col, count(*) AS n FROM ({YEARS}) GROUP BY ALL) GROUP BY 1"
_DEFAULT = queries.quality.QualityRules()
_SCORES = f"SELECT g, CAST(greatest(0, 100 - sum(points)) AS DOUBLE) AS score FROM ({_checks(_PY, _DY, _DEFAULT)}) GROUP BY g"
_SNAPSHOTS = f"SELECT 's' AS schema_name, 'orders' AS table_name, CAST(d.g AS VARCHAR) AS snapshot_id, make_timestamp(CAST(d.g + 1 AS BIGINT), 1, 1, 0, 0, 0) AS created_at, row_number() OVER (ORDER BY d.g DESC) AS rank, {BIG('d.t')} AS total_rows, s.score FROM ({_DY}) d JOIN ({_SCORES}) s ON s.g = d.g"


def _drift() -> str:
    """(g, column_name, kind, severity, old_value, new_value)."""
    p, t = f"({_PY})", f"(SELECT d.g, d.d, s.score FROM ({_DY}) d JOIN ({_SCORES}) s ON s.g = d.g)"
    severity = queries.drift.SEVERITY
    parts = [
        f"SELECT b.g, b.column_name, '{f}' AS kind, '{severity[f]}' AS severity, round(CAST(a.{f} AS DOUBLE), 4) AS old_value, round(CAST(b.{f} AS DOUBLE), 4) AS new_value FROM {p} a JOIN {p} b ON b.g = a.g + 1 AND b.column_name = a.column_name WHERE {'b.distinct_count <> a.distinct_count' if least is None else f'abs(b.{f} - a.{f}) >= {least}'}"
        for f, least in (("distinct_count", None), ("null_percentage", 10), ("distinct_percentage", 10), ("outlier_percentage", 5))
    ]
    for kind, f in (("score", "score"), ("duplicate_rows", "d")):
        parts.append(f"SELECT b.g, NULL AS column_name, '{kind}' AS kind, '{severity[kind]}' AS severity, CAST(a.{f} AS DOUBLE) AS old_value, CAST(b.{f} AS DOUBLE) AS new_value FROM {t} a JOIN {t} b ON b.g = a.g + 1 WHERE a.{f} <> b.{f}")
    return _union(parts)


_CHANGES = "SELECT CAST(g AS VARCHAR) AS snapshot_id, column_name, kind, severity, old_value, new_value FROM"


STATE_1, STATE_2 = inputs.STATE_1.format(t="customer"), inputs.STATE_2.format(t="customer")
_SHARED = (("id", "numeric"), ("contact", "text"), ("amount", "numeric"), ("score", "numeric"), ("segment", "text"), ("flag", "text"))
_NOW = "TIMESTAMP '1999-06-02 00:00:00'"
_P1, _P2 = _profile(STATE_1, "1", _NOW, (*_SHARED, ("gone", "text"))), _profile(STATE_2, "2", _NOW, (*_SHARED, ("extra", "text")))
_DUP1, _DUP2 = (f"SELECT {g} AS g, sum(n - 1) AS d FROM (SELECT *, count(*) AS n FROM ({t}) GROUP BY ALL)" for g, t in ((1, STATE_1), (2, STATE_2)))


def _label(table: str, c: str) -> str:
    """By the values of a column alone, whose ten most frequent are all it has."""
    top = f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM ({table}) GROUP BY 2"
    return f"(SELECT label FROM ({_ratios(top)}) WHERE ratio >= 0.5 ORDER BY {_RANK} LIMIT 1)"


def _run_drift() -> str:
    severity = queries.drift.SEVERITY
    row = lambda name, kind, old, new, source: f"SELECT {name} AS column_name, '{kind}' AS kind, '{severity[kind]}' AS severity, {old} AS old_value, {new} AS new_value FROM {source}"
    met = f"({_P1}) a JOIN ({_P2}) b ON b.column_name = a.column_name"
    text = lambda v: f"CAST(round(CAST({v} AS DOUBLE), 4) AS VARCHAR)"
    parts = [
        row("'gone'", "removed", "'string'", "CAST(NULL AS VARCHAR)", "(SELECT 1)"), row("'extra'", "added", "CAST(NULL AS VARCHAR)", "'string'", "(SELECT 1)"),
        row("'score'", "type", "'int'", "'double'", f"(SELECT typeof(score) AS x FROM ({STATE_1}) LIMIT 1), (SELECT typeof(score) AS y FROM ({STATE_2}) LIMIT 1) WHERE x <> y"),
        # a literal has no nulls, what a CASE may leave out has
        row("'flag'", "nullability", "'false'", "'true'", f"(SELECT count(flag) = count(*) AS x FROM ({STATE_1})), (SELECT count(flag) < count(*) AS y FROM ({STATE_2})) WHERE x AND y"),
        row("'contact'", "pii", "x", "y", f"(SELECT {_label(STATE_1, 'contact')} AS x, {_label(STATE_2, 'contact')} AS y) WHERE x <> y"),
    ]
    for f, least in (("distinct_count", None), ("null_percentage", 10), ("distinct_percentage", 10), ("outlier_percentage", 5)):
        parts.append(row("a.column_name", f, text(f"a.{f}"), text(f"b.{f}"), f"{met} WHERE {'b.distinct_count <> a.distinct_count' if least is None else f'abs(b.{f} - a.{f}) >= {least}'}"))
    scores = [f"SELECT CAST(greatest(0, 100 - sum(points)) AS DOUBLE) AS v FROM ({_checks(p, d, _DEFAULT)})" for p, d in ((_P1, _DUP1), (_P2, _DUP2))]
    for kind, (one, two) in (("score", scores), ("duplicate_rows", [f"SELECT d AS v FROM ({d})" for d in (_DUP1, _DUP2)])):
        parts.append(row("CAST(NULL AS VARCHAR)", kind, text("a.v"), text("b.v"), f"({one}) a, ({two}) b WHERE a.v <> b.v"))
    return _union(parts)


def _headed() -> str:
    table = inputs.HEADED.format(t="customer")
    ratio = lambda c, label: f"coalesce((SELECT ratio FROM ({_ratios(_top10(table, c))}) WHERE label = '{label}'), 0)"
    rows = [("email", "email", "0.75"), ("phone", "phone", "0.75"), ("name", "person_name", "0.65"), ("ip_address", "address", "0.75")]
    case = lambda c, label, plain: f"CASE WHEN {ratio(c, label)} >= 0.8 THEN 0.95 WHEN {ratio(c, label)} >= 0.5 THEN 0.85 ELSE {plain} END" if label != "person_name" else plain
    return _union(f"SELECT '{c}' AS column_name, '{label}' AS pii, CAST({case(c, label, plain)} AS DOUBLE) AS pii_confidence" for c, label, plain in rows)


def _top10(table: str, c: str) -> str:
    return f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM ({table}) WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10"


def _fk_check() -> str:
    return _union(f"SELECT '{a}.{c}' AS child, '{b}.{p}' AS parent, count({c}) AS filled_rows, count(*) FILTER ({c} IS NOT NULL AND NOT ok) AS orphan_rows, round({_pct(f'(count({c}) - count(*) FILTER ({c} IS NOT NULL AND NOT ok))', f'count({c})')}, 6) AS match_percentage FROM (SELECT {c}, {c} IN (SELECT {p} FROM {b}) AS ok FROM {a})" for a, c, b, p in queries.LINKS)


def _fk_discover() -> str:
    cols = [(t, c) for t, cs in queries.FK_TABLES.items() for c in cs]
    parts = []
    for t, c in cols:
        for u, k in cols:
            if t != u:
                parts.append(f"SELECT '{t}' AS child_table, '{c}' AS child_column, '{u}' AS parent_table, '{k}' AS parent_column, count(DISTINCT {c}) AS distinct_values FROM {t} HAVING count(DISTINCT {c}) >= 2 AND (SELECT count({k}) = count(DISTINCT {k}) AND count(DISTINCT {k}) >= 2 FROM {u}) AND bool_and({c} IN (SELECT {k} FROM {u}))")
    return _union(parts)


def _partitions() -> str:
    return _union(f"SELECT event_type, '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, round(avg({c}), 2) AS avg, round(CAST(sum({c}) AS DOUBLE), 2) AS sum, round(CAST(min({c}) AS DOUBLE), 2) AS min_num, round(CAST(max({c}) AS DOUBLE), 2) AS max_num, round(var_pop({c}), 2) AS variance, count(DISTINCT {c}) AS distinct_count FROM events GROUP BY event_type" for c in ("value", "user_id"))


def _lineitem() -> str:
    out = []
    for c, t in LINEITEM:
        number, text = t in ("bigint", "int", "double"), t == "string"
        v = f"CAST({c} AS DOUBLE)"
        num = (lambda f: f"round({f}, 3)") if number else (lambda f: "CAST(NULL AS DOUBLE)")
        entropy = f"(SELECT round(-sum(n / t * log2(n / t)), 3) FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})))" if text else "CAST(NULL AS DOUBLE)"
        far = f"(SELECT count(*) FILTER (abs({c} - m) > 3 * s) FROM (SELECT {c}, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s FROM lineitem))" if number else BIG("0")
        label = "'ip_address' AS pii, CAST(0.75 AS DOUBLE) AS pii_confidence" if c == "l_shipdate" else "'' AS pii, CAST(0 AS DOUBLE) AS pii_confidence"
        out.append(f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, round(100.0 * count(DISTINCT {c}) / count(*), 3) AS distinct_percentage,
  (SELECT round(100.0 * max(n) / sum(n), 3) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) AS top_percentage, {BIG(f"min(length({c}))" if text else "NULL")} AS min_length, {BIG(f"max(length({c}))" if text else "NULL")} AS max_length,
  {num(f"avg({v})")} AS avg, {num(f"stddev_pop({v})")} AS stddev, {num(f"quantile_cont({v}, 0.5)")} AS p50, {num(f"quantile_cont({v}, 0.99)")} AS p99, {far} AS outlier_count, {entropy} AS entropy, {label} FROM lineitem""")
    return _union(out)


def _catalogue(tables) -> str:
    """Names, order and types as DuckDB finds them in the tables."""
    kinds = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}
    case = "CASE data_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()) + " END"
    names = ", ".join(f"'{t}'" for t in tables)
    return f"SELECT table_name, column_name, {BIG('column_index')} AS ordinal, {case} AS data_type, is_nullable AS nullable FROM duckdb_columns() WHERE table_name IN ({names})"


def _far_counts(table: str, n: int) -> str:
    return f"CASE WHEN count(DISTINCT {table}) <= {n} THEN true ELSE false END"


def _estimated() -> str:
    top = lambda c: f"(SELECT round(CASE WHEN 100.0 * max(n) / sum(n) >= 1 THEN 100.0 * max(n) / sum(n) ELSE 0 END, 3) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c}))"
    return _union(f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, {_far_counts(c, 500)} AS distinct_exact, {top(c)} AS top_percentage FROM lineitem" for c, _ in LINEITEM)


def _all_parts() -> str:
    row = lambda part, c, item, amount, source: f"SELECT '{part}' AS part, '{c}' AS column_name, {item} AS item, round(CAST({amount} AS DOUBLE), 6) AS amount FROM {source}"
    out = []
    for c, family in DIRTY:
        out += [row("total_rows", c, "'count'", "count(*)", f"({ORDERS})"), row("null_count", c, "'count'", f"count(*) - count({c})", f"({ORDERS})"), row("distinct_count", c, "'count'", f"count(DISTINCT {c})", f"({ORDERS})")]
        if c in ("id", "score", "created_at"):
            out += [row(f, c, f"CAST({f}({c}) AS VARCHAR)", "count(*)", f"({ORDERS})") for f in ("min", "max")]
        if c != "amount":
            out.append(row("top_values", c, "rank || ':' || value", "count", f"({_top('x', ORDERS, c)})"))
        if family == "text":
            out.append(row("patterns", c, "pattern", "count", f"({_patterns('x', ORDERS, c)})"))
        if family == "numeric":
            out.append(row("histograms", c, "CAST(bin AS VARCHAR)", "count", f"({_histogram(c).replace('FROM orders)', f'FROM ({ORDERS}))')})"))
    out.append(row("dates", "created_at", "period", "n", f"(SELECT strftime(created_at, '%Y-%m') AS period, count(*) AS n FROM ({ORDERS}) WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12)"))
    numbers = [c for c, f in DIRTY if f == "numeric"]
    out += [row("correlations", a, f"'{b}'", f"corr({a}, {b})", f"({ORDERS})") for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    out += [row("links", "score", f"'{k}'", "1", f"(SELECT 1 WHERE (SELECT bool_and(score IN (SELECT {k} FROM nation)) FROM ({ORDERS}) WHERE score IS NOT NULL) AND (SELECT count({k}) = count(DISTINCT {k}) FROM nation))") for k in ("n_nationkey", "n_regionkey")]
    out.append(row("duplicates", "", "'rows'", "d", f"({_D})"))
    return _union(out)


def _retried() -> str:
    out = []
    for g, state, p, d, columns in (("1", STATE_1, _P1, _DUP1, (*_SHARED, ("gone", "text"))), ("2", STATE_2, _P2, _DUP2, (*_SHARED, ("extra", "text")))):
        tops = " + ".join(f"(SELECT least(10, count(DISTINCT {c})) FROM ({state}))" for c, _ in columns)
        out.append(f"SELECT '{g}' AS snapshot_id, (SELECT count(*) FROM ({state})) AS total_rows, {BIG(f'(SELECT d FROM ({d}))')} AS duplicate_rows, (SELECT CAST(greatest(0, 100 - sum(points)) AS DOUBLE) FROM ({_checks(p, d, _DEFAULT)})) AS score, {BIG(len(columns))} AS n_columns, (SELECT count(*) FROM ({_checks(p, d, _DEFAULT)})) AS n_checks, {BIG(tops)} AS n_top_values")
    return _union(out)


def _documents() -> str:
    none, out = "CAST(NULL AS BIGINT)", []
    for c, family in DIRTY:
        lists = {"top_values": f"({_top('x', ORDERS, c)})", "patterns": f"({_patterns('x', ORDERS, c)})" if family == "text" else None, "histograms": f"({_histogram(c).replace('FROM orders)', f'FROM ({ORDERS}))')})" if family == "numeric" else None}
        lists["dates"] = f"(SELECT strftime({c}, '%Y-%m') AS period, count(*) AS count FROM ({ORDERS}) WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12)" if family == "datetime" else None
        sums = ", ".join(f"{none if q is None else f'(SELECT count(*) FROM {q})'} AS n_{n}, {none if q is None else BIG(f'(SELECT sum(count) FROM {q})')} AS sum_{n}" for n, q in lists.items())
        out.append(f"SELECT '1' AS snapshot_id, '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, {sums}, (SELECT CAST(greatest(0, 100 - sum(points)) AS DOUBLE) FROM ({_checks(_P, _D, _DEFAULT)})) AS score FROM ({ORDERS})")
    return _union(out)


def _incremental() -> str:
    day = "CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events)"
    table = f"(SELECT ts, user_id, event_type, CASE WHEN {day} THEN value + 1000 ELSE value END AS value FROM events)"
    out = []
    for c, family in (("ts", "datetime"), ("user_id", "numeric"), ("event_type", "text"), ("value", "numeric")):
        n, t = family == "numeric", family == "text"
        v = f"CAST({c} AS DOUBLE)"
        num = (lambda x: f"round({x}, 4)") if n else (lambda x: "CAST(NULL AS DOUBLE)")
        moment = lambda k: f"(SELECT avg(power({v} - m, {k})) / power(any_value(s), {k / 2}) FROM (SELECT {c}, (SELECT avg({v}) FROM {table}) AS m, (SELECT var_pop({v}) FROM {table}) AS s FROM {table}))"
        out.append(f"""SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, {num(f"avg({v})")} AS avg, {num(f"var_pop({v})")} AS variance, {num(moment(3))} AS skewness, {num(f"{moment(4)} - 3")} AS kurtosis, {num(f"min({v})")} AS min_num, {num(f"max({v})")} AS max_num,
  {BIG(f"count(*) FILTER ({c} = 0)" if n else "NULL")} AS zero_count, {BIG(f"min(length({c}))" if t else "NULL")} AS min_length, {BIG(f"max(length({c}))" if t else "NULL")} AS max_length, {f"round(avg(length({c})), 4)" if t else "CAST(NULL AS DOUBLE)"} AS avg_length,
  {f"round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400e6, 4)" if family == "datetime" else "CAST(NULL AS DOUBLE)"} AS date_range_days, count(DISTINCT {c}) AS distinct_count, CAST(1 AS BIGINT) AS parts_read, (SELECT count(*) FROM events WHERE {day}) AS rows_read FROM {table}""")
    return _union(out)


COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": " ".join(c for c, _ in LINEITEM), "events": "event_id ts user_id event_type value props", "conversations": "conv_id turn role text", "labels": "doc_id quality toxic",
}
LINKED = {
    "integer": "region.r_regionkey nation.n_nationkey nation.n_regionkey customer.c_custkey customer.c_nationkey supplier.s_suppkey supplier.s_nationkey part.p_partkey part.p_size orders.o_orderkey orders.o_custkey lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber events.event_id events.user_id documents.doc_id documents.n_chars embeddings.vec_id embeddings.label pages.page_id benchmark.item_id labels.doc_id labels.quality labels.toxic conversations.conv_id conversations.turn",
    "text": "region.r_name nation.n_name customer.c_name customer.c_mktsegment supplier.s_name part.p_name part.p_brand part.p_type orders.o_orderstatus orders.o_orderpriority lineitem.l_returnflag lineitem.l_linestatus events.event_type events.props documents.text documents.lang documents.source pages.url pages.html benchmark.text conversations.role conversations.text",
}


def _unique_keys() -> str:
    out = []
    for t, names in COLUMNS.items():
        names = names.split()
        single = lambda c, t=t: f"(SELECT count({c}) = count(*) AND count(DISTINCT {c}) = count(*) FROM {t})"
        out += [f"SELECT '{t}' AS table_name, '{c}' AS key_columns, CAST(1 AS BIGINT) AS n_columns WHERE {single(c)}" for c in names]
        out += [f"SELECT '{t}', '{a},{b}', 2 WHERE NOT {single(a)} AND NOT {single(b)} AND (SELECT count({a}) = count(*) AND count({b}) = count(*) AND count(DISTINCT ({a}, {b})) = count(*) FROM {t})" for i, a in enumerate(names) for b in names[i + 1 :]]
    return _union(out)


def _fk_discover_all() -> str:
    """Different values by column, counted once; then pairs of columns that share all of the child's."""
    parts = []
    for kind, names in LINKED.items():
        for x in names.split():
            t, c = x.split(".")
            value = f"CAST({c} AS VARCHAR)" if kind == "integer" else c
            parts.append(f"SELECT '{kind}' AS kind, '{t}' AS t, '{c}' AS c, {value} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}")
    return f"""WITH v AS ({_union(parts)}), s AS (SELECT kind, t, c, count(*) AS d, max(n) AS most FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column, a.d AS distinct_values
FROM s a JOIN s b ON a.kind = b.kind AND a.t <> b.t AND b.most = 1 AND a.d <= b.d
JOIN v x ON x.t = a.t AND x.c = a.c JOIN v y ON y.t = b.t AND y.c = b.c AND y.v = x.v
GROUP BY ALL HAVING count(*) = a.d"""


def oracle_sql() -> dict[str, str]:
    doc = "CASE WHEN length(value) > 256 THEN sha256(value) ELSE value END"
    lengths = _union(f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER ({c} = '') AS empty_count, count(*) FILTER ({c} <> '' AND trim({c}) = '') AS whitespace_count, {BIG(f'coalesce(min(length({c})), 0)')} AS min_length, {BIG(f'coalesce(max(length({c})), 0)')} AS max_length, round(avg(length({c})), 6) AS avg_length FROM ({ORDERS})" for c in ("name", "constant_col"))
    month = "SELECT 'o_orderdate' AS column_name, period, n AS count, round(100.0 * n / t, 6) AS percentage FROM (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, (SELECT count(*) FROM orders) AS t FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12)"
    masked = "regexp_replace(regexp_replace(regexp_replace(t.value, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"
    ranks = lambda c, v: f"SELECT '{c}' AS column_name, " + ", ".join(f"CAST(quantile_disc({v}, {p}) AS DOUBLE) AS p{round(100 * p)}" for p in stats.PERCENTILES) + " FROM lineitem"
    fields = {"orders": (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")), "lineitem": LINEITEM}
    basic = [f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, round(100.0 * count(DISTINCT {c}) / count(*), 3) AS distinct_percentage, (SELECT round(100.0 * max(n) / sum(n), 3) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) AS top_percentage, {f'round(avg({c}), 3)' if t in ('bigint', 'double') else 'CAST(NULL AS DOUBLE)'} AS avg, {f'round(stddev_pop({c}), 3)' if t in ('bigint', 'double') else 'CAST(NULL AS DOUBLE)'} AS stddev, false AS more FROM lineitem" for c, t in LINEITEM if c in ("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")]
    before = f"SELECT snapshot_id, created_at, total_rows, {BIG('d.d')} AS duplicate_rows, score FROM ({_SNAPSHOTS}) s JOIN ({_DY}) d ON CAST(d.g AS VARCHAR) = s.snapshot_id WHERE created_at < TIMESTAMP '1999-01-01 00:00:00' ORDER BY created_at DESC LIMIT 1"
    return {
        "column_completeness": _completeness("SELECT * FROM lineitem", [c for c, _ in LINEITEM]),
        "text_blank_stats": lengths,
        "numeric_basic": _union([_basic("dirty_orders", ORDERS, ["id", "amount", "score"]), _basic("lineitem", "SELECT * FROM lineitem", [c for c, t in LINEITEM if t in ("bigint", "int", "double")])]),
        "numeric_moments": _union(_moments(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
        "numeric_percentiles": _union([_quantiles("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount")] + [_quantiles("events", "value")]),
        "numeric_outliers": _union([_outliers("events", "SELECT * FROM events", "value"), _outliers("dirty_orders", ORDERS, "amount"), _outliers("dirty_orders", ORDERS, "score")]),
        "numeric_histogram": _union(_histogram(c) for c in ("o_totalprice", "o_custkey")),
        "datetime_stats": _union([_dates("orders", "o_orderdate"), _dates("events", "ts")]),
        "date_distribution": month,
        "top_values": _union([_top("events", "SELECT * FROM events", c) for c in ("event_type", "user_id")] + [_top("part", "SELECT * FROM part", c) for c in ("p_brand", "p_type", "p_size")] + [_top("documents", "SELECT * FROM documents", "text", doc)]),
        "string_patterns": _union([_patterns("pages", "SELECT * FROM pages", "url")] + [_patterns("contacts", CONTACTS, c) for c in CONTACT_COLUMNS]),
        "text_entropy": _union([_entropy("orders", c) for c in ("o_orderpriority", "o_orderstatus")] + [_entropy("part", c) for c in ("p_brand", "p_type", "p_name")]),
        "numeric_correlations": f"SELECT * FROM ({_correlations()}) WHERE coefficient IS NOT NULL AND NOT isnan(coefficient)",
        "duplicate_rows": _DUPLICATES,
        "duplicate_rows_fingerprint": _DUPLICATES,
        "keyed_sample_profile": _completeness("SELECT * FROM orders WHERE (o_orderkey * 7919) % 1000000 < 100000", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
        "pii_header": _header(),
        "pii_value_ratio": f"SELECT column_name, label, round(ratio, 6) AS ratio FROM ({_ratios(_CONTACT_VALUES)})",
        "pii_detect": _CONTACT_LABELS,
        "masked_top_values": f"SELECT t.column_name, t.rank, CASE WHEN l.pii <> '' THEN {masked} ELSE t.value END AS value, t.n AS count FROM ({_CONTACT_TOP}) t JOIN ({_CONTACT_LABELS}) l ON l.column_name = t.column_name",
        "quality_checks": f"SELECT * EXCLUDE (g) FROM ({_checks(_P, _D, _DEFAULT)})",
        "quality_score": f"SELECT CAST(greatest(0, 100 - sum(points)) AS DOUBLE) AS score FROM ({_checks(_P, _D, _DEFAULT)})",
        "quality_custom_rules": f"SELECT * EXCLUDE (g) FROM ({_checks(_P, _D, queries.RULES)})",
        "snapshot_history": f"SELECT * FROM ({_SNAPSHOTS}) WHERE rank <= 3",
        "snapshot_latest": f"SELECT * EXCLUDE (rank) FROM ({_SNAPSHOTS}) WHERE rank = 1",
        "drift_history": f"{_CHANGES} ({_drift()})",
        "drift_changes": f"{_CHANGES} ({_drift()}) WHERE g = (SELECT max(g) FROM ({_DY}))",
        "drift_report": f"SELECT CAST(b.g AS VARCHAR) AS snapshot_id, coalesce(n, 0) > 0 AS changed, b.score - a.score AS score_delta, coalesce(n, 0) AS n_changes FROM ({_SCORES}) a JOIN ({_SCORES}) b ON b.g = a.g + 1 LEFT JOIN (SELECT g, count(*) AS n FROM ({_drift()}) GROUP BY 1) c ON c.g = b.g",
        "fk_check": _fk_check(),
        "fk_discover": _fk_discover(),
        "discover_columns": "SELECT d.table_name, d.column_name, d.ordinal, d.data_type, d.nullable, n.total_rows, n.null_count FROM (" + _catalogue(fields) + ") d JOIN (" + _union(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count FROM {t}" for t, cs in fields.items() for c, _ in cs) + ") n ON n.table_name = d.table_name AND n.column_name = d.column_name",
        "snapshot_previous": _union(f"SELECT '{x}' AS table_name, * FROM ({before})" for x in ("table", "json")),
        "run_checks": f"SELECT * EXCLUDE (g) FROM ({_checks(_P2, _DUP2, _DEFAULT)})",
        "run_drift": _run_drift(),
        "pii_headed": _headed(),
        "basic_tier_columns": _union(basic),
        "approx_distinct": _union(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM lineitem" for c, _ in LINEITEM),
        "approx_percentiles": _union([ranks("l_quantity", "l_quantity"), ranks("thousands", "CAST(floor(l_extendedprice / 1000) AS BIGINT)")]),
        "profile_by_partition": _partitions(),
        "profile_lineitem": _lineitem(),
        "percentiles_by_group": "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 4) AS p{round(100 * p)}" for p in stats.PERCENTILES) + " FROM events GROUP BY event_type",
        "kll_percentiles": _union(f"SELECT '{c}' AS column_name, 'p{round(100 * p)}' AS percentile, round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS value FROM lineitem" for c in ("l_extendedprice", "l_quantity", "l_partkey") for p in stats.PERCENTILES),
        "heavy_hitters": _union([_top("events", "SELECT * FROM events", c) for c in ("event_type", "user_id", "event_id")] + [_top("part", "SELECT * FROM part", c) for c in ("p_brand", "p_type", "p_size")] + [_top("documents", "SELECT * FROM documents", "lang"), _top("documents", "SELECT * FROM documents", "text", doc)]),
        "exact_size_sample": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderkey * 7919 % 1000003 LIMIT 1000",
        "basic_tier_estimated": _estimated(),
        "profile_all_parts": _all_parts(),
        "snapshot_retried": _retried(),
        "profile_documents": _documents(),
        "incremental_profile": _incremental(),
        "unique_keys": _unique_keys(),
        "fk_discover_all": _fk_discover_all(),
        "composite_link": f"SELECT count(*) AS filled_rows, count(*) FILTER (NOT ok) AS orphan_rows, round({_pct('count(*) FILTER (ok)', 'count(*)')}, 6) AS match_percentage FROM (SELECT (o_custkey, o_orderstatus) IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE o_orderkey % 2 = 0) AS ok FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL)",
    }
