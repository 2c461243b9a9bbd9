"""DuckDB SQL for the same questions, built as a chain of CTEs over the raw tables.

Used only as the independent oracle for the Spark queries (``oracle_sql()``).
"""

from __future__ import annotations

from ..config import (ALERT_MESSAGE, CRITICAL_DEFAULT_DAYS, EVENTS_SPEC, FAULT_TYPES, GRADES, NO_FAULT,
                      PRIORITY_ACTIONS, PRIORITY_DAYS, STATUS_ISSUE_CRITICAL, STATUS_ISSUE_MAINT, STATUS_ISSUE_OK,
                      STATUS_ISSUE_OVERDUE, SensorSpec)
from ..sources.adapters import FAILURE_VALUE, FAULT_BUCKET, SIGNAL_FLOOR

US_PER_DAY = "CAST(86400000000 AS DOUBLE)"
US_PER_HOUR = "CAST(3600000000 AS DOUBLE)"
ORDER = "PARTITION BY well_id ORDER BY t_us, record_id"


def order(spec: SensorSpec) -> str:
    return "PARTITION BY well_id ORDER BY " + ", ".join(spec.order_cols)


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def half_even(expr: str, digits: int) -> str:
    """Spark ``bround`` on a double works on its shortest decimal text."""
    return f"CAST(round_even(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def title(expr: str) -> str:
    cases = " ".join(f"WHEN '{f}' THEN '{f.replace('_', ' ').title()}'" for f in (*FAULT_TYPES, NO_FAULT))
    return f"(CASE {expr} {cases} END)"


def thousands(expr: str) -> str:
    return f"format('{{:,.0f}}', {expr})"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **parts: str) -> str:
    """A fixed text with ``{name}`` slots as a SQL concatenation."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [q(head), parts[name]]
    out.append(q(rest))
    return "(" + " || ".join(out) + ")"


def bands(expr: str, cuts, default: str, op: str) -> str:
    cases = " ".join(f"WHEN {expr} {op} {cut} THEN {q(b)}" for cut, b in cuts)
    return f"(CASE {cases} ELSE {q(default)} END)"


def grade(expr: str) -> str:
    cases = " ".join(f"WHEN {expr} >= {cut} THEN {q(g)}" for cut, g in GRADES)
    return f"(CASE {cases} ELSE 'C' END)"


def alert_message(well: str, days_text: str, pct_text: str) -> str:
    return fill(ALERT_MESSAGE, well=well, days=days_text, pct=pct_text)


def events_readings() -> str:
    k = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    faults = ", ".join(f"'{f}'" for f in FAULT_TYPES)
    return f"""readings AS (
  SELECT event_id AS record_id,
         printf('WELL_%04d', user_id) AS well_id,
         ts AS "timestamp",
         epoch_us(ts) AS t_us,
         CAST(5000 + user_id AS INTEGER) AS depth_ft,
         CASE WHEN {k} >= {SIGNAL_FLOOR} THEN value END AS value,
         {k} AS signal,
         CASE WHEN event_type = 'error' AND value >= {FAILURE_VALUE}
              THEN ([{faults}])[CAST(floor({k} / {FAULT_BUCKET}) AS INTEGER) + 1]
              ELSE '{NO_FAULT}' END AS failure_type
  FROM events)"""


def labeled(spec: SensorSpec = EVENTS_SPEC, src: str = "readings", name: str = "labeled") -> str:
    h = spec.thresholds.label_horizon_days
    ORDER = order(spec)
    fail = f"CASE WHEN failure_type <> '{NO_FAULT}' THEN t_us END"
    return f"""{name}_w AS (
  SELECT *,
    min({fail}) OVER ({ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _nf,
    max({fail}) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _lf,
    min(t_us) OVER (PARTITION BY well_id) AS _f0
  FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_nf, _lf, _f0), _nf AS next_failure_us,
    CAST(_nf - t_us AS DOUBLE) / {US_PER_DAY} AS days_to_failure,
    COALESCE(CAST(CAST(_nf - t_us AS DOUBLE) / {US_PER_DAY} <= {h} AS INTEGER), 0) AS maintenance_required,
    CAST(t_us - COALESCE(_lf, _f0) AS DOUBLE) / {US_PER_HOUR} AS hours_since_last_maintenance,
    CAST(t_us - _f0 AS DOUBLE) / {US_PER_HOUR} AS cumulative_operating_hours
  FROM {name}_w)"""


def imputed(cols, src: str = "labeled", name: str = "imputed", spec: SensorSpec = EVENTS_SPEC) -> str:
    ORDER = order(spec)
    w = f"({ORDER} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    first = ", ".join(f"COALESCE({c}, median({c}) OVER {w}) AS {c}" for c in cols)
    second = ", ".join(f"COALESCE({c}, (SELECT median({c}) FROM {name}_1)) AS {c}" for c in cols)
    return f"""{name}_1 AS (SELECT * REPLACE ({first}) FROM {src}),
{name} AS (SELECT * REPLACE ({second}) FROM {name}_1)"""


def features(spec: SensorSpec = EVENTS_SPEC, src: str = "imputed", name: str = "features") -> str:
    p, v, t = spec.pressure, spec.vibration, spec.temperature
    ORDER = order(spec)
    w4 = f"({ORDER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    w24 = f"({ORDER} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    return f"""{name}_n AS (SELECT *, row_number() OVER ({ORDER}) AS _rn FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_rn),
    avg({p}) OVER {w4} AS pressure_rolling_mean,
    COALESCE(stddev_samp({p}) OVER {w4}, 0.0) AS pressure_rolling_std,
    max({v}) OVER {w4} AS vibration_rolling_max,
    avg({t}) OVER {w4} AS temp_rolling_mean,
    COALESCE({p} - lag({p}) OVER ({ORDER}), 0.0) AS pressure_change_rate,
    COALESCE(CASE WHEN count({v}) OVER {w24} >= 2 THEN regr_slope({v}, CAST(_rn AS DOUBLE)) OVER {w24} END, 0.0)
      AS vibration_trend,
    hours_since_last_maintenance / CAST({spec.thresholds.age_divisor_hours} AS DOUBLE) AS maintenance_age_ratio
  FROM {name}_n)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def events_chain(upto: str = "labeled") -> str:
    parts = [events_readings(), labeled()]
    if upto in ("imputed", "features"):
        parts.append(imputed(EVENTS_SPEC.impute_cols))
    if upto == "features":
        parts.append(features())
    return with_ctes(*parts)


def latest(cols, src: str, name: str = "latest", spec: SensorSpec = EVENTS_SPEC) -> str:
    ORDER = order(spec)
    aggs = ", ".join(f"arg_max({c}, _rn) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in cols)
    return f"""{name}_n AS (SELECT *, row_number() OVER ({ORDER}) AS _rn FROM {src}),
{name} AS (SELECT well_id, {aggs} FROM {name}_n GROUP BY well_id)"""


def status_select(spec: SensorSpec = EVENTS_SPEC) -> str:
    o = spec.thresholds.overdue_hours
    crit = f"maintenance_required = 1 AND failure_type <> '{NO_FAULT}'"
    maint = "maintenance_required = 1"
    over = f"hours_since_last_maintenance > {o}"
    return f"""SELECT well_id,
  CASE WHEN {crit} THEN 'CRITICAL' WHEN {maint} THEN 'WARNING' WHEN {over} THEN 'WARNING' ELSE 'OK' END AS status,
  CASE WHEN {crit} THEN 0 WHEN {maint} THEN 1 WHEN {over} THEN 1 ELSE 2 END AS urgency,
  CASE WHEN {crit} THEN {fill(STATUS_ISSUE_CRITICAL, fault=title('failure_type'))}
       WHEN {maint} THEN {q(STATUS_ISSUE_MAINT)}
       WHEN {over} THEN {fill(STATUS_ISSUE_OVERDUE, hours=thousands('hours_since_last_maintenance'))}
       ELSE {q(STATUS_ISSUE_OK)} END AS issue,
  {title('failure_type')} AS fault_type,
  {half_even(spec.pressure, 1)} AS pump_psi,
  {half_even(spec.vibration, 2)} AS vibration,
  {half_even(spec.temperature, 1)} AS temperature,
  CAST(trunc(hours_since_last_maintenance) AS INTEGER) AS hrs_since_maint"""


def priority_select(spec: SensorSpec = EVENTS_SPEC, now_us: str = "_now") -> str:
    o = spec.thresholds.overdue_hours
    crit = f"maintenance_required = 1 AND failure_type <> '{NO_FAULT}'"
    maint = "maintenance_required = 1"
    over = f"hours_since_last_maintenance > {o}"
    fixed = dict(PRIORITY_DAYS)
    (p0, a0), (p1, a1), (p2, a2), (p3, a3) = PRIORITY_ACTIONS
    days = (f"(CASE WHEN {crit} THEN COALESCE(days_to_failure, {CRITICAL_DEFAULT_DAYS}) WHEN {maint} THEN {fixed[p1]} "
            f"WHEN {over} THEN {fixed[p2]} ELSE {fixed[p3]} END)")
    return f"""SELECT well_id,
  CASE WHEN {crit} THEN {q(p0)} WHEN {maint} THEN {q(p1)} WHEN {over} THEN {q(p2)} ELSE {q(p3)} END AS priority,
  CASE WHEN {crit} THEN 0 WHEN {maint} THEN 1 WHEN {over} THEN 2 ELSE 3 END AS priority_order,
  {title('failure_type')} AS fault_type,
  CASE WHEN {crit} THEN {q(a0)} WHEN {maint} THEN {q(a1)} WHEN {over} THEN {q(a2)} ELSE {q(a3)} END AS action,
  {half_even(days, 1)} AS days_remaining,
  strftime(make_timestamp({now_us} + CAST(trunc(greatest({days}, 0.0) * {US_PER_DAY}) AS BIGINT)), '%b %d, %Y') AS schedule_by,
  CAST(trunc(hours_since_last_maintenance) AS INTEGER) AS hrs_since_service"""


def scoring(feats, prob: str, days_raw: str, src: str = "features", fit_on: str = "train",
            q: float = 0.95, label: str = "maintenance_required", record: str = "record_id") -> list:
    """CTEs: split → scaler stats → z-score reconstruction error, probability, raw days → threshold → decisions."""
    fit_filter = "WHERE split = 'train'" if fit_on == "train" else ""
    stats = ", ".join(f"avg({c}) AS m_{i}, stddev_pop({c}) AS s_{i}" for i, c in enumerate(feats))
    z = [f"(({c} - m_{i}) / (CASE WHEN s_{i} IS NULL OR s_{i} = 0 THEN 1.0 ELSE s_{i} END))" for i, c in enumerate(feats)]
    zcols = ", ".join(f"{e} AS {c}_z" for e, c in zip(z, feats))
    err = " + ".join(f"power({e}, 2)" for e in z)
    return [
        f"split AS (SELECT *, CASE WHEN md5(CAST({record} AS VARCHAR) || ':42') < '33333333' THEN 'test' ELSE 'train' END AS split FROM {src})",
        f"stats AS (SELECT {stats} FROM split {fit_filter})",
        f"""scored AS (SELECT split.*, {zcols}, ({err}) / {float(len(feats))} AS anomaly_score,
       {prob} AS confidence_score, {days_raw} AS days_raw FROM split, stats)""",
        f"thr AS (SELECT quantile_cont(anomaly_score, {q}) AS threshold FROM scored WHERE split = 'train' AND {label} = 0)",
        """decided AS (SELECT scored.*, threshold, CAST(confidence_score >= 0.5 AS INTEGER) AS predicted_failure,
       least(greatest(days_raw, 0.0), 30.0) AS days_to_failure_pred, anomaly_score > threshold AS is_anomaly
       FROM scored, thr)""",
    ]


def lineitem_readings() -> str:
    return f"""readings AS (
  SELECT l_orderkey * 16 + l_linenumber AS record_id,
         printf('SUPP_%06d', l_suppkey) AS well_id,
         l_shipdate AS "timestamp",
         epoch_us(l_shipdate) AS t_us,
         CAST(1000 + l_suppkey AS INTEGER) AS depth_ft,
         l_orderkey, l_linenumber, l_partkey,
         l_quantity + 0.0 AS l_quantity, l_extendedprice + 0.0 AS l_extendedprice,
         l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax,
         CASE WHEN l_returnflag = 'R' THEN '{FAULT_TYPES[0]}' ELSE '{NO_FAULT}' END AS failure_type
  FROM lineitem)"""
