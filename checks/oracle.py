"""The SQL each registered query is checked against, for DuckDB.

Written from the definition of each operator, not from its Spark plan: whole
microsecond sums, filters and plain windows over the derived task log.
"""

from __future__ import annotations

TASK_LOG = """
e AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
         ts + INTERVAL '1' DAY * (2 * (day(ts) - 1)) AS done_at
  FROM events
), log AS (
  SELECT
    event_id AS seq,
    CASE WHEN event_id % 50 = 7 THEN NULL
         WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS protocol_id,
    CASE WHEN user_id = 0 THEN NULL
         WHEN user_id % 15 = 12 THEN 'Robot_Hub'
         WHEN user_id % 15 >= 13 THEN concat('analyst_', CAST(user_id % 15 AS STRING), '_ter')
         ELSE concat('analyst_', lpad(CAST(user_id % 15 AS STRING), 2, '0')) END AS analyst,
    CASE event_id % 20 WHEN 0 THEN 'Cancelled' WHEN 1 THEN 'Open' ELSE 'Finished' END AS status,
    CASE event_type WHEN 'signup' THEN 'REGISTERED' WHEN 'purchase' THEN 'UPDATED'
                    WHEN 'view' THEN 'DISTRIBUTED' WHEN 'click' THEN 'AUDITED'
         ELSE CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'BATCH_CLOSED'
                                WHEN 2 THEN 'WITHDRAWN' ELSE 'REGISTERED' END END AS outcome,
    CASE k % 16 WHEN 0 THEN 'REG EMAIL' WHEN 1 THEN 'OFFICIAL LETTERS' WHEN 2 THEN 'AGENCIES'
      WHEN 3 THEN 'PRE REG' WHEN 4 THEN 'PRE REG B' WHEN 5 THEN 'REG FINES' WHEN 6 THEN 'AUDIT'
      WHEN 7 THEN 'DIST' WHEN 8 THEN 'DIST A' WHEN 9 THEN 'DOUBT' WHEN 10 THEN 'Unknown'
      WHEN 11 THEN 'REG SHARED' WHEN 12 THEN 'REG SUMMONS' WHEN 13 THEN 'INCIDENT'
      WHEN 14 THEN 'Distribution' ELSE NULL END AS queue,
    CASE event_id % 3 WHEN 0 THEN 'NEW CASE' WHEN 1 THEN 'NEW DOC' ELSE 'REVIEW' END AS task_type,
    CASE event_id % 5 WHEN 0 THEN 'CIVIL' WHEN 1 THEN 'LABOUR' WHEN 2 THEN 'TAX'
                      WHEN 3 THEN 'FINES' ELSE NULL END AS module,
    CASE k % 7 WHEN 0 THEN NULL ELSE concat('CAUSE ', CAST(k % 7 AS STRING)) END AS cause,
    CASE k % 8 WHEN 0 THEN 'No deviation' WHEN 1 THEN 'date' WHEN 2 THEN 'date, party'
               WHEN 3 THEN 'party,value , court' WHEN 4 THEN 'value,,date'
               ELSE NULL END AS deviations,
    CASE WHEN event_id % 50 = 0 THEN NULL
         ELSE CAST(round(value * 60) AS BIGINT) * 1000000 END AS duration_us,
    done_at AS completed_at,
    CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'FAST'
               ELSE concat('PORTFOLIO ', CAST(k % 5 AS STRING)) END AS portfolio,
    CASE event_id % 4 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'RECLASSIFIED' WHEN 2 THEN 'IN_PROGRESS'
                      ELSE 'OTHER' END AS portfolio_status,
    CAST(round(value * 6) AS BIGINT) * 1000000 AS analysis_us,
    CASE WHEN event_id % 97 = 0 THEN NULL
         ELSE done_at - INTERVAL '1' SECOND * CAST(round(value * 60) AS INT) END AS started_at
  FROM e
)"""

CLAMP = """
    CASE WHEN duration_us > 7200000000 THEN 7200000000
         WHEN outcome = 'REGISTERED' AND duration_us < 1140000000 THEN 1200000000
         WHEN outcome = 'UPDATED' AND duration_us < 180000000 THEN 180000000
         WHEN outcome = 'UPDATED' AND duration_us > 900000000 THEN 900000000
         ELSE duration_us END"""

#: The log as an upload shows it: unreadable durations and times are null.
SHOWN = """
  SELECT seq, CAST(protocol_id AS STRING) AS protocol_id, analyst, status, outcome, queue,
         CASE WHEN seq % 30 <> 11 THEN duration_us END AS duration_us,
         CASE WHEN seq % 40 <> 13 THEN date_trunc('second', completed_at) END AS completed_at
  FROM log"""

PERSON = "analyst IS NOT NULL AND lower(analyst) <> 'robot_hub'"

CLEAN = f"""{TASK_LOG}, clean AS (
  SELECT * REPLACE ({CLAMP} AS duration_us),
         CAST(completed_at AS DATE) AS d, strftime(completed_at, '%Y-%m') AS ym
  FROM log WHERE {PERSON}
)"""

INTERVALS = """
iv AS (
  SELECT ts AS start_at, ts + INTERVAL '1' SECOND * CAST(round(value * 60) AS INT) AS end_at
  FROM events WHERE event_type = 'error'
), clip AS (
  SELECT CAST(start_at AS DATE) AS d,
         greatest(start_at, CAST(CAST(start_at AS DATE) AS TIMESTAMP) + INTERVAL 8 HOUR) AS s,
         least(end_at, CAST(CAST(end_at AS DATE) AS TIMESTAMP) + INTERVAL 18 HOUR) AS t
  FROM iv
), cut AS (SELECT *, greatest(epoch_us(t) - epoch_us(s), 0) AS us FROM clip)"""

REG, UPD = "outcome = 'REGISTERED'", "outcome = 'UPDATED'"
DIST, AUD = "outcome = 'DISTRIBUTED'", "outcome = 'AUDITED'"
PROD = "outcome IN ('REGISTERED', 'UPDATED', 'DISTRIBUTED')"
HANDLED = "outcome IN ('REGISTERED', 'UPDATED')"
NEITHER = "(outcome IS NULL OR outcome NOT IN ('REGISTERED', 'UPDATED'))"
AUDITS = "queue = 'AUDIT' AND outcome = 'AUDITED'"
SPREAD = "queue IN ('DIST', 'DIST A') AND outcome = 'DISTRIBUTED'"
ROSTER = (
    "analyst IS NOT NULL AND analyst NOT LIKE '%\\_ter%' ESCAPE '\\'"
    " AND analyst NOT IN ('analyst_03', 'analyst_07')"
)
DOUBT = "coalesce(queue = 'DOUBT' AND duration_us > 3600000000, false)"
PERIOD = "d BETWEEN DATE '2024-01-15' AND DATE '2024-02-20'"
BEFORE = "d BETWEEN DATE '2024-01-01' AND DATE '2024-02-10'"
AFTER = "d BETWEEN DATE '2024-02-01' AND DATE '2024-03-31'"
CHOSEN = (
    "chosen(analyst) AS (VALUES ('analyst_00'), ('analyst_01'), ('analyst_02'),"
    " ('analyst_05'), ('analyst_13_ter'), ('nobody'))"
)


def n(when: str) -> str:
    return f"count(*) FILTER (WHERE {when})"


def us(when: str = "true", column: str = "duration_us") -> str:
    """Mean of the known durations, whole microseconds."""
    known = f"count({column}) FILTER (WHERE {when})"
    return f"CAST(sum({column}) FILTER (WHERE {when}) // nullif({known}, 0) AS BIGINT)"


def mean(when: str = "true", column: str = "duration_us") -> str:
    """Mean of the known durations, whole seconds."""
    known = f"count({column}) FILTER (WHERE {when})"
    return f"CAST(sum({column}) FILTER (WHERE {when}) // (1000000 * nullif({known}, 0)) AS BIGINT)"


def per_task(when: str = "true") -> str:
    """Time over the number of tasks, unknown as zero, whole seconds."""
    time = f"coalesce(sum(duration_us) FILTER (WHERE {when}), 0)"
    return f"CAST({time} // (1000000 * nullif({n(when)}, 0)) AS BIGINT)"


def zero(x: str) -> str:
    return f"coalesce({x}, 0)"


def hms(s: str) -> str:
    s = zero(f"({s})")
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60)"


def min_sec(s: str) -> str:
    s = f"({s})"
    return f"CASE WHEN {s} IS NULL THEN '0 min' ELSE printf('%d min %ds', {s} // 60, {s} % 60) END"


def h_mm_ss(s: str) -> str:
    s = f"({s})"
    days = (
        f"CASE WHEN {s} >= 172800 THEN printf('%d days, ', {s} // 86400)"
        f" WHEN {s} >= 86400 THEN '1 day, ' ELSE '' END"
    )
    rest = f"printf('%d:%02d:%02d', {s} % 86400 // 3600, {s} % 3600 // 60, {s} % 60)"
    return f"CASE WHEN {s} IS NULL THEN '00:00:00' ELSE concat({days}, {rest}) END"


def clean(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([CLEAN, *ctes])}\n{body}"


def raw(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([TASK_LOG, *ctes])}\n{body}"


def band(position: str, size_of: str) -> str:
    size = f"(CASE WHEN {size_of} > 12 THEN 4 ELSE ({size_of} + 3) // 4 END)"
    return f"CAST(least(4, ({position} + {size} - 1) // {size}) AS BIGINT)"


def ranking(rule: str) -> str:
    totals = (
        f"totals AS (SELECT analyst, count(*) AS total, {mean()} AS tmo_s"
        f" FROM clean WHERE {rule} AND {ROSTER} GROUP BY analyst)"
    )
    placed = (
        "placed AS (SELECT *, row_number() OVER (ORDER BY total DESC, analyst) AS position,"
        " count(*) OVER () AS size FROM totals)"
    )
    return clean(
        f"SELECT position, analyst, total, tmo_s, {hms('tmo_s')} AS tmo,"
        f" {band('position', 'size')} AS band FROM placed",
        totals,
        placed,
    )


RULES = {
    "updates": UPD,
    "registration": f"{REG} AND (queue IS NULL OR queue NOT IN"
    " ('OFFICIAL LETTERS', 'PRE REG', 'PRE REG B', 'AGENCIES', 'REG FINES'))",
    "pre_registration": f"{REG} AND queue IN ('PRE REG', 'PRE REG B')",
    "official_letters": f"{REG} AND queue = 'OFFICIAL LETTERS'",
    "agencies": f"{REG} AND queue = 'AGENCIES'",
    "audit": AUDITS,
    "distribution": SPREAD,
}

ALL_RANKINGS = clean(
    f"SELECT ranking, position, analyst, total, tmo_s, {hms('tmo_s')} AS tmo,"
    f" {band('position', 'size')} AS band FROM placed",
    "totals AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS ranking, analyst, count(*) AS total, {mean()} AS tmo_s"
        f" FROM clean WHERE {rule} GROUP BY analyst"
        for name, rule in RULES.items()
    )
    + ")",
    "placed AS (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY total DESC, analyst)"
    " AS position, count(*) OVER (PARTITION BY ranking) AS size FROM totals)",
)

OVERALL_TOTALS = (
    f"totals AS (SELECT analyst, {n(REG)} AS registered, {n(DIST)} AS distributed,"
    f" {n(UPD)} AS updated, {n(PROD)} AS total FROM clean WHERE %s GROUP BY analyst)"
)
OVERALL_PLACED = (
    "placed AS (SELECT *, row_number() OVER (ORDER BY total DESC, analyst) AS position,"
    " count(*) OVER () AS size FROM totals)"
)
RANK_OVERALL = clean(
    "SELECT position, analyst, registered, distributed, updated, total,"
    f" {band('position', 'size')} AS band FROM placed",
    OVERALL_TOTALS % "true",
    OVERALL_PLACED,
)

KPI_KINDS = {"registered": REG, "updated": UPD, "distributed": DIST, "audited": AUD, "total": PROD}
OVERVIEW_KPIS = clean(
    "SELECT "
    + ", ".join(f"{n(c)} AS {k}" for k, c in KPI_KINDS.items())
    + ", "
    + ", ".join(f"{zero(per_task(c))} AS {k}_tmo_s" for k, c in KPI_KINDS.items())
    + ", "
    + ", ".join(f"{min_sec(zero(per_task(c)))} AS {k}_tmo_text" for k, c in KPI_KINDS.items())
    + " FROM clean"
)

OUTSIDE = (
    "(outcome IS NULL OR outcome NOT IN"
    " ('REGISTERED', 'UPDATED', 'DISTRIBUTED', 'BATCH_CLOSED'))"
)
QUEUE_SUMMARY = clean(
    "SELECT p.queue, part, tasks, registered, updated, out_of_scope,"
    f" {hms('reg_s')} AS registered_tmo, {hms('upd_s')} AS updated_tmo,"
    f" {hms('out_s')} AS out_of_scope_tmo"
    " FROM parts p LEFT JOIN scope USING (queue) LEFT JOIN outside USING (queue)",
    "timed AS (SELECT * FROM clean WHERE duration_us IS NOT NULL)",
    f"base AS (SELECT queue, count(*) AS tasks, {n(REG)} AS registered, {n(UPD)} AS updated"
    f" FROM timed WHERE {HANDLED} AND queue <> 'Distribution' GROUP BY queue)",
    f"reg AS (SELECT queue, {mean()} AS reg_s FROM timed WHERE {REG} GROUP BY queue)",
    f"upd AS (SELECT queue, {mean()} AS upd_s FROM timed WHERE {UPD} GROUP BY queue)",
    "parts AS (SELECT queue, 'handled' AS part, tasks, registered, updated, reg_s, upd_s"
    " FROM base LEFT JOIN reg USING (queue) LEFT JOIN upd USING (queue)"
    f" UNION ALL SELECT queue, 'distribution', count(*), NULL, NULL, {mean()}, NULL"
    f" FROM timed WHERE {SPREAD} GROUP BY queue"
    f" UNION ALL SELECT queue, 'audit', count(*), NULL, NULL, {mean()}, NULL"
    f" FROM timed WHERE {AUDITS} GROUP BY queue)",
    "firsts AS (SELECT * FROM timed QUALIFY row_number()"
    " OVER (PARTITION BY protocol_id ORDER BY seq) = 1)",
    f"scope AS (SELECT queue, count(*) - {n(REG)} - {n(UPD)} AS out_of_scope"
    " FROM firsts GROUP BY queue)",
    f"outside AS (SELECT queue, {mean()} AS out_s FROM timed WHERE {OUTSIDE} GROUP BY queue)",
)

SPLIT = f"{n(REG)} AS registered, {n(UPD)} AS updated, {n(NEITHER)} AS neither"
GROUP_OF = (
    "CASE WHEN queue IN (' REG ROBOT', 'INCIDENT', 'REG ANS') THEN 'CAPTURE'"
    " WHEN queue IN ('REG SHARED', 'UPD SHARED') THEN 'SHARED'"
    " WHEN queue IN ('REG SUMMONS', 'UPD SUMMONS') THEN 'SUMMONS'"
    " WHEN queue IN ('REG EMAIL', 'OFFICIAL LETTERS EMAIL', 'AGENCIES') THEN 'EMAIL'"
    " WHEN queue = 'PRE REG' THEN 'PRE' ELSE 'OTHER' END"
)

MONTH_KINDS = {"overall": PROD, "registered": REG, "updated": UPD, "audited": AUD}
ANALYST_MONTH_KINDS = {**MONTH_KINDS, "overall": f"({PROD} OR {AUD})"}


def monthly(kinds: dict[str, str], keys: str, fill: bool) -> str:
    def value(c: str) -> str:
        return zero(mean(c)) if fill else mean(c)

    return (
        f"m AS (SELECT {keys}, "
        + ", ".join(f"{value(c)} AS {k}_tmo_s" for k, c in kinds.items())
        + f" FROM clean GROUP BY {keys} HAVING {n(kinds['overall'])} > 0)"
    )


def monthly_wide(kinds: dict[str, str], keys: str, shown: str, fill: bool) -> str:
    return clean(
        f"SELECT {shown}, "
        + ", ".join(f"{k}_tmo_s" for k in kinds)
        + ", "
        + ", ".join(f"{hms(f'{k}_tmo_s')} AS {k}_tmo" for k in kinds)
        + " FROM m",
        monthly(kinds, keys, fill),
    )


def monthly_long(kinds: dict[str, str], keys: str, shown: str, fill: bool) -> str:
    return clean(
        " UNION ALL ".join(
            f"SELECT {shown}, '{k}' AS kind, {k}_tmo_s AS tmo_s,"
            f" concat('{k.capitalize()} - ', {hms(f'{k}_tmo_s')}) AS label FROM m"
            for k in kinds
        ),
        monthly(kinds, keys, fill),
    )


DEVIATIONS = (
    "dev AS (SELECT trim(unnest(string_split(deviations, ','))) AS deviation FROM clean"
    " WHERE deviations IS NOT NULL)",
    "counted AS (SELECT deviation, count(*) AS frequency FROM dev GROUP BY deviation)",
)

BEST = f"{HANDLED} AND queue IS NOT NULL AND analyst NOT LIKE '%\\_ter%' ESCAPE '\\'"

COUNTED = f"(queue IS NULL OR queue <> 'Unknown') AND NOT {DOUBT}"
METRICS = (
    f"metrics AS (SELECT analyst, {n(f'{COUNTED} AND {REG}')} AS registered,"
    f" {n(f'{COUNTED} AND {UPD}')} AS updated, {n(f'{COUNTED} AND {DIST}')} AS distributed,"
    f" {n(f'{COUNTED} AND {PROD}')} AS total,"
    f" {zero(per_task(f'{COUNTED} AND {PROD}'))} AS tmo_s,"
    f" {zero(per_task(f'{COUNTED} AND {REG}'))} AS registered_tmo_s,"
    f" {zero(per_task(f'{COUNTED} AND {UPD}'))} AS updated_tmo_s,"
    f" coalesce(sum(duration_us) FILTER (WHERE {COUNTED} AND {REG}), 0)"
    f" // nullif({n(f'{COUNTED} AND {REG}')}, 0) AS reg_us,"
    f" coalesce(sum(duration_us) FILTER (WHERE {COUNTED} AND {UPD}), 0)"
    f" // nullif({n(f'{COUNTED} AND {UPD}')}, 0) AS upd_us,"
    f" count(DISTINCT d) FILTER (WHERE {COUNTED} AND {REG}) AS days_worked"
    " FROM clean GROUP BY analyst)"
)
ANALYST_METRICS = clean(
    "SELECT analyst, registered, updated, distributed, total, tmo_s, registered_tmo_s,"
    " updated_tmo_s, days_worked,"
    " coalesce(registered // nullif(days_worked, 0), 0) AS registered_per_day FROM metrics",
    METRICS,
)


def idle(source: str) -> tuple[str, str]:
    return (
        "nexts AS (SELECT analyst, CAST(completed_at AS DATE) AS d,"
        " epoch_us(lead(started_at) OVER (PARTITION BY analyst ORDER BY started_at, seq))"
        f" - epoch_us(completed_at) AS gap FROM {source}"
        " WHERE started_at IS NOT NULL AND completed_at IS NOT NULL)",
        "idle AS (SELECT analyst, d, CAST(sum(CASE WHEN gap > 0 AND gap <= 3600000000 THEN gap"
        " ELSE 0 END) AS BIGINT) AS idle_us FROM nexts GROUP BY analyst, d)",
    )


REGISTERED_DAYS = (
    f"days AS (SELECT analyst, d, count(*) AS n, {us()} AS mean_us, {mean()} AS tmo_s"
    f" FROM clean WHERE {REG} GROUP BY analyst, d)"
)

PORTFOLIO = (
    "portfolio IS NOT NULL AND portfolio_status IN ('CLOSED', 'RECLASSIFIED', 'IN_PROGRESS')"
)

IN_PERIOD = f"span AS (SELECT * FROM clean WHERE {PERIOD})"
SCORE_NA = "CASE WHEN {0} IS NULL THEN 'N/A' ELSE {1} END"


def shown(s: str) -> str:
    return SCORE_NA.format(s, hms(s))


CARD_RANKING = (
    f"ranked AS (SELECT analyst, count(*) AS total FROM span WHERE {RULES['registration']}"
    " GROUP BY analyst)"
)


#: Elementary stretches between neighbouring borders of a day's intervals, each counted once.
COVERED = """part AS (
  SELECT d, greatest(start_at, d + INTERVAL 8 HOUR) AS s, least(end_at, d + INTERVAL 18 HOUR) AS t
  FROM (SELECT *, unnest(range(CAST(start_at AS DATE), CAST(end_at AS DATE) + INTERVAL 1 DAY,
                               INTERVAL 1 DAY)) AS d FROM iv)
), bord AS (
  SELECT d, b, lead(b) OVER (PARTITION BY d ORDER BY b) AS e
  FROM (SELECT d, s AS b FROM part WHERE s < t UNION SELECT d, t FROM part WHERE s < t)
), cov AS (
  SELECT CAST(d AS DATE) AS day, epoch_us(e) - epoch_us(b) AS covered, 0 AS present
  FROM bord WHERE EXISTS (SELECT 1 FROM part AS p WHERE p.d = bord.d AND p.s <= b AND p.t >= e)
)
SELECT day, CAST(sum(covered) // 1000000 AS BIGINT) AS covered_s,
       CAST(sum(present) // 1000000 AS BIGINT) AS unavailable_s
FROM (FROM cov UNION ALL SELECT d, 0, us FROM cut WHERE s IS NOT NULL AND t IS NOT NULL)
GROUP BY day"""

MANY_PERIODS = clean(
    "SELECT first_day, last_day, analyst,"
    " r AS registered_tmo_s, registered, u AS updated_tmo_s, updated"
    " FROM (SELECT first_day, last_day, analyst, "
    + ", ".join(
        f"CAST(sum(duration_us) FILTER (WHERE {kind}) // 1000000"
        f" // nullif(count(duration_us) FILTER (WHERE {kind}), 0) AS BIGINT) AS {short},"
        f" count(*) FILTER (WHERE {kind}) AS {name}"
        for kind, short, name in ((REG, "r", "registered"), (UPD, "u", "updated"))
    )
    + " FROM (SELECT DISTINCT d AS first_day, CAST(d + INTERVAL 9 DAY * w AS DATE) AS last_day"
    " FROM clean, range(12) AS r(w)) AS p JOIN clean ON d BETWEEN first_day AND last_day"
    f" WHERE {HANDLED} GROUP BY first_day, last_day, analyst)"
)

REPEATED_UPLOAD = f"""WITH {TASK_LOG}, s AS (
  SELECT seq, CAST(protocol_id AS STRING) AS protocol_id, analyst, status, outcome, queue,
         CASE WHEN seq % 30 <> 11 THEN duration_us END AS duration_us,
         CASE WHEN seq % 40 <> 13 THEN date_trunc('second', completed_at) END AS completed_at,
         CASE WHEN seq % 40 <> 14 THEN date_trunc('second', started_at) END AS started_at
  FROM log WHERE {PERSON}
), first AS (SELECT * FROM s WHERE seq % 10 < 6),
second AS (
  SELECT * FROM s WHERE seq % 10 > 3 AND NOT EXISTS (
    SELECT 1 FROM first AS f WHERE (f.protocol_id, f.analyst, f.status, f.outcome, f.queue,
      f.duration_us, f.completed_at, f.started_at) IS NOT DISTINCT FROM
      (s.protocol_id, s.analyst, s.status, s.outcome, s.queue, s.duration_us, s.completed_at,
       s.started_at))
)
SELECT batch, analyst, count(*) AS tasks, count(protocol_id) AS protocols,
       CAST(sum({CLAMP}) AS BIGINT) AS duration_us
FROM (SELECT 0 AS batch, * FROM first UNION ALL SELECT 1, * FROM second)
GROUP BY batch, analyst"""


def oracle_sql() -> dict[str, str]:
    return {
        "scan_task_log": raw(
            "SELECT seq, CAST(protocol_id AS STRING) AS protocol_id, analyst, outcome, queue,"
            " duration_us, '' AS justification FROM log"
        ),
        "append_batch": raw(
            "SELECT seq, analyst, queue, cause, NULL AS module FROM log"
            " WHERE status = 'Finished' UNION ALL"
            " SELECT seq, analyst, queue, NULL, module FROM log WHERE status <> 'Finished'"
        ),
        "standardise_task_log": raw(
            "SELECT seq, CASE WHEN seq % 30 <> 11 THEN duration_us END AS duration_us,"
            " c AS completed_at, CASE WHEN seq % 40 <> 14"
            " THEN date_trunc('second', started_at) END AS started_at,"
            " CAST(NULL AS STRING) AS module, '' AS justification,"
            " CAST(c AS DATE) AS completed_date, strftime(c, '%Y-%m') AS completed_month"
            " FROM (SELECT *, CASE WHEN seq % 40 <> 13"
            " THEN date_trunc('second', completed_at) END AS c FROM log)"
        ),
        "drop_listed_columns": raw("SELECT seq, analyst, queue FROM log"),
        "exclude_robot_and_unassigned": raw(f"SELECT seq, analyst FROM log WHERE {PERSON}"),
        "clamp_durations": raw(f"SELECT seq, outcome, {CLAMP} AS duration_us FROM log"),
        "duration_adjustments": raw(
            "SELECT protocol_id, outcome, duration_us AS duration_before_us,"
            f" {CLAMP} AS duration_after_us FROM log WHERE duration_us <> {CLAMP}"
        ),
        "write_task_log": raw(
            "SELECT seq, CAST(protocol_id AS STRING) AS protocol_id, analyst, outcome,"
            f" {CLAMP} AS duration_us, completed_at, CAST(completed_at AS DATE) AS completed_date,"
            " CASE WHEN status = 'Finished' THEN 0 ELSE 1 END AS batch"
            f" FROM log WHERE {PERSON}"
        ),
        "ingest_many_files": raw(
            "SELECT protocol_id, arg_min(analyst, (upload, seq)) AS first_analyst,"
            " arg_min_null(completed_at, (upload, seq)) AS first_completed_at,"
            " count(*) AS tasks FROM (SELECT *, CASE WHEN seq % 10 = 9 THEN 0"
            f" WHEN seq % 10 < 6 THEN 1 ELSE 2 END AS upload FROM ({SHOWN}) WHERE {PERSON})"
            " WHERE protocol_id IS NOT NULL GROUP BY protocol_id"
        ),
        "ingest_mixed_headers": raw(
            "SELECT * EXCLUDE keep FROM ("
            "SELECT row_number() OVER (ORDER BY upload, event) - 1 AS seq, protocol_id, analyst,"
            f" outcome, queue, {CLAMP} AS duration_us, CAST(completed_at AS DATE) AS"
            " completed_date, x_day, x_n, keep FROM (SELECT seq AS event, protocol_id, analyst,"
            " outcome, CASE WHEN seq % 10 < 7 THEN queue END AS queue,"
            " CASE WHEN seq % 10 BETWEEN 3 AND 6 THEN NULL ELSE duration_us END AS duration_us,"
            " CASE WHEN seq % 10 BETWEEN 3 AND 6 THEN NULL ELSE completed_at END AS completed_at,"
            " CASE WHEN seq % 10 > 6 THEN concat('d', seq % 10) END AS x_day,"
            " CASE WHEN seq % 10 > 6 THEN CAST(seq % 10 AS STRING) END AS x_n,"
            " CASE WHEN seq % 10 < 3 THEN 0 WHEN seq % 10 < 7 THEN 1 ELSE 2 END AS upload,"
            f" coalesce({PERSON}, false) AS keep FROM ({SHOWN}))) WHERE keep"
        ),
        "ingest_quoted_text": raw(
            "SELECT seq, CAST(protocol_id AS STRING) AS protocol_id, analyst,"
            " concat('said \"', status, '\"; then', chr(10), 'left, at ', seq % 10)"
            f" AS justification FROM log WHERE {PERSON}"
        ),
        "tenant_productivity": raw(
            "SELECT concat('t', seq % 3) AS tenant, CAST(completed_at AS DATE) AS day,"
            f" count(outcome) AS productivity FROM log WHERE {PERSON} AND seq % 3 <> 1 GROUP BY ALL"
        ),
        "scan_workbook": raw(
            "SELECT CAST(protocol_id AS STRING) AS protocol_id, analyst, status, outcome, queue,"
            " duration_us, date_trunc('second', completed_at) AS completed_at,"
            " date_trunc('second', started_at) AS started_at FROM log"
        ),
        "rewrite_batch": raw(
            "SELECT kept_in, CAST(completed_at AS DATE) AS day, count(*) AS tasks"
            " FROM log, (VALUES ('log'), ('cube')) AS k(kept_in)"
            f" WHERE {PERSON} AND day(completed_at) <= 10 GROUP BY ALL"
        ),
        "swap_batch": raw(
            "SELECT version, kept_in, CAST(completed_at AS DATE) AS day, count(*) AS tasks"
            " FROM (SELECT 'before' AS version, * FROM log"
            " UNION ALL SELECT 'after', * FROM log WHERE day(completed_at) <= 10"
            " UNION ALL SELECT 'after', * FROM log WHERE status <> 'Finished'),"
            f" (VALUES ('log'), ('cube')) AS k(kept_in) WHERE {PERSON} GROUP BY ALL"
        ),
        "compact_log": raw(
            f"SELECT seq, batch, analyst, outcome, {CLAMP} AS duration_us, completed_date,"
            " count(*) OVER (PARTITION BY completed_date) AS tasks"
            " FROM (SELECT *, CAST(seq % 4 AS INTEGER) AS batch,"
            f" CAST(completed_at AS DATE) AS completed_date FROM log WHERE {PERSON}"
            " AND (seq % 8 = 1 OR seq % 4 = 2 OR seq % 4 = 0 AND day(completed_at) <= 20"
            " OR seq % 4 = 3 AND day(completed_at) > 20))"
        ),
        "ingest_repeated_upload": REPEATED_UPLOAD,
        "filter_last_days_stored": raw(
            f"SELECT seq, completed_at FROM log WHERE {PERSON} AND CAST(completed_at AS DATE) >="
            f" (SELECT CAST(max(completed_at) AS DATE) - 30 FROM log WHERE {PERSON})"
        ),
        "scan_legacy_log": raw(
            "SELECT seq, duration_us, date_trunc('second', completed_at) AS completed_at,"
            " date_trunc('second', started_at) AS started_at FROM log"
        ),
        "period_from_stored_log": clean(
            "SELECT d AS day, count(outcome) AS productivity FROM clean"
            f" WHERE {PERIOD} GROUP BY d"
        ),
        "export_columns": raw(
            "SELECT CAST(seq AS STRING) AS seq, analyst, deviations FROM log"
        ),
        "scan_unavailability": f"WITH {INTERVALS}\nSELECT date_trunc('minute', start_at)"
        " AS start_at, date_trunc('minute', end_at) AS end_at FROM iv",
        "ingest_landing": raw(
            f"SELECT protocol_id, analyst, outcome, {CLAMP} AS duration_us, completed_at,"
            " started_at, CAST(completed_at AS DATE) AS completed_date FROM"
            " (SELECT CAST(protocol_id AS STRING) AS protocol_id, analyst, outcome,"
            " CASE WHEN seq % 30 <> 11 THEN duration_us END AS duration_us,"
            " CASE WHEN seq % 40 <> 13 THEN date_trunc('second', completed_at) END"
            " AS completed_at,"
            " CASE WHEN seq % 40 <> 14 THEN date_trunc('second', started_at) END AS started_at"
            f" FROM log WHERE {PERSON})"
        ),
        "filter_period": raw(
            "SELECT seq, completed_at FROM log WHERE CAST(completed_at AS DATE)"
            " BETWEEN DATE '2024-01-15' AND DATE '2024-02-20'"
        ),
        "filter_last_days": raw(
            "SELECT seq, completed_at FROM log WHERE CAST(completed_at AS DATE) >="
            " (SELECT CAST(max(completed_at) AS DATE) - 30 FROM log)"
        ),
        "default_roster": raw(f"SELECT DISTINCT analyst FROM log WHERE {ROSTER}"),
        "filter_analysts": raw(f"SELECT seq, analyst FROM log WHERE {ROSTER}"),
        "drop_doubt_outliers": raw(
            f"SELECT seq, queue, duration_us FROM log WHERE NOT {DOUBT}"
        ),
        "filter_months": raw(
            "SELECT seq, completed_at FROM log"
            " WHERE strftime(completed_at, '%Y-%m') IN ('2024-01', '2024-03')"
        ),
        "overview_kpis": OVERVIEW_KPIS,
        "cube_overview_kpis": OVERVIEW_KPIS,
        "cube_stored_overview_kpis": OVERVIEW_KPIS,
        "queue_summary": QUEUE_SUMMARY,
        "queue_summary_stored": QUEUE_SUMMARY,
        "production_by_group": clean(
            f"SELECT {GROUP_OF} AS queue_group, {SPLIT} FROM clean GROUP BY 1"
        ),
        "outcome_by_module": clean(
            f"SELECT module, {n(REG)} AS registered, {n(UPD)} AS updated FROM clean"
            f" WHERE module IS NOT NULL AND {HANDLED} GROUP BY module"
        ),
        "email_group_detail": clean(
            f"SELECT task_type AS item, count(*) AS tasks, {SPLIT} FROM clean"
            " WHERE queue = 'REG EMAIL' GROUP BY task_type UNION ALL"
            f" SELECT queue, count(*), {n(REG)}, {n(UPD)}, {n(NEITHER)} FROM clean"
            " WHERE queue IN ('OFFICIAL LETTERS', 'AGENCIES') GROUP BY queue"
        ),
        "daily_productivity": clean(
            "SELECT d AS day, count(outcome) AS productivity FROM clean GROUP BY d"
        ),
        "daily_productivity_recent": clean(
            "SELECT d AS day, count(outcome) AS productivity FROM clean"
            " WHERE d >= (SELECT max(d) - 21 FROM clean) GROUP BY d"
        ),
        "daily_registered_updated": clean(
            f"SELECT d AS day, {n(REG)} AS registered, {n(UPD)} AS updated,"
            f" {n(REG)} + {n(UPD)} AS productivity FROM clean GROUP BY d"
        ),
        "daily_tmo": clean(
            f"SELECT d AS day, {mean()} AS tmo_s, {min_sec(mean())} AS tmo_text FROM clean"
            f" WHERE {REG} GROUP BY d"
        ),
        "daily_tmo_closed": clean(
            f"SELECT d AS day, {per_task()} AS tmo_s, {min_sec(per_task())} AS tmo_text FROM clean"
            " WHERE status IN ('Finished', 'Cancelled') GROUP BY d"
        ),
        "daily_tmo_closed_zero_filled": clean(
            f"SELECT d AS day, {per_task()} AS tmo_s, {min_sec(per_task())} AS tmo_text FROM clean"
            " WHERE status IN ('Finalised', 'Cancelled') GROUP BY d"
        ),
        "daily_tmo_registered": clean(
            f"SELECT d AS day, {per_task()} AS tmo_s, {min_sec(per_task())} AS tmo_text FROM clean"
            f" WHERE {REG} GROUP BY d"
        ),
        "monthly_tmo_by_outcome": monthly_wide(MONTH_KINDS, "ym", "ym AS month", False),
        "monthly_tmo_long": monthly_long(MONTH_KINDS, "ym", "ym AS month", False),
        "monthly_tmo": clean(
            "SELECT month, us / 60000000.0::DOUBLE AS tmo_minutes,"
            " CASE WHEN us // 60000000 >= 60 THEN printf('%dh %dm %ds', us // 3600000000,"
            " us // 60000000 % 60, (us % 60000000 + 500000) // 1000000)"
            " ELSE printf('%d min %ds', us // 60000000,"
            " (us % 60000000 + 500000) // 1000000) END AS tmo_text FROM m",
            f"m AS (SELECT ym AS month, {us()} AS us FROM clean WHERE {PROD} GROUP BY ym)",
        ),
        "analyst_tmo": clean(
            f"SELECT analyst, {per_task(REG)} AS tmo_s, {hms(per_task(REG))} AS tmo FROM clean"
            f" WHERE status IN ('Finished', 'Cancelled') AND NOT {DOUBT} GROUP BY analyst"
        ),
        "deviation_counts": clean("SELECT * FROM counted", *DEVIATIONS),
        "deviation_counts_real": clean(
            "SELECT * FROM counted WHERE lower(deviation) <> 'no deviation'", *DEVIATIONS
        ),
        "top_deviation": clean(
            "SELECT * FROM counted ORDER BY frequency DESC, deviation LIMIT 1", *DEVIATIONS
        ),
        "rank_overall": RANK_OVERALL,
        "cube_rank_overall": RANK_OVERALL,
        **{f"rank_{name}": ranking(rule) for name, rule in RULES.items()},
        "all_rankings": ALL_RANKINGS,
        "quartile_band": clean(
            f"SELECT position, {band('position', 'size')} AS band FROM placed",
            OVERALL_TOTALS % ROSTER,
            OVERALL_PLACED,
        ),
        "best_by_queue_tmo": clean(
            f"SELECT queue, analyst, {hms('s')} AS tmo, tasks FROM g"
            " QUALIFY row_number() OVER (PARTITION BY queue ORDER BY m, analyst) = 1",
            f"g AS (SELECT queue, analyst, {us()} AS m, {mean()} AS s,"
            f" count(duration_us) AS tasks FROM clean WHERE {BEST}"
            " AND analyst <> 'analyst_04' GROUP BY queue, analyst"
            " HAVING count(duration_us) > 0)",
        ),
        "best_by_queue_volume": clean(
            "SELECT queue, analyst, tasks FROM g"
            " QUALIFY row_number() OVER (PARTITION BY queue ORDER BY tasks DESC, analyst) = 1",
            f"g AS (SELECT queue, analyst, count(*) AS tasks FROM clean WHERE {BEST}"
            " AND NOT contains(analyst, 'analyst_04') GROUP BY queue, analyst)",
        ),
        "most_productive": clean(
            "SELECT analyst, count(*) AS tasks FROM clean GROUP BY analyst"
            " ORDER BY tasks DESC, analyst LIMIT 1"
        ),
        "analyst_metrics": ANALYST_METRICS,
        "cube_analyst_metrics": ANALYST_METRICS,
        "team_tmo": clean(
            f"SELECT {mean(REG)} AS registered_tmo_s, {mean(UPD)} AS updated_tmo_s,"
            f" {mean(AUD)} AS audited_tmo_s, {mean(PROD)} AS overall_tmo_s FROM clean"
        ),
        "analyst_vs_team": clean(
            "SELECT analyst, registered_tmo_s, CAST(r // 1000000 AS BIGINT)"
            " AS team_registered_tmo_s, coalesce(coalesce(reg_us, 0) > r, false)"
            " AS registered_over_team, updated_tmo_s, CAST(u // 1000000 AS BIGINT)"
            " AS team_updated_tmo_s, coalesce(coalesce(upd_us, 0) > u, false)"
            " AS updated_over_team FROM metrics, team",
            METRICS,
            f"team AS (SELECT {us(REG)} AS r, {us(UPD)} AS u FROM clean)",
        ),
        "best_day_tmo": clean(
            f"SELECT analyst, d AS day, tmo_s, {min_sec('tmo_s')} AS tmo_text FROM days"
            " WHERE mean_us IS NOT NULL QUALIFY row_number()"
            " OVER (PARTITION BY analyst ORDER BY mean_us, d) = 1",
            REGISTERED_DAYS,
        ),
        "best_day_volume": clean(
            "SELECT analyst, d AS day, n AS registered FROM days QUALIFY row_number()"
            " OVER (PARTITION BY analyst ORDER BY n DESC, d) = 1",
            REGISTERED_DAYS,
        ),
        "analyst_queue_tmo": clean(
            f"SELECT analyst, queue, part, tasks, {hms('r')} AS registered_tmo,"
            f" {hms('u')} AS updated_tmo, {hms('a')} AS audit_tmo,"
            f" {hms('x')} AS distribution_tmo FROM parts",
            "parts AS (SELECT analyst, queue, 'handled' AS part, count(*) AS tasks,"
            f" {mean(REG)} AS r, {mean(UPD)} AS u, NULL::BIGINT AS a, NULL::BIGINT AS x"
            f" FROM clean WHERE queue IS NOT NULL AND {HANDLED} GROUP BY analyst, queue"
            f" UNION ALL SELECT analyst, queue, 'audit', count(*), NULL, NULL, {mean()}, NULL"
            f" FROM clean WHERE {AUDITS} GROUP BY analyst, queue"
            " UNION ALL SELECT analyst, queue, 'distribution', count(*), NULL, NULL, NULL,"
            f" {mean()} FROM clean WHERE {SPREAD} GROUP BY analyst, queue)",
        ),
        "queue_tmo_finished": clean(
            f"SELECT analyst, queue, count(*) AS tasks, {mean()} AS tmo_s,"
            f" {min_sec(mean())} AS tmo_text FROM clean"
            " WHERE status = 'Finished' AND queue IS NOT NULL GROUP BY analyst, queue"
        ),
        "idle_time_daily": clean(
            f"SELECT analyst, d AS day, idle_us // 1000000 AS idle_s,"
            f" {hms('idle_us // 1000000')} AS idle FROM idle",
            *idle("clean"),
        ),
        "cube_idle_time": clean(
            f"SELECT analyst, d AS day, idle_us // 1000000 AS idle_s,"
            f" {hms('idle_us // 1000000')} AS idle FROM idle",
            *idle("clean"),
        ),
        "idle_time_mean": clean(
            f"SELECT analyst, s AS idle_mean_s, {hms('s')} AS idle_mean FROM"
            " (SELECT analyst, CAST(sum(idle_us) // (1000000 * count(*)) AS BIGINT) AS s"
            " FROM idle GROUP BY analyst)",
            *idle("clean"),
        ),
        "idle_time_total": clean(
            f"SELECT analyst, s AS idle_total_s, {hms('s')} AS idle_total FROM"
            " (SELECT analyst, CAST(sum(idle_us) // 1000000 AS BIGINT) AS s"
            " FROM idle GROUP BY analyst)",
            *idle("clean"),
        ),
        "analyst_monthly_tmo": monthly_wide(
            ANALYST_MONTH_KINDS, "analyst, ym", "analyst, ym AS month", True
        ),
        "analyst_monthly_tmo_long": monthly_long(
            ANALYST_MONTH_KINDS, "analyst, ym", "analyst, ym AS month", True
        ),
        "daily_tmo_by_analyst_recent": clean(
            f"SELECT analyst, d AS day, tmo_s, {min_sec('tmo_s')} AS tmo_text FROM days"
            " QUALIFY d >= max(d) OVER (PARTITION BY analyst) - 10",
            REGISTERED_DAYS,
        ),
        "daily_task_count": clean(
            "SELECT analyst, d AS day, count(*) AS tasks FROM clean GROUP BY analyst, d"
        ),
        "daily_task_count_recent": clean(
            "SELECT * FROM c QUALIFY day >= max(day) OVER (PARTITION BY analyst) - 11",
            "c AS (SELECT analyst, d AS day, count(*) AS tasks FROM clean GROUP BY analyst, d)",
        ),
        "queue_counts": clean(
            "SELECT analyst, queue, count(*) AS tasks FROM clean WHERE queue IS NOT NULL"
            " GROUP BY analyst, queue"
        ),
        "cause_counts": clean(
            "SELECT analyst, cause, count(*) AS tasks FROM clean"
            f" WHERE cause IS NOT NULL AND {REG} GROUP BY analyst, cause"
        ),
        "portfolio_status_counts": clean(
            "SELECT *, " + min_sec("tmo_s") + " AS tmo_text FROM p",
            "p AS (SELECT analyst, portfolio, " + n("portfolio_status = 'CLOSED'") + " AS closed, "
            + n("portfolio_status = 'RECLASSIFIED'") + " AS reclassified, "
            + n("portfolio_status = 'IN_PROGRESS'") + " AS in_progress, "
            + mean("portfolio_status IN ('CLOSED', 'RECLASSIFIED')", "analysis_us")
            + f" AS tmo_s FROM clean WHERE {PORTFOLIO} GROUP BY analyst, portfolio)",
        ),
        "portfolio_tmo": clean(
            f"SELECT analyst, portfolio, count(*) AS tasks, {mean('true', 'analysis_us')} AS tmo_s"
            f" FROM clean WHERE {PORTFOLIO} GROUP BY analyst, portfolio"
        ),
        "points_of_attention": clean(
            "SELECT CAST(protocol_id AS STRING) AS protocol_id, portfolio,"
            " printf('%d:%02d', analysis_us // 60000000, analysis_us // 1000000 % 60)"
            " AS analysis_time FROM clean WHERE protocol_id IS NOT NULL AND analysis_us >"
            " CASE WHEN portfolio = 'FAST' THEN 120000000 ELSE 300000000 END"
        ),
        "period_summary": clean(
            f"SELECT analyst, tmo_s, {hms('tmo_s')} AS tmo, coalesce(tasks, 0) AS tasks,"
            " DATE '2024-01-15' AS period_start, DATE '2024-02-20' AS period_end"
            " FROM chosen LEFT JOIN f USING (analyst)",
            CHOSEN,
            f"f AS (SELECT analyst, {mean()} AS tmo_s, count(*) AS tasks FROM clean"
            f" WHERE {PERIOD} AND {PROD} GROUP BY analyst)",
        ),
        "period_summary_band": clean(
            "SELECT analyst, tmo_s, coalesce(tasks, 0) AS tasks,"
            " CASE WHEN 10 * tmo_s * count(tmo_s) OVER () < 9 * sum(tmo_s) OVER () THEN 'green'"
            " WHEN 10 * tmo_s * count(tmo_s) OVER () <= 11 * sum(tmo_s) OVER () THEN 'yellow'"
            " WHEN tmo_s IS NOT NULL THEN 'red' END AS band"
            " FROM chosen LEFT JOIN f USING (analyst)",
            CHOSEN,
            f"f AS (SELECT analyst, {mean()} AS tmo_s, count(*) AS tasks FROM clean"
            f" WHERE {PERIOD} AND {REG} GROUP BY analyst)",
        ),
        "cause_by_analyst": clean(
            "SELECT analyst, cause, count(*) AS tasks FROM clean JOIN chosen USING (analyst)"
            f" WHERE {PERIOD} AND {REG} AND cause IS NOT NULL GROUP BY analyst, cause",
            CHOSEN,
        ),
        "period_registered_updated": clean(
            f"SELECT analyst, {h_mm_ss('r')} AS registered_tmo,"
            f" coalesce(registered, 0) AS registered, {h_mm_ss('u')} AS updated_tmo,"
            " coalesce(updated, 0) AS updated FROM chosen LEFT JOIN f USING (analyst)",
            CHOSEN,
            f"f AS (SELECT analyst, {mean(REG)} AS r, {n(REG)} AS registered, {mean(UPD)} AS u,"
            f" {n(UPD)} AS updated FROM clean WHERE {PERIOD} GROUP BY analyst)",
        ),
        "analyst_daily_detail": clean(
            f"SELECT analyst, d AS day, {hms(per_task())} AS tmo, count(*) AS tasks"
            f" FROM clean JOIN chosen USING (analyst) WHERE {PERIOD} AND {REG}"
            " GROUP BY analyst, d",
            CHOSEN,
        ),
        "period_full_summary": clean(
            f"SELECT analyst, {h_mm_ss('o')} AS overall_tmo, {h_mm_ss('r')} AS registered_tmo,"
            " coalesce(registered, 0) AS registered, coalesce(tasks, 0) AS tasks,"
            f" {h_mm_ss('coalesce(idle_s, 0)')} AS idle"
            " FROM chosen LEFT JOIN f USING (analyst) LEFT JOIN i USING (analyst)",
            CHOSEN,
            IN_PERIOD,
            *idle("span"),
            f"f AS (SELECT analyst, {mean(PROD)} AS o, {mean(REG)} AS r, {n(REG)} AS registered,"
            " count(*) AS tasks FROM span GROUP BY analyst)",
            "i AS (SELECT analyst, CAST(sum(idle_us) // 1000000 AS BIGINT) AS idle_s FROM idle"
            " GROUP BY analyst)",
        ),
        "period_comparison": clean(
            f"SELECT analyst, {hms('rb')} AS registered_before_tmo,"
            f" {hms('ra')} AS registered_after_tmo, {hms('ub')} AS updated_before_tmo,"
            f" {hms('ua')} AS updated_after_tmo, coalesce(rb, 0) // 60 AS registered_before_min,"
            " coalesce(ra, 0) // 60 AS registered_after_min FROM f",
            f"f AS (SELECT analyst, {mean(f'{REG} AND {BEFORE}')} AS rb,"
            f" {mean(f'{REG} AND {AFTER}')} AS ra, {mean(f'{UPD} AND {BEFORE}')} AS ub,"
            f" {mean(f'{UPD} AND {AFTER}')} AS ua FROM clean"
            f" WHERE ({BEFORE}) OR ({AFTER}) GROUP BY analyst)",
        ),
        "registration_report": clean(
            f"SELECT analyst, {hms('s')} AS tmo, coalesce(s, 0) // 60 AS tmo_min, tasks,"
            f" '2024-01' AS month, {hms('o')} AS overall_tmo FROM f, whole",
            IN_PERIOD,
            f"f AS (SELECT analyst, {mean()} AS s, count(*) AS tasks FROM span WHERE {REG}"
            " GROUP BY analyst)",
            f"whole AS (SELECT {mean()} AS o FROM span WHERE {REG})",
        ),
        "analyst_scorecard": clean(
            f"SELECT analyst, {shown('r')} AS registered_tmo, {shown('u')} AS updated_tmo,"
            f" {shown('i')} AS idle_mean, queue, q AS queue_tmo"
            " FROM f LEFT JOIN im USING (analyst) LEFT JOIN qs USING (analyst)",
            IN_PERIOD,
            *idle("span"),
            f"f AS (SELECT analyst, {mean(REG)} AS r, {mean(UPD)} AS u FROM span GROUP BY analyst)",
            "im AS (SELECT analyst, CAST(sum(idle_us) // (1000000 * count(*)) AS BIGINT) AS i"
            " FROM idle GROUP BY analyst)",
            f"qs AS (SELECT analyst, queue, {shown(mean())} AS q FROM span"
            f" WHERE {HANDLED} AND queue IS NOT NULL GROUP BY analyst, queue)",
        ),
        "team_card": clean(
            "SELECT 'top_registrant' AS item, row_number() OVER (ORDER BY total DESC, analyst)"
            " AS position, analyst AS label, total AS value FROM ranked"
            " QUALIFY position <= 5"
            f" UNION ALL SELECT 'registered_tmo_s', NULL, {hms(mean(REG))}, {mean(REG)} FROM span"
            f" UNION ALL SELECT 'updated_tmo_s', NULL, {hms(mean(UPD))}, {mean(UPD)} FROM span"
            f" UNION ALL SELECT 'audited_tmo_s', NULL, {hms(mean(AUD))}, {mean(AUD)} FROM span"
            f" UNION ALL SELECT 'idle_mean_s', NULL, {hms('s')}, s FROM"
            " (SELECT CAST(sum(idle_us) // (1000000 * count(*)) AS BIGINT) AS s FROM idle)"
            " UNION ALL SELECT * FROM (SELECT 'peak_day', NULL, CAST(d AS STRING), count(*) AS c"
            f" FROM span WHERE {REG} GROUP BY d ORDER BY c DESC, d LIMIT 1)",
            IN_PERIOD,
            *idle("span"),
            CARD_RANKING,
        ),
        "team_card_stored": clean(
            "SELECT 'top_registrant' AS item, row_number() OVER (ORDER BY total DESC, analyst)"
            " AS position, analyst AS label, total AS value FROM ranked"
            " QUALIFY position <= 5"
            f" UNION ALL SELECT 'registered_tmo_s', NULL, {hms(mean(REG))}, {mean(REG)} FROM span"
            f" UNION ALL SELECT 'updated_tmo_s', NULL, {hms(mean(UPD))}, {mean(UPD)} FROM span"
            f" UNION ALL SELECT 'audited_tmo_s', NULL, {hms(mean(AUD))}, {mean(AUD)} FROM span"
            f" UNION ALL SELECT 'idle_mean_s', NULL, {hms('s')}, s FROM"
            " (SELECT CAST(sum(idle_us) // (1000000 * count(*)) AS BIGINT) AS s FROM idle)"
            " UNION ALL SELECT * FROM (SELECT 'peak_day', NULL, CAST(d AS STRING), count(*) AS c"
            f" FROM span WHERE {REG} GROUP BY d ORDER BY c DESC, d LIMIT 1)",
            IN_PERIOD,
            *idle("span"),
            CARD_RANKING,
        ),
        "data_question_aggregates": clean(
            f"SELECT name AS analyst, grouping(name) = 1 AS is_overall, {mean()} AS tmo_s,"
            f" {hms(mean())} AS tmo, count(*) AS tasks"
            " FROM (SELECT *, lower(analyst) AS name FROM clean) GROUP BY ROLLUP (name)"
        ),
        "unavailability_daily": f"WITH {INTERVALS}\nSELECT d AS day, s AS start_at, t AS end_at,"
        " us // 60000000 AS minutes FROM cut",
        "unavailability_covered": f"WITH {INTERVALS}, {COVERED}",
        "many_periods": MANY_PERIODS,
        "unavailability_share": f"WITH {INTERVALS}, total AS (SELECT"
        " CAST(coalesce(sum(us), 0) // 1000000 AS BIGINT) AS u FROM cut"
        " WHERE d BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'),\n"
        " both_of AS (SELECT u, greatest(11 * 36000 - u, 0) AS w FROM total)\n"
        "SELECT u AS unavailable_s, w AS worked_s,"
        " printf('%dh %dm', u // 3600, u % 3600 // 60) AS unavailable,"
        " printf('%dh %dm', w // 3600, w % 3600 // 60) AS worked FROM both_of",
    }
