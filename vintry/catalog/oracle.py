"""The same results in plain SQL, for an independent engine on the same tables."""

from __future__ import annotations

from vintry.contract import METRICS, NONNEGATIVE_METRICS

AS_OF = "DATE '2001-01-01'"
EARLIER = "DATE '1998-06-30'"
SEEN = "TIMESTAMP '1999-06-30 00:00:00'"
PERIOD = "DATE '1997-12-31'"
URL = "concat('https://www.sec.gov/Archives/edgar/data/', cik, '/', replace(accession, '-', ''), '/', accession, '-index.html')"
ANNUAL = "form IN ('10-K', '10-K/A') AND (kind = 'instant' OR date_diff('day', period_start, period_end) BETWEEN 329 AND 399)"

NONNEGATIVE = ", ".join(f"'{m}'" for m in NONNEGATIVE_METRICS)
METRIC_CASE = "CASE mi " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(METRICS)) + " END"


def _text(column: str) -> str:
    return rf"regexp_replace(CAST({column} AS VARCHAR), '\.?0+$', '')"


def _identity() -> str:
    return (
        "sha256(concat('{\"accession\":\"', accession, '\",\"cik\":', cik, ',\"concept\":\"', concept, "
        "'\",\"filed\":\"', filed, '\",\"form\":\"', form, '\",\"period_end\":\"', period_end, "
        "'\",\"period_start\":', coalesce('\"' || CAST(period_start AS VARCHAR) || '\"', 'null'), "
        f"',\"unit\":\"', unit, '\",\"value\":\"', {_text('value')}, '\"}}'))"
    )


CTES = {
    "base": """
        SELECT l.*, year(o_orderdate) AS y, CAST(l_partkey % 10 AS INTEGER) AS mi
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "obs": f"""
        SELECT l_suppkey AS cik, {METRIC_CASE} AS metric,
          concat('c', mi, '_', l_linenumber % 2) AS concept,
          CASE WHEN mi < 4 THEN 'duration' ELSE 'instant' END AS kind,
          CAST(l_linenumber % 2 AS INTEGER) AS alias_priority, 'USD' AS unit,
          CASE WHEN mi < 4 THEN CASE WHEN l_quantity <= 35 THEN make_date(y, 1, 1)
            ELSE make_date(y, 10, 1) END END AS period_start,
          make_date(y, 12, 31) AS period_end,
          CAST(CASE WHEN mi BETWEEN 1 AND 3
            THEN CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(4,2)) - 0.05)
            ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DECIMAL(38,4)) AS value,
          concat(lpad(CAST(l_suppkey AS VARCHAR), 10, '0'), '-', lpad(CAST(y % 100 AS VARCHAR), 2, '0'),
            '-', lpad(CAST(l_orderkey % 1000000 AS VARCHAR), 6, '0')) AS accession,
          CASE l_returnflag WHEN 'A' THEN '10-K' WHEN 'N' THEN '10-K/A' ELSE '10-Q' END AS form,
          CAST(l_shipdate AS DATE) AS filed, CAST(y AS INTEGER) AS fiscal_year_hint,
          'FY' AS fiscal_period_hint,
          l_shipdate + l_linenumber * INTERVAL 1 DAY AS first_observed,
          l_linenumber AS idx, l_orderkey, l_tax, CAST(y AS INTEGER) AS y, mi,
          l_orderkey * 8 + l_linenumber AS r
        FROM base""",
    "facts": f"""
        SELECT {_identity()} AS fact_id, cik, metric, concept, kind, alias_priority, unit,
          period_start, period_end, value, accession, form, filed, fiscal_year_hint,
          fiscal_period_hint, first_observed,
          sha256(concat('source:', cik, ':', y)) AS source_sha,
          concat('bronze/cik=', cik, '/', sha256(concat('source:', cik, ':', y))) AS bronze_path,
          sha256(concat(cik, ':', y)) AS snapshot_id
        FROM obs WHERE filed >= period_end""",
    "issuers": """
        SELECT s_suppkey AS cik, concat('S', s_suppkey) AS ticker, s_name AS name,
          n_name AS sector, r_name AS headquarters
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "spells": """
        SELECT *, TIMESTAMP '1992-01-01 00:00:00' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to
        FROM issuers WHERE cik % 3 <> 0
        UNION ALL SELECT *, TIMESTAMP '1996-01-01 00:00:00', NULL FROM issuers WHERE cik % 3 = 0
        UNION ALL SELECT cik, ticker, name, 'PENDING', headquarters,
          TIMESTAMP '1992-01-01 00:00:00', TIMESTAMP '1996-01-01 00:00:00'
        FROM issuers WHERE cik % 3 = 0""",
    "hashed": """
        SELECT *, sha256(concat('{"cik":', cik, ',"headquarters":"', headquarters, '","name":"', name,
          '","sector":"', sector, '","ticker":"', ticker, '"}')) AS attribute_hash
        FROM spells""",
    "history": """
        SELECT *, sha256(concat('["', attribute_hash, '","',
          strftime(valid_from, '%Y-%m-%dT%H:%M:%S'), '+00:00"]')) AS issuer_key
        FROM hashed""",
    "dim": """
        SELECT issuer_key, cik, name, ticker, sector, headquarters, valid_from
        FROM history WHERE valid_to IS NULL""",
    "candidates": f"SELECT * FROM facts WHERE filed <= {AS_OF} AND {ANNUAL}",
    "canonical": """
        SELECT * EXCLUDE (version_rank) FROM (
          SELECT *, row_number() OVER (PARTITION BY cik, metric, period_end
            ORDER BY filed DESC, alias_priority, accession DESC, first_observed DESC, fact_id
          ) AS version_rank FROM candidates) WHERE version_rank = 1""",
    "canonical_seen": f"""
        SELECT * EXCLUDE (version_rank) FROM (
          SELECT *, row_number() OVER (PARTITION BY cik, metric, period_end
            ORDER BY filed DESC, alias_priority, accession DESC, first_observed DESC, fact_id
          ) AS version_rank FROM candidates WHERE first_observed <= {SEEN}) WHERE version_rank = 1""",
    "pivoted": "SELECT cik, period_end, "
    + ", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}" for m in METRICS)
    + ", max(filed) AS latest_evidence_filed, count(*) AS available_metrics"
    " FROM canonical GROUP BY cik, period_end",
    "annual": f"""
        SELECT md5(concat(cik, ':', period_end)) AS annual_key, issuer_key, p.*,
          round(CAST(net_income AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0), 6) AS net_margin,
          round(CAST(operating_income AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0), 6) AS operating_margin,
          round(CAST(current_assets AS DOUBLE) / nullif(CAST(current_liabilities AS DOUBLE), 0), 6) AS current_ratio,
          round(CAST(liabilities AS DOUBLE) / nullif(CAST(assets AS DOUBLE), 0), 6) AS liabilities_to_assets,
          round(CAST(operating_cash_flow AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0), 6) AS cash_flow_margin,
          {AS_OF} AS filing_date_cutoff
        FROM pivoted p JOIN dim USING (cik) WHERE revenue IS NOT NULL""",
    "lagged": """
        SELECT *, lag(revenue) OVER w AS previous_revenue, lag(period_end) OVER w AS previous_period_end
        FROM pivoted WHERE revenue IS NOT NULL WINDOW w AS (PARTITION BY cik ORDER BY period_end)""",
    "grown": """
        SELECT *, CASE WHEN date_diff('day', previous_period_end, period_end) BETWEEN 330 AND 400
          THEN round(CAST(revenue AS DOUBLE) / nullif(CAST(previous_revenue AS DOUBLE), 0) - 1, 6)
          END AS revenue_growth_yoy FROM lagged""",
    "yearly": """
        SELECT *,
          round(CAST(net_income AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0), 6) AS net_margin,
          round(CAST(current_assets AS DOUBLE) / nullif(CAST(current_liabilities AS DOUBLE), 0), 6) AS current_ratio,
          round(CAST(liabilities AS DOUBLE) / nullif(CAST(assets AS DOUBLE), 0), 6) AS liabilities_to_assets
        FROM grown""",
    "trends": """
        SELECT a.*, d.ticker, d.name, d.sector, g.previous_revenue, g.previous_period_end,
          g.revenue_growth_yoy,
          coalesce(a.current_ratio_exact < 1, false) AS liquidity_review,
          coalesce(a.net_income < 0, false) AS loss_review,
          coalesce(a.operating_cash_flow < 0, false) AS cash_flow_review,
          a.available_metrics < 10 AS incomplete_metrics
        FROM (SELECT *, CAST(current_assets AS DOUBLE) / nullif(CAST(current_liabilities AS DOUBLE), 0)
                AS current_ratio_exact FROM annual) a
        JOIN dim d USING (issuer_key, cik) JOIN grown g USING (cik, period_end)""",
    "versions": """
        SELECT *, lag(value) OVER (PARTITION BY cik, concept, unit, period_start, period_end
          ORDER BY filed, accession, first_observed, fact_id) AS previous_value FROM candidates""",
    "revisions": """
        SELECT fact_id, cik, metric, concept, period_start, period_end, accession, filed, value,
          previous_value, value - previous_value AS change_amount,
          round(CAST(value - previous_value AS DOUBLE) / nullif(abs(CAST(previous_value AS DOUBLE)), 0), 6)
            AS relative_change, source_sha, bronze_path
        FROM versions WHERE previous_value IS NOT NULL AND value <> previous_value""",
    "balance": """
        SELECT ticker, period_end, assets, liabilities, equity,
          assets - liabilities - equity AS residual,
          greatest(CAST(1000 AS DECIMAL(38,7)), CAST(abs(CAST(assets AS DECIMAL(34,4))) * 0.005 AS DECIMAL(38,7)))
            AS tolerance
        FROM annual JOIN dim USING (cik)
        WHERE abs(assets - liabilities - equity)
          > greatest(CAST(1000 AS DECIMAL(38,7)), CAST(abs(CAST(assets AS DECIMAL(34,4))) * 0.005 AS DECIMAL(38,7)))""",
    # One document per order, of its customer, with an observation per line: the number of
    # the line modulo 101 says what is wrong with it. pos is its place among those of its
    # concept and unit.
    "docs": """
        SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, doc_concept, doc_unit ORDER BY idx, supplier, value, filed) - 1 AS INTEGER) AS pos
        FROM (SELECT obs.* REPLACE (o_custkey AS cik, l_orderkey AS r), obs.r % 101 AS f, obs.cik AS supplier,
          CASE WHEN obs.r % 101 = 15 THEN 'Other' || concept ELSE concept END AS doc_concept,
          CASE WHEN l_tax >= 0.07 THEN 'EUR' ELSE 'USD' END AS doc_unit
        FROM obs JOIN orders ON l_orderkey = o_orderkey)""",
    "judged": f"""
        SELECT *, CASE
            WHEN f = 15 THEN 'unknown_concept'
            WHEN doc_unit <> 'USD' THEN 'other_unit'
            WHEN f NOT IN (1, 2) AND y < 1994 THEN 'old_period'
            WHEN reason IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status
        FROM (SELECT *, CASE
            WHEN f = 1 THEN 'not_an_object'
            WHEN f = 2 THEN 'end_not_a_date'
            WHEN f = 3 THEN 'filed_not_a_date'
            WHEN f = 4 AND kind = 'duration' THEN 'start_not_a_date'
            WHEN f = 5 AND kind = 'duration' THEN 'start_after_end'
            WHEN filed < period_end THEN 'filed_before_end'
            WHEN f = 6 THEN 'bad_accession'
            WHEN f = 7 THEN 'missing_form'
            WHEN f IN (8, 9, 13) THEN 'value_not_numeric'
            WHEN f = 10 THEN 'value_out_of_range'
            WHEN f = 11 THEN 'too_many_decimals'
            WHEN f = 12 AND metric IN ({NONNEGATIVE}) THEN 'negative_value' END AS reason
          FROM docs)""",
    "doc_facts": """
        SELECT cik, metric, concept, kind, alias_priority, unit, period_start, period_end,
          CASE f WHEN 12 THEN CAST(-1.5 AS DECIMAL(38,4)) WHEN 16 THEN CAST(2000 AS DECIMAL(38,4))
            WHEN 17 THEN CAST('12345678901234567890123.125' AS DECIMAL(38,4)) ELSE value END AS value,
          accession, form, filed, fiscal_year_hint, fiscal_period_hint, r, pos AS idx
        FROM judged WHERE status = 'accepted'""",
    "event_states": """
        SELECT *, sha256(concat('{"event_type":"', event_type, '","user_id":', user_id, '}')) AS attribute_hash
        FROM events""",
    "event_starts": """
        SELECT * FROM (SELECT *, lag(attribute_hash) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
          FROM event_states) WHERE before IS NULL OR before <> attribute_hash""",
    "event_versions": """
        SELECT user_id, event_type, ts AS valid_from, event_id, attribute_hash,
          lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to,
          sha256(concat('["', attribute_hash, '","', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
            CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END,
            '+00:00"]')) AS version_key
        FROM event_starts""",
}

NEEDS = {
    "obs": ["base"], "facts": ["obs"], "spells": ["issuers"], "hashed": ["spells"],
    "history": ["hashed"], "dim": ["history"], "candidates": ["facts"],
    "canonical": ["candidates"], "canonical_seen": ["candidates"], "pivoted": ["canonical"],
    "annual": ["pivoted", "dim"], "lagged": ["pivoted"], "grown": ["lagged"], "yearly": ["grown"],
    "trends": ["annual", "grown"], "versions": ["candidates"], "revisions": ["versions"],
    "balance": ["annual"], "docs": ["obs"], "judged": ["docs"], "doc_facts": ["judged"],
    "event_starts": ["event_states"], "event_versions": ["event_starts"],
}


def _closure(names) -> list[str]:
    found: list[str] = []

    def visit(name):
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in found:
            found.append(name)

    for name in names:
        visit(name)
    return found


def sql(body: str, *names: str) -> str:
    parts = [f"{name} AS ({CTES[name]})" for name in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n" + body


CANONICAL_COLUMNS = "fact_id, cik, metric, period_end, value, accession, filed"
MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in METRICS) + ")"
_CELLS = [
    "ticker", f"CAST({AS_OF} AS VARCHAR)", "CAST(period_end AS VARCHAR)",
    *[f"CAST({m} AS VARCHAR)" for m in METRICS],
    *[
        f"CAST(CAST({r} AS DECIMAL(38,6)) AS VARCHAR)"
        for r in ("net_margin", "current_ratio", "liabilities_to_assets", "revenue_growth_yoy")
    ],
    "CAST(available_metrics AS VARCHAR)", "CAST(latest_evidence_filed AS VARCHAR)",
]
LINE = " || ',' || ".join(f"coalesce('\"' || replace({c}, '\"', '\"\"') || '\"', '')" for c in _CELLS)


def _check_rows() -> str:
    def null(table, column):
        return f"SELECT '{table}.{column}.not_null' AS check_name, count(*) AS failing_rows FROM {{t}} WHERE {column} IS NULL"

    def unique(table, column):
        return (
            f"SELECT '{table}.{column}.unique' AS check_name, count(*) AS failing_rows FROM "
            f"(SELECT {column} FROM {{t}} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
        )

    def count(name, body):
        return f"SELECT '{name}' AS check_name, count(*) AS failing_rows FROM {body}"

    negative = " OR ".join(f"{m} < 0" for m in NONNEGATIVE_METRICS)
    parts = [
        unique("facts", "fact_id").format(t="facts"), null("facts", "fact_id").format(t="facts"),
        null("facts", "cik").format(t="facts"), null("facts", "value").format(t="facts"),
        unique("canonical_facts", "fact_id").format(t="canonical"),
        null("canonical_facts", "fact_id").format(t="canonical"),
        count("canonical_facts.no_future_evidence", f"canonical WHERE filed > {AS_OF}"),
        count(
            "canonical_facts.no_quarterly_duration",
            "canonical WHERE kind = 'duration' AND date_diff('day', period_start, period_end) NOT BETWEEN 329 AND 399",
        ),
        unique("dim_issuer", "issuer_key").format(t="dim"), null("dim_issuer", "issuer_key").format(t="dim"),
        unique("dim_issuer", "cik").format(t="dim"), null("dim_issuer", "cik").format(t="dim"),
        unique("annual_financials", "annual_key").format(t="annual"),
        null("annual_financials", "annual_key").format(t="annual"),
        null("annual_financials", "revenue").format(t="annual"),
        count("annual_financials.nonnegative_balance", f"annual WHERE {negative}"),
        count(
            "annual_financials.issuer_key.relationship",
            "annual WHERE issuer_key NOT IN (SELECT issuer_key FROM dim)",
        ),
        unique("company_trends", "annual_key").format(t="trends"),
        null("company_trends", "annual_key").format(t="trends"),
        unique("filing_revisions", "fact_id").format(t="revisions"),
        null("filing_revisions", "fact_id").format(t="revisions"),
        count(
            "issuer_history.one_current",
            "(SELECT cik FROM history GROUP BY cik HAVING count(*) FILTER (WHERE valid_to IS NULL) <> 1)",
        ),
        count(
            "issuer_history.no_overlap",
            "(SELECT DISTINCT a.issuer_key FROM history a JOIN history b ON a.cik = b.cik"
            " AND a.issuer_key <> b.issuer_key"
            " WHERE a.valid_from < coalesce(b.valid_to, TIMESTAMP '9999-12-31')"
            " AND b.valid_from < coalesce(a.valid_to, TIMESTAMP '9999-12-31'))",
        ),
    ]
    return (
        "SELECT *, CASE WHEN failing_rows = 0 THEN 'pass' ELSE 'fail' END AS status FROM (\n"
        + "\nUNION ALL ".join(parts) + ")"
    )


def _telemetry() -> str:
    return """
        , twice AS (SELECT * FROM judged UNION ALL SELECT * FROM judged WHERE r % 50 = 0)
        SELECT cik, signal, name, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT cik, status AS signal, '' AS name, 1 AS n
          FROM twice WHERE status IN ('other_unit', 'old_period')
          UNION ALL SELECT cik, 'unknown_concept', doc_concept, count(DISTINCT r) + count(DISTINCT r) FILTER (WHERE r % 50 = 0)
          FROM judged WHERE status = 'unknown_concept' GROUP BY cik, doc_concept
          UNION ALL SELECT cik, 'extra_key', 'note', 1 FROM twice
          WHERE f = 14 AND doc_unit = 'USD'
          UNION ALL SELECT cik, 'duplicate_row', '', 1 FROM judged
          WHERE status = 'accepted' AND r % 50 = 0)
        GROUP BY ALL"""


def _gauges() -> str:
    rows = [
        ("serving_release_ready", "1 while a checked release can be read, else 0.", "1"),
        ("financial_fact_versions", "Fact versions the release holds.", "(SELECT count(*) FROM facts)"),
        ("annual_periods", "Issuer periods with an annual record.", "(SELECT count(*) FROM annual)"),
        ("incomplete_annual_periods", "Annual records without all contract metrics.",
         "(SELECT count(*) FROM annual WHERE available_metrics < 10)"),
        ("balance_warnings", "Annual records whose balance is off.", "(SELECT count(*) FROM balance)"),
        ("checks_passed", "Checks that the release passed.",
         "(SELECT count(*) FROM (" + _check_rows() + ") WHERE status = 'pass')"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{text}' AS help, CAST({value} AS DOUBLE) AS value"
        for name, text, value in rows
    )


def oracle_sql() -> dict[str, str]:
    missing = ", ".join(f"count(*) FILTER (WHERE {m} IS NULL) AS {m}" for m in METRICS)
    absent = " + ".join(f"CAST({m} IS NULL AS INTEGER)" for m in METRICS)
    runs = " UNION ALL ".join(
        f"SELECT cik, period_end, '{m}' AS metric, {m} IS NOT NULL AS reported FROM annual" for m in METRICS
    )
    facts_all = sql("SELECT * FROM facts", "facts")
    return {
        "scan_facts": facts_all,
        "source_checksum": """
            SELECT doc_id, sha256(text) AS source_sha, CASE WHEN doc_id % 77 = 0 THEN 'unlisted'
              WHEN doc_id % 50 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents""",
        "issuer_config_checks": sql("""
            SELECT cik, count(*) AS listed,
              CASE WHEN cik NOT BETWEEN 1 AND 9999999999 THEN 'out_of_range' ELSE 'repeated' END AS problem
            FROM (SELECT cik FROM issuers UNION ALL SELECT cik FROM issuers WHERE cik % 25 = 0)
            GROUP BY cik HAVING count(*) > 1 OR cik NOT BETWEEN 1 AND 9999999999""", "issuers"),
        "history_export": sql(
            f"SELECT ticker, period_end, {LINE} AS line FROM yearly JOIN dim USING (cik)", "yearly", "dim"),
        "candidate_extract": sql(f"""
            SELECT fact_id, cik, metric, concept, kind, alias_priority, period_start, period_end, value,
              accession, form, filed, first_observed, source_sha, {URL} AS filing_url
            FROM facts WHERE {ANNUAL}""", "facts"),
        "synthetic_load": sql("""
            SELECT 'verified_rows' AS measure, CAST(count(*) AS DECIMAL(38,4)) AS amount
            FROM (SELECT DISTINCT cik, r FROM obs)
            UNION ALL SELECT 'verified_sum', CAST(sum(1000000 + r) AS DECIMAL(38,4)) FROM (SELECT DISTINCT cik, r FROM obs)
            UNION ALL SELECT 'input_rows', CAST(count(*) AS DECIMAL(38,4)) FROM obs
            UNION ALL SELECT 'expected_sum', CAST(count(*) * 1000000 + sum(r) AS DECIMAL(38,4)) FROM obs""", "obs"),
        "json_flatten": sql("""
            SELECT cik, r, doc_concept AS concept, NULL AS unit, NULL AS idx, CAST(1 AS BIGINT) AS weight,
              NULL AS accn, NULL AS end_text, NULL AS filed_text
            FROM docs WHERE f = 15 GROUP BY cik, r, doc_concept
            UNION ALL SELECT cik, r, doc_concept, doc_unit, NULL, count(*), NULL, NULL, NULL
            FROM docs WHERE f <> 15 AND doc_unit <> 'USD' GROUP BY cik, r, doc_concept, doc_unit
            UNION ALL SELECT cik, r, doc_concept, doc_unit, pos, 1,
              CASE WHEN shown THEN CASE WHEN f = 6 THEN 'bad-id' ELSE accession END END AS accn,
              CASE WHEN shown THEN CASE WHEN f = 2 THEN concat(y, '-02-31') ELSE CAST(period_end AS VARCHAR) END END AS end_text,
              CASE WHEN shown AND f <> 3 THEN CAST(filed AS VARCHAR) END AS filed_text
            FROM (SELECT *, f <> 1 AS shown FROM docs WHERE f <> 15 AND doc_unit = 'USD')""", "docs"),
        "normalize_facts": sql(
            f"SELECT {_identity()} AS fact_id, * FROM doc_facts", "doc_facts"),
        "filing_url": sql(f"SELECT fact_id, {URL} AS filing_url FROM facts", "facts"),
        "value_text": sql(f"SELECT fact_id, {_text('value')} AS value_text FROM facts", "facts"),
        "decimal_text_output": sql("SELECT fact_id, CAST(value AS VARCHAR) AS value FROM facts", "facts"),
        "fact_identity": sql(f"SELECT l_orderkey, idx, {_identity()} AS fact_id FROM obs", "obs"),
        "snapshot_identity": sql("""
            SELECT cik, source_sha, sha256(concat('[{"cik":', cik, ',"headquarters":"', headquarters,
              '","sector":"', sector, '","ticker":"', ticker, '"},"', source_sha, '","1",2015]')) AS snapshot_id
            FROM (SELECT DISTINCT cik, sha256(concat('source:', cik, ':', y)) AS source_sha FROM obs)
            JOIN issuers USING (cik)""", "obs", "issuers"),
        "extra_keys": """
            SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k:
              k NOT IN ('start', 'end', 'val', 'accn', 'fy', 'fp', 'form', 'filed', 'frame'))), ',') AS extra_keys
            FROM events""",
        "concept_map_join": sql(
            "SELECT r, concept, metric, kind, alias_priority FROM obs WHERE r % 101 <> 15", "obs"),
        "contract_rejects": sql(
            "SELECT cik, r, doc_concept AS concept, pos AS idx, reason FROM judged WHERE status = 'rejected'", "judged"),
        "contract_reject_counts": sql(
            "SELECT reason, count(*) AS n FROM judged WHERE status = 'rejected' GROUP BY reason", "judged"),
        "telemetry": sql(_telemetry(), "judged"),
        "empty_accept_gate": sql("""
            SELECT cik, CAST(0 AS BIGINT) AS accepted,
              count(*) FILTER (WHERE status IN ('accepted', 'rejected')) AS rejected
            FROM judged GROUP BY cik
            HAVING cik % 4 = 1 OR count(*) FILTER (WHERE status = 'accepted') = 0""", "judged"),
        "reject_rate": sql("""
            SELECT *, round(CAST(rejected AS DOUBLE) / (accepted + rejected), 6) AS reject_rate,
              CAST(rejected AS DOUBLE) / (accepted + rejected) > 0.005 AS over_limit
            FROM (SELECT cik, count(*) FILTER (WHERE status = 'accepted') AS accepted,
              count(*) FILTER (WHERE status = 'rejected') AS rejected FROM judged GROUP BY cik)
            WHERE accepted + rejected > 0""", "judged"),
        "dedupe_facts": sql(f"SELECT {_identity()} AS fact_id, cik, idx, value FROM obs", "obs"),
        "annual_candidates": sql(f"SELECT {CANONICAL_COLUMNS} FROM candidates", "candidates"),
        "canonical_facts": sql(
            f"SELECT {CANONICAL_COLUMNS}, concept, alias_priority, form FROM canonical", "canonical"),
        "observed_before_cutoff": sql(f"SELECT {CANONICAL_COLUMNS} FROM canonical_seen", "canonical_seen"),
        "canonical_period": sql(
            f"SELECT {CANONICAL_COLUMNS} FROM canonical WHERE period_end = {PERIOD}", "canonical"),
        "period_evidence": sql(f"""
            SELECT cik, CAST(list_position([{", ".join(f"'{m}'" for m in METRICS)}], metric) AS INTEGER) AS position,
              metric, value, fact_id FROM canonical WHERE period_end = {PERIOD}""", "canonical"),
        "selection_parity": sql("""
            SELECT fact_id, 'left' AS only_in FROM canonical WHERE fact_id NOT IN (SELECT fact_id FROM canonical_seen)
            UNION ALL SELECT fact_id, 'right' FROM canonical_seen
            WHERE fact_id NOT IN (SELECT fact_id FROM canonical)""", "canonical", "canonical_seen"),
        "anchor_semi_join": sql(f"""
            SELECT {CANONICAL_COLUMNS} FROM canonical
            JOIN (SELECT cik, period_end FROM canonical WHERE metric = 'revenue') USING (cik, period_end)""", "canonical"),
        "annual_pivot": sql("SELECT * FROM pivoted", "pivoted"),
        "annual_financials": sql("SELECT * FROM annual", "annual"),
        "annual_ratios": sql("""
            SELECT cik, period_end, net_margin, operating_margin, current_ratio, liabilities_to_assets,
              cash_flow_margin FROM annual""", "annual"),
        "annual_history": sql("SELECT * FROM yearly", "yearly"),
        "company_trends": sql("SELECT * EXCLUDE (current_ratio_exact) FROM trends", "trends"),
        "revenue_growth_yoy": sql("""
            SELECT cik, period_end, revenue, previous_revenue, previous_period_end, revenue_growth_yoy
            FROM grown""", "grown"),
        "review_flags": sql("""
            SELECT annual_key, liquidity_review, loss_review, cash_flow_review, incomplete_metrics
            FROM trends""", "trends"),
        "latest_period": sql(
            "SELECT cik, max(period_end) AS latest_period_end FROM annual GROUP BY cik", "annual"),
        "metric_runs": sql(f"""
            SELECT cik, metric, min(period_end) AS run_start, max(period_end) AS run_end, count(*) AS points
            FROM (SELECT *, count(*) FILTER (WHERE NOT reported) OVER (
                PARTITION BY cik, metric ORDER BY period_end) AS gaps FROM ({runs}))
            WHERE reported GROUP BY cik, metric, gaps""", "annual"),
        "filing_revisions": sql("SELECT * FROM revisions", "revisions"),
        "revisions_top_k": sql(
            "SELECT * FROM revisions ORDER BY filed DESC, period_end DESC, fact_id LIMIT 100", "revisions"),
        "latest_revisions": sql(f"""
            SELECT ticker, cik, fact_id, filed, period_end, value, previous_value FROM (
              SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, period_end DESC, fact_id) AS place
              FROM (SELECT *, lag(value) OVER (PARTITION BY cik, concept, unit, period_start, period_end
                  ORDER BY filed, accession, first_observed, fact_id) AS previous_value
                FROM facts WHERE {ANNUAL})
              WHERE previous_value IS NOT NULL AND value <> previous_value)
            JOIN (SELECT cik, ticker FROM dim) USING (cik) WHERE place <= 5""", "facts", "dim"),
        "dim_issuer": sql("SELECT * FROM dim", "dim"),
        "issuer_lookup": sql("SELECT * FROM dim WHERE ticker = upper('s7')", "dim"),
        "scd2_build": sql("SELECT * FROM event_versions", "event_states", "event_versions"),
        "scd_overlaps": sql("""
            , spans AS (SELECT user_id, event_id, valid_from, coalesce(CASE WHEN event_id % 7 = 0
                THEN valid_to + INTERVAL 6 HOURS ELSE valid_to END, TIMESTAMP '9999-12-31') AS until
              FROM event_versions)
            SELECT DISTINCT a.user_id, a.event_id FROM spans a JOIN spans b
            ON a.user_id = b.user_id AND a.event_id <> b.event_id
            WHERE a.valid_from < b.until AND b.valid_from < a.until""", "event_states", "event_versions"),
        "incremental_merge": sql("""
            SELECT fact_id, filed, value, first_observed FROM facts WHERE filed < DATE '1997-01-01'
            UNION ALL SELECT fact_id, filed, value, first_observed + INTERVAL 400 DAYS FROM facts
            WHERE filed >= DATE '1997-01-01'""", "facts"),
        "filtered_merge": sql("SELECT fact_id, cik FROM facts WHERE substr(fact_id, 1, 1) >= '8'", "facts"),
        "affected_periods": sql(f"""
            SELECT * FROM (WITH late AS (
              SELECT DISTINCT cik, period_end FROM facts WHERE first_observed > {SEEN}),
            periods AS (
              SELECT cik, period_end FROM annual
              UNION SELECT cik, period_end FROM canonical_seen WHERE metric = 'revenue'
            )
            SELECT cik, period_end FROM late
            UNION SELECT late.cik, (SELECT min(p.period_end) FROM periods p
              WHERE p.cik = late.cik AND p.period_end > late.period_end) AS next_end
            FROM late WHERE next_end IS NOT NULL)""", "facts", "annual", "canonical_seen"),
        "affected_trends": sql("SELECT * EXCLUDE (current_ratio_exact) FROM trends", "trends"),
        "envelope_errors": """
            SELECT DISTINCT o_custkey AS cik, l_orderkey AS r,
              CASE l_orderkey % 11 WHEN 1 THEN 'cik_mismatch' WHEN 2 THEN 'missing_entity_name'
                WHEN 3 THEN 'concepts_not_a_map' ELSE 'unreadable_json' END AS document_error
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 11 < 5""",
        "snapshot_skip": sql(
            "SELECT DISTINCT sha256(concat(cik, ':', y)) AS snapshot_id, cik, y FROM obs WHERE y >= 1996", "obs"),
        "load_ledger": sql("""
            SELECT cik, count(*) FILTER (WHERE filed >= period_end) AS accepted,
              count(*) FILTER (WHERE filed < period_end) AS rejected,
              count(*) FILTER (WHERE filed >= period_end AND y >= 1996) AS inserted
            FROM obs GROUP BY cik""", "obs"),
        "fact_lineage": sql(f"""
            SELECT fact_id, ticker, value,
              concat('https://example.org/companyfacts/', cik) AS source_url, {URL} AS filing_url, source_sha,
              bronze_path, concat('silver/cik=', cik, '/', snapshot_id) AS silver_path, snapshot_id,
              coalesce({ANNUAL}, false) AS annual_candidate,
              CASE WHEN coalesce({ANNUAL}, false)
                THEN 'annual_candidates>canonical_facts>annual_financials>company_trends' ELSE '' END AS model_path
            FROM facts JOIN dim USING (cik)""", "facts", "dim"),
        "coverage_by_issuer": sql("""
            SELECT ticker, count(*) AS annual_periods,
              count(*) FILTER (WHERE available_metrics = 10) AS complete_periods
            FROM annual JOIN dim USING (cik) GROUP BY ticker""", "annual"),
        "missing_by_metric": sql(f"""
            SELECT ticker, metric, missing FROM (
              UNPIVOT (SELECT ticker, {missing} FROM annual JOIN dim USING (cik) GROUP BY ticker)
              ON {", ".join(METRICS)} INTO NAME metric VALUE missing)""", "annual"),
        "missing_metrics": sql(f"""
            SELECT ticker, period_end, {MISSING} AS missing_metrics
            FROM annual JOIN dim USING (cik) WHERE available_metrics < 10""", "annual"),
        "incomplete_periods": sql("""
            SELECT ticker, period_end, available_metrics FROM annual JOIN dim USING (cik)
            WHERE available_metrics < 10""", "annual"),
        "balance_warnings": sql("SELECT * FROM balance", "balance"),
        "quality_summary": sql("""
            SELECT count(DISTINCT cik) AS issuers, count(*) AS annual_periods,
              count(*) FILTER (WHERE available_metrics = 10) AS complete_periods,
              count(*) FILTER (WHERE available_metrics < 10) AS incomplete_periods,
              (SELECT count(*) FROM balance) AS balance_warnings FROM annual""", "balance"),
        "coverage_pct": sql(f"""
            SELECT ticker, count(*) AS annual_periods,
              count(*) FILTER (WHERE available_metrics = 10) AS complete_periods,
              CAST(sum({absent}) AS BIGINT) AS missing_values,
              round(count(*) FILTER (WHERE available_metrics = 10) / CAST(count(*) AS DOUBLE), 6) AS coverage
            FROM annual JOIN dim USING (cik) GROUP BY ticker""", "annual"),
        "coverage_gate": sql(f"""
            SELECT cik, ticker FROM dim WHERE cik NOT IN (
              SELECT cik FROM (
                SELECT cik, period_end FROM facts WHERE filed <= {EARLIER} AND {ANNUAL}
                GROUP BY cik, period_end
                HAVING count(*) FILTER (WHERE metric = 'revenue') > 0
                  AND count(*) FILTER (WHERE metric = 'assets') > 0))""", "facts", "dim"),
        "release_totals": sql("""
            SELECT 'total_facts' AS name, count(*) AS n FROM facts
            UNION ALL SELECT 'annual_periods', count(*) FROM annual
            UNION ALL SELECT 'revisions', count(*) FROM revisions""", "annual", "revisions"),
        "check_summary": sql(_check_rows(), "trends", "revisions", "history"),
        "release_gauges": sql(_gauges(), "trends", "revisions", "history", "balance"),
        "check_unique": sql(
            "SELECT accession, count(*) AS copies FROM facts GROUP BY accession HAVING count(*) > 1", "facts"),
        "check_not_null": sql("SELECT cik, period_end FROM pivoted WHERE revenue IS NULL", "pivoted"),
        "check_relationships": sql(
            "SELECT annual_key, cik FROM annual WHERE cik % 5 = 0", "annual"),
        "check_no_future": sql(f"SELECT fact_id, filed FROM facts WHERE filed > {EARLIER}", "facts"),
        "check_no_quarterly": sql("""
            SELECT fact_id, period_start, period_end FROM facts WHERE kind = 'duration'
              AND date_diff('day', period_start, period_end) NOT BETWEEN 329 AND 399""", "facts"),
        "check_nonnegative": sql("""
            SELECT annual_key, cash - current_liabilities AS cash FROM annual
            WHERE cash - current_liabilities < 0""", "annual"),
        "check_one_current": sql("""
            SELECT cik, count(*) FILTER (WHERE valid_to IS NULL) AS open_versions FROM (
              SELECT cik, valid_to FROM history WHERE NOT (valid_to IS NULL AND cik % 7 = 0)
              UNION ALL SELECT cik, valid_to FROM history WHERE valid_to IS NULL AND cik % 10 = 4)
            GROUP BY cik HAVING count(*) FILTER (WHERE valid_to IS NULL) <> 1""", "history"),
    }
