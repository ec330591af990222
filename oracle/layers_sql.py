"""The layers in plain SQL, written apart from the DataFrame code they check."""

from __future__ import annotations

import re

from claimloom.sources.testbed import AS_OF, STATEMENTS

PREFIX = "CLM"


def _trimmed(x: str) -> str:
    return f"nullif(trim({x}), '')"


def _code(x: str) -> str:
    return f"upper({_trimmed(x)})"


def title(x: str) -> str:
    words = f"array_to_string(list_transform(string_split(lower({_trimmed(x)}), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ')"
    out = f"CASE WHEN {_trimmed(x)} IS NULL THEN NULL ELSE {words} END"
    for acronym in ("MD", "ENT", "OB/GYN", "RN", "PA", "DO", "NP"):
        out = f"regexp_replace({out}, '(^|[^A-Za-z]){acronym}($|[^A-Za-z])', '\\1{acronym}\\2', 'gi')"
    return out


def boolean(x: str) -> str:
    return (
        f"CASE WHEN {_code(x)} IN ('1','TRUE','YES','Y') THEN true "
        f"WHEN {_code(x)} IN ('0','FALSE','NO','N') THEN false END"
    )


def money(x: str) -> str:
    return f"TRY_CAST({_trimmed(x)} AS DECIMAL(18,2))"


def _rank(keys: str, first: str = "_ingested_at") -> str:
    return (
        f"row_number() OVER (PARTITION BY {keys} ORDER BY {first} DESC NULLS LAST, _pipeline_run_id DESC NULLS LAST, "
        "_source_file DESC NULLS LAST, _row_id DESC)"
    )


def _failure(rules: list[tuple[str, int, str, str]]) -> str:
    def case(pick) -> str:
        whens = " ".join(f"WHEN {rule[3]} THEN '{pick(rule)}'" for rule in rules)
        return f"CASE {whens} END"

    return (
        f"{case(lambda r: f'{PREFIX}-SLV-{r[1]}')} AS diagnostic_id, "
        f"{case(lambda r: r[0])} AS rule_name, {case(lambda r: r[2])} AS quarantine_reason"
    )


CLAIM_RULES = [
    ("missing_claim_id", 101, "claim_id is required for a trusted silver record", "claim_id IS NULL"),
    ("missing_patient_id", 102, "patient_id is required for a trusted silver record", "patient_id IS NULL"),
    ("missing_provider_id", 103, "provider_id is required for a trusted silver record", "provider_id IS NULL"),
    ("missing_diagnosis_code", 104, "diagnosis_code is required for a trusted silver record", "diagnosis_code IS NULL"),
    ("invalid_claim_date", 105, "claim date could not be parsed into yyyy-MM-dd", "date IS NULL"),
    ("unknown_provider_reference", 106, "provider_id does not match a known provider reference row",
     "provider_id IS NOT NULL AND NOT provider_known"),
    ("unknown_diagnosis_reference", 107, "diagnosis_code does not match a known diagnosis reference row",
     "diagnosis_code IS NOT NULL AND NOT diagnosis_known"),
    ("inconsistent_denial_label", 108, "is_denied must agree with denial_reason_code != NONE",
     "is_denied IS NULL OR denial_reason_code IS NULL OR (is_denied AND denial_reason_code = 'NONE') "
     "OR (NOT is_denied AND denial_reason_code <> 'NONE')"),
    ("duplicate_claim_id", 109, "duplicate claim_id observed in the silver validation input", "rn > 1"),
]
PROVIDER_RULES = [
    ("missing_provider_id", 201, "provider_id is required for a trusted provider record", "provider_id IS NULL"),
    ("missing_doctor_name", 202, "doctor_name is required for credential verification", "doctor_name IS NULL"),
    ("duplicate_provider_id", 203, "duplicate provider_id observed in the silver stream", "rn > 1"),
]
DIAGNOSIS_RULES = [
    ("missing_diagnosis_code", 301, "diagnosis_code is required for lookup validation", "diagnosis_code IS NULL"),
    ("missing_category", 302, "category is required for specialty mismatch features", "category IS NULL"),
    ("missing_severity", 303, "severity is required for downstream risk features", "severity IS NULL"),
    ("invalid_severity", 304, "severity must normalize to High or Low", "severity NOT IN ('High','Low')"),
    ("duplicate_diagnosis_code", 305, "duplicate diagnosis_code observed in the silver stream", "rn > 1"),
]
COST_RULES = [
    ("missing_procedure_code", 401, "procedure_code is required for benchmark joins", "procedure_code IS NULL"),
    ("missing_region", 404, "region is required for regional cost benchmarks", "region IS NULL"),
    ("invalid_average_cost", 402, "average_cost must parse to a positive decimal", "coalesce(average_cost, 0) <= 0"),
    ("invalid_expected_cost", 403, "expected_cost must parse to a positive decimal", "coalesce(expected_cost, 0) <= 0"),
    ("duplicate_cost_key", 405, "duplicate procedure_code + region observed in the silver stream", "rn > 1"),
]
DOCUMENT_RULES = [
    ("unreadable_pdf", 501, "policy text could not be extracted from the document", "extraction_status = 'UNREADABLE_PDF'"),
    ("empty_pdf_text", 502, "policy document produced no extractable text", "extraction_status = 'EMPTY_PDF_TEXT'"),
    ("duplicate_policy_path", 503, "duplicate policy path observed in the silver stream", "rn > 1"),
]

_SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def _visible(x: str) -> str:
    for pattern in ("<!--.*?-->", "<script\\b.*?</script>", "<style\\b.*?</style>"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'gis')"
    return f"regexp_replace({x}, '<[A-Za-z/!?][^>]*>', ' ', 'g')"


def _entities(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


_RAW_COLUMNS = "_ingested_at, _source_file, _pipeline_run_id"

CTES: dict[str, str] = {
    f"bronze_{name}": sql.format(**{s: s for s in sources}) for name, (sql, sources) in STATEMENTS.items()
}
CTES |= {
    "known_providers": f"SELECT DISTINCT {_code('provider_id')} AS k FROM bronze_providers WHERE {_code('provider_id')} IS NOT NULL",
    "known_diagnosis": f"SELECT DISTINCT {_code('diagnosis_code')} AS k FROM bronze_diagnosis WHERE {_code('diagnosis_code')} IS NOT NULL",
    "clean_claims": f"""
      SELECT {', '.join(f"{_code(c)} AS {c}" for c in ('claim_id', 'patient_id', 'provider_id', 'diagnosis_code', 'procedure_code', 'claim_status', 'denial_reason_code'))},
        {', '.join(f"{money(c)} AS {c}" for c in ('billed_amount', 'allowed_amount', 'paid_amount'))},
        {boolean('is_denied')} AS is_denied, {boolean('follow_up_required')} AS follow_up_required,
        CAST(try_strptime({_trimmed('date')}, '%Y-%m-%d') AS DATE) AS date,
        _rescued_data, {_RAW_COLUMNS}, _row_id
      FROM bronze_claims""",
    "ranked_claims": f"""
      SELECT c.*, {_rank('claim_id')} AS rn, p.k IS NOT NULL AS provider_known, d.k IS NOT NULL AS diagnosis_known,
        list_filter([CASE WHEN billed_amount IS NULL THEN 'missing_billed_amount' END,
                     CASE WHEN procedure_code IS NULL THEN 'missing_procedure_code' END], lambda x: x IS NOT NULL) AS _data_quality_flags
      FROM clean_claims c LEFT JOIN known_providers p ON c.provider_id = p.k LEFT JOIN known_diagnosis d ON c.diagnosis_code = d.k""",
    "v_claims": f"SELECT *, {_failure(CLAIM_RULES)} FROM ranked_claims",
    "t_claims": "SELECT * FROM v_claims WHERE rule_name IS NULL",
    "q_claims": "SELECT * FROM v_claims WHERE rule_name IS NOT NULL",
    "clean_providers": f"""
      SELECT {_code('provider_id')} AS provider_id, {title('doctor_name')} AS doctor_name, {title('specialty')} AS specialty,
        {title('location')} AS raw_location, _rescued_data, {_RAW_COLUMNS}, _row_id FROM bronze_providers""",
    "v_providers": f"""
      SELECT *, {_failure(PROVIDER_RULES)} FROM (
        SELECT *, coalesce(raw_location, 'Unknown') AS location,
          CASE WHEN raw_location IS NULL THEN 'provider_location_unknown' ELSE '' END AS flags,
          {_rank('provider_id')} AS rn FROM clean_providers) x""",
    "t_providers": "SELECT * FROM v_providers WHERE rule_name IS NULL",
    "q_providers": "SELECT * FROM v_providers WHERE rule_name IS NOT NULL",
    "v_diagnosis": f"""
      SELECT *, {_failure(DIAGNOSIS_RULES)} FROM (
        SELECT *, {_rank('diagnosis_code')} AS rn FROM (
          SELECT {_code('diagnosis_code')} AS diagnosis_code, {title('category')} AS category, {title('severity')} AS severity,
            _rescued_data, {_RAW_COLUMNS}, _row_id FROM bronze_diagnosis) x) y""",
    "t_diagnosis": "SELECT * FROM v_diagnosis WHERE rule_name IS NULL",
    "q_diagnosis": "SELECT * FROM v_diagnosis WHERE rule_name IS NOT NULL",
    "v_cost": f"""
      SELECT *, {_failure(COST_RULES)} FROM (
        SELECT *, {_rank('procedure_code, region')} AS rn FROM (
          SELECT {_code('procedure_code')} AS procedure_code, {money('average_cost')} AS average_cost,
            {money('expected_cost')} AS expected_cost, {title('region')} AS region,
            _rescued_data, {_RAW_COLUMNS}, _row_id FROM bronze_cost) x) y""",
    "t_cost": "SELECT * FROM v_cost WHERE rule_name IS NULL",
    "q_cost": "SELECT * FROM v_cost WHERE rule_name IS NOT NULL",
    "documents_visible": f"""
      SELECT *, coalesce(content, '') AS raw, path LIKE '%.html' OR path LIKE '%.htm' AS is_markup,
        {_visible("coalesce(content, '')")} AS visible, {_rank('path', 'coalesce(_ingested_at, modificationTime)')} AS rn
      FROM bronze_policies""",
    "documents_text": f"""
      SELECT *, is_markup AND regexp_matches(visible, '<[A-Za-z/!?]') AS broken,
        nullif(regexp_replace(CASE WHEN is_markup THEN {_entities('visible')} ELSE raw END, '^{_SPACE}|{_SPACE}$', '', 'g'), '') AS body
      FROM documents_visible""",
    "v_documents": f"""
      SELECT *, {_failure(DOCUMENT_RULES)} FROM (
        SELECT path, length, _ingested_at, modificationTime, _source_file, _pipeline_run_id, rn,
          CASE WHEN NOT broken THEN body END AS policy_text,
          CASE WHEN broken THEN 'UNREADABLE_PDF' WHEN body IS NULL THEN 'EMPTY_PDF_TEXT' ELSE 'OK' END AS extraction_status,
          CASE WHEN broken THEN 'markup ends inside a tag' END AS extraction_error_message,
          CASE WHEN broken THEN 'unreadable_pdf' WHEN body IS NULL THEN 'empty_pdf_text' ELSE '' END AS flags
        FROM documents_text) x""",
    "document_tokens": f"""
      SELECT path, flags, _source_file, _pipeline_run_id,
        string_split(trim(regexp_replace(policy_text, '{_SPACE}', ' ', 'g')), ' ') AS tokens
      FROM v_documents WHERE rule_name IS NULL""",
    "chunk_rows": """
      SELECT path, flags, _source_file, _pipeline_run_id, chunk_index,
        tokens[chunk_index * 448 + 1 : chunk_index * 448 + 512] AS part
      FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(tokens) - 512) / 448.0)) AS BIGINT) + 1)) AS chunk_index
            FROM document_tokens) x""",
    "chunks": """
      SELECT sha256(concat(path, '::', chunk_index)) AS chunk_id, path AS document_path, chunk_index,
        array_to_string(part, ' ') AS chunk_text, len(part) AS token_count, flags, _source_file, _pipeline_run_id
      FROM chunk_rows""",
    "provider_totals": """
      SELECT provider_id, count(*) AS provider_claim_count, sum(CASE WHEN is_denied THEN 1 ELSE 0 END) / count(*) AS provider_risk_score,
        count(DISTINCT diagnosis_code) AS diagnosis_count
      FROM t_claims WHERE provider_id IS NOT NULL GROUP BY provider_id""",
    "windowed_claims": """
      SELECT *, count(*) OVER (PARTITION BY provider_id ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)
        AS provider_claim_count_30d
      FROM t_claims""",
    "gold_joined": """
      SELECT c.*, p.specialty, p.location, d.category, d.severity, k.average_cost, k.expected_cost
      FROM windowed_claims c
      LEFT JOIN t_providers p ON c.provider_id = p.provider_id
      LEFT JOIN t_diagnosis d ON c.diagnosis_code = d.diagnosis_code
      LEFT JOIN t_cost k ON c.procedure_code = k.procedure_code AND p.location = k.region""",
    "gold": """
      SELECT g.*, procedure_code IS NULL AS is_procedure_missing, billed_amount IS NULL AS is_amount_missing,
        CASE WHEN expected_cost > 0 THEN CAST(billed_amount AS DOUBLE) / CAST(expected_cost AS DOUBLE) END AS amount_to_benchmark_ratio,
        CASE WHEN average_cost > 0 THEN CAST(billed_amount AS DOUBLE) / CAST(average_cost AS DOUBLE) END AS billed_vs_avg_cost,
        coalesce(expected_cost > 0 AND CAST(billed_amount AS DOUBLE) / CAST(expected_cost AS DOUBLE) >= 1.5, false) AS high_cost_flag,
        coalesce(severity = 'High' AND expected_cost < 5000, false) AS severity_procedure_mismatch,
        CASE WHEN specialty IS NOT NULL AND category IS NOT NULL THEN lower(specialty) <> lower(category) END AS specialty_diagnosis_mismatch,
        location IS NULL AS provider_location_missing,
        CASE severity WHEN 'High' THEN 1 WHEN 'Low' THEN 0 END AS diagnosis_severity_encoded,
        t.diagnosis_count, t.provider_claim_count, t.provider_risk_score,
        CASE WHEN is_denied THEN 1 ELSE 0 END AS denial_label
      FROM gold_joined g LEFT JOIN provider_totals t ON g.provider_id = t.provider_id""",
    "enriched": """
      SELECT c.claim_id, c.provider_id, c.diagnosis_code, c.date, c.procedure_code AS claim_procedure_code, c.billed_amount,
        p.doctor_name, p.specialty, p.location AS provider_region,
        k.procedure_code AS cost_procedure_code, k.region AS cost_region, k.expected_cost,
        CAST(c.billed_amount AS DOUBLE) / nullif(CAST(k.expected_cost AS DOUBLE), 0) AS amount_to_benchmark_ratio
      FROM t_claims c LEFT JOIN t_providers p ON c.provider_id = p.provider_id
      LEFT JOIN t_cost k ON c.procedure_code = k.procedure_code AND p.location = k.region""",
    "features": """
      SELECT claim_id, CAST(is_procedure_missing AS INT) AS is_procedure_missing, CAST(is_amount_missing AS INT) AS is_amount_missing,
        coalesce(amount_to_benchmark_ratio, 0.0) AS amount_to_benchmark_ratio, coalesce(billed_vs_avg_cost, 0.0) AS billed_vs_avg_cost,
        CAST(high_cost_flag AS INT) AS high_cost_flag, CAST(severity_procedure_mismatch AS INT) AS severity_procedure_mismatch,
        coalesce(CAST(specialty_diagnosis_mismatch AS INT), 0) AS specialty_diagnosis_mismatch,
        CAST(provider_location_missing AS INT) AS provider_location_missing,
        coalesce(diagnosis_severity_encoded, 0) AS diagnosis_severity_encoded, coalesce(diagnosis_count, 1) AS diagnosis_count,
        coalesce(provider_claim_count, 0) AS provider_claim_count, coalesce(provider_claim_count_30d, 0) AS provider_claim_count_30d,
        coalesce(provider_risk_score, 0.0) AS provider_risk_score, denial_label FROM gold""",
    "model_scores": """
      SELECT model_name, label, CASE model_name WHEN 'ratio' THEN least(ratio / 4.0, 1.0) WHEN 'provider' THEN risk
               ELSE least(1.0, CASE WHEN label = 1 THEN 0.75 ELSE 0.1 END + risk / 4.0) END AS probability
      FROM (SELECT denial_label AS label, provider_risk_score AS risk, greatest(amount_to_benchmark_ratio, 0.0) AS ratio FROM features) f
      CROSS JOIN (SELECT unnest(['ratio', 'provider', 'informed']) AS model_name) m""",
    "confusion": """
      SELECT model_name, count(*) FILTER (label = 0 AND probability <= 0.5) AS tn, count(*) FILTER (label = 0 AND probability > 0.5) AS fp,
        count(*) FILTER (label = 1 AND probability <= 0.5) AS fn, count(*) FILTER (label = 1 AND probability > 0.5) AS tp,
        count(*) FILTER (label = 1 AND probability >= 0.7) AS tp_high
      FROM model_scores GROUP BY model_name""",
    "areas": """
      SELECT model_name, (sum(CASE WHEN label = 1 THEN mid END) - max(p) * (max(p) + 1) / 2.0) / (max(p) * max(n)) AS roc_auc FROM (
        SELECT model_name, label, sum(label) OVER (PARTITION BY model_name) AS p, sum(1 - label) OVER (PARTITION BY model_name) AS n,
          rank() OVER (PARTITION BY model_name ORDER BY probability) + (count(*) OVER (PARTITION BY model_name, probability) - 1) / 2.0 AS mid
        FROM model_scores) r GROUP BY model_name""",
    "metrics": """
      SELECT c.model_name, (tp + tn) / (tn + fp + fn + tp) AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp_high / (tp + fn) END AS recall_at_high, round(roc_auc, 9) AS roc_auc, tn, fp, fn, tp
      FROM confusion c JOIN areas a ON c.model_name = a.model_name""",
    "label_inputs": """
      SELECT c.*, CASE WHEN k.expected_cost > 0 THEN k.expected_cost END AS expected_cost, r.claim_id IS NOT NULL AS in_review
      FROM t_claims c LEFT JOIN t_providers p ON c.provider_id = p.provider_id
      LEFT JOIN t_cost k ON c.procedure_code = k.procedure_code AND p.location = k.region
      LEFT JOIN bronze_review_ids r ON c.claim_id = r.claim_id""",
    "labelled": """
      SELECT claim_id, reason, CASE WHEN reason = 'NONE' THEN 'APPROVED' ELSE 'DENIED' END AS claim_status,
        CAST(coalesce(allowed, 0) AS DECIMAL(18,2)) AS allowed,
        CASE WHEN reason = 'NONE' THEN CAST(coalesce(allowed, 0) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS paid
      FROM (SELECT claim_id,
        CASE WHEN procedure_code IS NULL THEN 'MISSING_PROCEDURE' WHEN billed_amount IS NULL THEN 'MISSING_BILLED_AMOUNT'
             WHEN billed_amount > expected_cost * 2.5 THEN 'OVER_BENCHMARK' WHEN in_review THEN 'MEDICAL_REVIEW' ELSE 'NONE' END AS reason,
        CASE WHEN procedure_code IS NULL OR billed_amount IS NULL THEN NULL WHEN billed_amount > expected_cost * 2.5 THEN expected_cost
             WHEN in_review THEN CAST(billed_amount * CAST(0.60 AS DECIMAL(4,2)) AS DECIMAL(18,2))
             WHEN expected_cost IS NOT NULL THEN least(billed_amount, CAST(expected_cost * CAST(1.05 AS DECIMAL(4,2)) AS DECIMAL(18,2)))
             ELSE CAST(billed_amount * CAST(0.85 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS allowed
        FROM label_inputs) x""",
}

_NAME = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)")


def with_layers(select: str) -> str:
    """``select`` preceded by the layers it needs, in order of dependence."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(select)
    parts = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ordered)
    return f"WITH {parts}\n{select.strip()}" if parts else select.strip()


AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
