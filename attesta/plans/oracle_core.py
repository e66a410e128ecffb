"""Reference SQL for the rule evaluation, as a chain of CTEs over the driver's tables."""

from __future__ import annotations

from attesta import vocabulary as V
from attesta.plans import bindings as B


def core_ctes(unverified=()) -> str:
    q = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"""
WITH RECURSIVE
runs AS ({B.duck(B.RUNS)}), products AS ({B.duck(B.PRODUCTS)}), categories AS ({B.duck(B.CATEGORIES)}),
readings AS ({B.duck(B.READINGS)}), declarations AS ({B.duck(B.DECLARATIONS)}),
conditions AS ({V.conditions_sql()}), links AS ({V.links_sql()}), rules AS ({V.rules_sql(unverified)}),
requirements AS ({B.REQUIREMENTS}), instruments AS ({B.INSTRUMENTS}),
ancestry(category_code, ancestor_code, parent_code, depth) AS (
  SELECT category_code, category_code, parent_code, 0 FROM categories
  UNION ALL
  SELECT a.category_code, c.category_code, c.parent_code, a.depth + 1
  FROM ancestry a JOIN categories c ON c.category_code = a.parent_code),
candidates AS (
  SELECT DISTINCT p.product_id, r.rule_code
  FROM products p JOIN ancestry a ON a.category_code = p.category_code JOIN rules r ON r.target = a.ancestor_code
  WHERE r.is_active AND r.effective_from <= DATE '{B.AS_OF}'),
facts AS (
  SELECT product_id, condition_code, answer, updated_at FROM (
    SELECT d.*, row_number() OVER (PARTITION BY d.product_id, d.condition_code
                                   ORDER BY d.updated_at DESC, d.declaration_id DESC) AS rn
    FROM declarations d JOIN conditions c ON c.condition_code = d.condition_code) WHERE rn = 1),
lineage AS (SELECT DISTINCT p.product_id, a.ancestor_code FROM products p JOIN ancestry a ON a.category_code = p.category_code),
answers AS (
  SELECT p.product_id, c.condition_code, c.condition_name, c.determination,
         CASE WHEN c.determination = 'not_determinable' THEN 'unknown'
              WHEN f.answer IS NOT NULL THEN f.answer
              WHEN c.determination = 'product_category' AND p.category_code IS NOT NULL
                THEN CASE WHEN l.product_id IS NOT NULL THEN 'yes' ELSE 'no' END
              ELSE 'unknown' END AS answer
  FROM products p CROSS JOIN conditions c
  LEFT JOIN facts f ON f.product_id = p.product_id AND f.condition_code = c.condition_code
  LEFT JOIN lineage l ON l.product_id = p.product_id AND l.ancestor_code = c.category_code),
linked AS (
  SELECT a.product_id, k.clause, k.mode, k.link_order, a.condition_code, a.condition_name, a.answer
  FROM links k JOIN answers a ON a.condition_code = k.condition_code),
scopes AS (
  SELECT p.product_id, coalesce(bool_or(g.out_of_scope), FALSE) AS out_of_scope
  FROM products p LEFT JOIN (
    SELECT product_id, clause,
           bool_or(mode = 'scope_gate' AND answer = 'yes') AND NOT bool_or(mode = 'withholds_exemption' AND answer = 'yes')
             AS out_of_scope
    FROM linked WHERE clause IN ({q(V.SCOPE_CLAUSES)}) GROUP BY product_id, clause) g ON g.product_id = p.product_id
  GROUP BY p.product_id),
flags AS (
  SELECT product_id, clause,
         bool_or(mode = 'scope_gate') AS gates, bool_or(mode = 'requires') AS triggers,
         bool_or(mode = 'withholds_exemption' AND answer = 'yes') AS w_yes,
         bool_or(mode = 'withholds_exemption' AND answer = 'unknown') AS w_unk,
         bool_or(mode = 'scope_gate' AND answer = 'yes') AS g_yes, bool_or(mode = 'scope_gate' AND answer = 'unknown') AS g_unk,
         bool_or(mode = 'exempts' AND answer = 'yes') AS e_yes, bool_or(mode = 'exempts' AND answer = 'unknown') AS e_unk,
         bool_or(mode = 'requires' AND answer = 'yes') AS r_yes, bool_or(mode = 'requires' AND answer = 'unknown') AS r_unk
  FROM linked GROUP BY product_id, clause),
decisions AS (
  SELECT product_id, clause,
         CASE WHEN gates AND w_yes THEN 'applies' WHEN gates AND w_unk THEN 'undetermined'
              WHEN g_yes THEN 'does_not_apply' WHEN g_unk THEN 'undetermined'
              WHEN e_yes THEN 'does_not_apply' WHEN e_unk THEN 'undetermined'
              WHEN r_yes THEN 'applies' WHEN r_unk THEN 'undetermined'
              WHEN triggers THEN 'does_not_apply' ELSE 'applies' END AS decision,
         CASE WHEN gates AND w_yes THEN NULL WHEN gates AND w_unk THEN 'withholds_exemption' WHEN g_yes THEN NULL
              WHEN g_unk THEN 'scope_gate' WHEN e_yes THEN NULL WHEN e_unk THEN 'exempts' WHEN r_yes THEN NULL
              WHEN r_unk THEN 'requires' END AS blocking
  FROM flags),
unresolved AS (
  SELECT d.product_id, d.clause, string_agg(l.condition_code, ',' ORDER BY l.condition_code) AS codes
  FROM decisions d JOIN linked l ON l.product_id = d.product_id AND l.clause = d.clause AND l.mode = d.blocking AND l.answer = 'unknown'
  GROUP BY d.product_id, d.clause),
chosen AS (
  SELECT * FROM (
    SELECT r.*, row_number() OVER (PARTITION BY run_id, field_key ORDER BY coalesce(position, 1), reading_id) AS rn
    FROM readings r) WHERE rn = 1),
rule_keys AS (
  SELECT rule_code, unnest(string_split(keys, ',')) AS field_key, generate_subscripts(string_split(keys, ','), 1) AS pos
  FROM rules WHERE keys <> ''),
any_of AS (
  SELECT c.run_id, k.rule_code, min(k.pos) AS pos, string_agg(k.field_key, ', ' ORDER BY k.field_key) AS satisfied,
         arg_min(k.field_key, k.pos) AS field_key
  FROM rule_keys k JOIN chosen c ON c.field_key = k.field_key GROUP BY c.run_id, k.rule_code),
base AS (
  SELECT r.run_id, r.product_id, p.category_code, r.status AS run_status, r.image_id AS run_image_id, r.recognised_text,
         u.rule_code, u.check_type, u.keys, u.clause, u.severity, u.title, u.source_status,
         CASE WHEN u.rule_code IS NULL THEN NULL WHEN s.out_of_scope THEN 'out_of_scope'
              WHEN u.conditional AND u.clause IS NULL THEN 'unmapped'
              ELSE coalesce(d.decision, 'applies') END AS decision,
         x.codes AS unresolved,
         r.status = 'completed' AS usable
  FROM runs r LEFT JOIN products p ON p.product_id = r.product_id
  LEFT JOIN candidates c ON c.product_id = r.product_id
  LEFT JOIN rules u ON u.rule_code = c.rule_code
  LEFT JOIN scopes s ON s.product_id = r.product_id
  LEFT JOIN decisions d ON d.product_id = r.product_id AND d.clause = u.clause
  LEFT JOIN unresolved x ON x.product_id = r.product_id AND x.clause = u.clause),
judged AS (
  SELECT b.*, q.rn IS NOT NULL AS has_q, q.unit, q.raw_value AS q_raw, m.rn IS NOT NULL AS has_m, m.inclusive,
         cc.rn IS NOT NULL AS has_c, cc.has_phone, cc.has_email, o.rn IS NOT NULL AS has_o, o.year_month, o.uncertain AS o_unc,
         a.field_key AS any_key, a.satisfied,
         NOT m.uncertain AND NOT coalesce(m.confidence < 0.5, FALSE) AS m_strong,
         NOT cc.uncertain AND NOT coalesce(cc.confidence < 0.5, FALSE) AS c_strong
  FROM base b
  LEFT JOIN chosen q ON q.run_id = b.run_id AND q.field_key = 'net_quantity'
  LEFT JOIN chosen m ON m.run_id = b.run_id AND m.field_key = 'retail_sale_price'
  LEFT JOIN chosen cc ON cc.run_id = b.run_id AND cc.field_key = 'consumer_care_contact'
  LEFT JOIN chosen o ON o.run_id = b.run_id AND o.field_key = b.keys AND b.check_type IN ('field_presence', 'month_year_declaration')
  LEFT JOIN any_of a ON a.run_id = b.run_id AND a.rule_code = b.rule_code AND b.check_type = 'field_presence_any_of'),
raw_outcomes AS (
  SELECT *, CASE
    WHEN decision IS NULL THEN NULL
    WHEN decision IN ('out_of_scope', 'does_not_apply') THEN 'not_applicable'
    WHEN decision IN ('unmapped', 'undetermined') THEN 'inconclusive'
    WHEN check_type = 'field_presence' THEN CASE WHEN has_o THEN 'passed' WHEN NOT usable THEN 'inconclusive' ELSE 'failed' END
    WHEN check_type = 'field_presence_any_of' THEN CASE WHEN any_key IS NOT NULL THEN 'passed' WHEN NOT usable THEN 'inconclusive' ELSE 'failed' END
    WHEN check_type = 'consumer_care_elements' THEN
      CASE WHEN NOT usable OR NOT has_c OR (NOT has_phone AND NOT has_email) THEN 'inconclusive'
           WHEN has_phone AND has_email THEN 'passed' WHEN c_strong THEN 'failed' ELSE 'inconclusive' END
    WHEN check_type = 'month_year_declaration' THEN
      CASE WHEN usable AND has_o AND year_month IS NOT NULL AND NOT o_unc THEN 'passed' ELSE 'inconclusive' END
    WHEN check_type = 'si_unit' THEN
      CASE WHEN NOT usable OR NOT has_q OR unit IS NULL OR unit = 'zz' THEN 'inconclusive' WHEN unit = 'oz' THEN 'failed' ELSE 'passed' END
    WHEN check_type = 'prohibited_counting_unit' THEN
      CASE WHEN NOT usable OR NOT has_q THEN 'inconclusive' WHEN q_raw LIKE '%dozen%' THEN 'failed' ELSE 'passed' END
    WHEN check_type = 'retail_price_tax_declaration' THEN
      CASE WHEN NOT usable OR NOT has_m THEN 'inconclusive' WHEN inclusive IS NULL OR inclusive THEN 'passed'
           WHEN m_strong THEN 'failed' ELSE 'inconclusive' END
  END AS raw_status,
  CASE WHEN decision IS NULL OR decision <> 'applies' THEN ''
       WHEN check_type = 'field_presence_any_of' THEN coalesce(any_key, string_split(keys, ',')[1])
       WHEN check_type IN ('field_presence', 'month_year_declaration') THEN keys
       WHEN check_type = 'consumer_care_elements' THEN 'consumer_care_contact'
       WHEN check_type = 'retail_price_tax_declaration' THEN 'retail_sale_price'
       ELSE 'net_quantity' END AS field_key
  FROM judged),
outcomes AS (
  SELECT *, raw_status = 'failed' AND source_status <> 'verified' AS downgraded,
         CASE WHEN raw_status = 'failed' AND source_status <> 'verified' THEN 'inconclusive' ELSE raw_status END AS status
  FROM raw_outcomes),
counted AS (
  SELECT run_id, product_id, category_code, run_status, count(rule_code) AS applicable,
         count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed,
         count(*) FILTER (status = 'inconclusive') AS inconclusive,
         count(*) FILTER (status = 'not_applicable') AS not_applicable
  FROM outcomes GROUP BY ALL),
verdicts AS (
  SELECT *, passed + failed + inconclusive AS evaluated,
         CASE WHEN applicable = 0 OR applicable = not_applicable OR run_status <> 'completed' THEN 'review_required'
              WHEN failed > 0 AND inconclusive = 0 THEN 'non_compliant' WHEN failed > 0 THEN 'partially_compliant'
              WHEN inconclusive > 0 THEN 'review_required' WHEN passed > 0 THEN 'compliant' ELSE 'review_required' END AS result,
         CASE WHEN applicable = 0 AND category_code IS NULL THEN 'category not known'
              WHEN applicable = 0 THEN 'no rules loaded for this category'
              WHEN applicable = not_applicable THEN 'every selected rule was ruled out'
              WHEN run_status <> 'completed' THEN 'no readable text'
              WHEN failed > 0 AND inconclusive = 0 THEN 'rules not met' WHEN failed > 0 THEN 'rules not met and rules undecided'
              WHEN inconclusive > 0 THEN 'rules undecided' WHEN passed > 0 THEN 'all applicable rules met'
              ELSE 'no usable outcome' END AS summary
  FROM counted)
"""


def core(select: str, unverified=()) -> str:
    return core_ctes(unverified) + select
