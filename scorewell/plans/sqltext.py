"""DuckDB text of the study tables and of a few distribution functions, for the SQL checks."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """``body`` behind the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in CTES[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order)
    if not head:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + head + ",\n" + body.lstrip()[len("WITH RECURSIVE "):]
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + head + ",\n" + body.lstrip()[5:]
    return "WITH " + head + "\n" + body


cte(
    "responses",
    """
  SELECT user_id, instrument_name, question_id, response_value, submitted_at FROM (
    SELECT concat('u', CAST(o_custkey AS VARCHAR)) AS user_id,
           concat('module', CAST(1 + l_partkey % 7 AS VARCHAR), '_', base) AS instrument_name,
           concat('Q', CAST(l_linenumber AS VARCHAR)) AS question_id,
           CASE WHEN l_returnflag = 'A' THEN concat(substr('ABCD', CAST(1 + CAST(l_quantity AS INT) % 4 AS INT), 1), ': option')
                ELSE CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'Strongly disagree' WHEN 1 THEN 'Disagree'
                     WHEN 2 THEN 'Agree' ELSE 'Strongly agree' END END AS response_value,
           l_shipdate AS submitted_at,
           row_number() OVER (PARTITION BY o_custkey, 1 + l_partkey % 7, base, l_linenumber
             ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS attempt
    FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'content_mcq_assessment' WHEN 'N' THEN 'engagement_survey'
                 ELSE 'motivation_survey' END AS base
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  ) WHERE attempt = 1""",
)
cte(
    "demographics",
    """
  SELECT concat('u', CAST(c_custkey AS VARCHAR)) AS user_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Fourth (4th) grade' WHEN 'BUILDING' THEN 'Fifth (5th) grade'
              WHEN 'FURNITURE' THEN 'Sixth (6th) grade' WHEN 'HOUSEHOLD' THEN 'Adult' END AS grade,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '4' WHEN 'BUILDING' THEN '5' WHEN 'FURNITURE' THEN '6'
              WHEN 'HOUSEHOLD' THEN 'Adult' END AS grade_level,
         CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS gender,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 4 = 1 END AS first_language_english
  FROM customer""",
)
cte(
    "cohort_map",
    """
  SELECT concat('u', CAST(c_custkey AS VARCHAR)) AS user_id,
         CASE WHEN c_nationkey % 5 <> 0 THEN n_name END AS cohort_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
cte(
    "parsed",
    """
  SELECT *, CAST(substr(instrument_name, 7, 1) AS INT) AS module_num,
         substr(instrument_name, 9) AS base,
         CAST(substr(question_id, 2) AS INT) AS q,
         CASE WHEN submitted_at < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS version
  FROM responses""",
    "responses",
)
cte(
    "scored",
    """
  SELECT user_id, concat('module_', CAST(module_num AS VARCHAR)) AS module_id, instrument_name AS instrument_key,
         question_id, response_value,
         CASE WHEN base = 'content_mcq_assessment' THEN
                CASE WHEN q = 7 AND version = 0 THEN NULL
                     WHEN substr(response_value, 1, 1) = substr('ABCD', 1 + (module_num + q + version) % 4, 1) THEN 1.0 ELSE 0.0 END
              ELSE CAST(CASE WHEN base = 'engagement_survey' AND q IN (6, 7)
                   THEN CASE response_value WHEN 'Strongly disagree' THEN 4 WHEN 'Disagree' THEN 3 WHEN 'Agree' THEN 2 ELSE 1 END
                   ELSE CASE response_value WHEN 'Strongly disagree' THEN 1 WHEN 'Disagree' THEN 2 WHEN 'Agree' THEN 3 ELSE 4 END
                   END AS DOUBLE) END::DOUBLE AS item_score,
         CASE WHEN base = 'engagement_survey' THEN CASE WHEN q <= 3 THEN 'task' WHEN q <= 5 THEN 'effort' ELSE 'attention' END
              WHEN base = 'motivation_survey' THEN CASE WHEN q <= 2 THEN 'intrinsic_motivation' WHEN q <= 4 THEN 'identified_regulation'
                   WHEN q <= 6 THEN 'external_regulation' ELSE 'amotivation' END END AS construct,
         submitted_at, module_num, base, q
  FROM parsed""",
    "parsed",
)
cte(
    "canon",
    """
  SELECT s.user_id, module_id, instrument_key, question_id, response_value, item_score, construct, grade,
         submitted_at, CAST(NULL AS TIMESTAMP) AS completed_at, cohort_id, module_num, base, q
  FROM scored s LEFT JOIN demographics d ON s.user_id = d.user_id LEFT JOIN cohort_map c ON s.user_id = c.user_id""",
    "scored", "demographics", "cohort_map",
)
cte(
    "prepost",
    """
  SELECT * REPLACE (CASE WHEN submitted_at < TIMESTAMP '1998-07-01' THEN 'precourse_pre_knowledge_assessment'
                    ELSE 'postcourse_post_knowledge_assessment' END AS instrument_key)
  FROM canon WHERE base = 'content_mcq_assessment'""",
    "canon",
)


# Distribution functions as series, independent of the continued fractions the library uses.
def beta_inc(a: str, b: str, x: str, terms: int = 3000) -> str:
    """Regularised incomplete beta by its power series, mirrored to the side where it converges."""

    def series(a: str, b: str, x: str) -> str:
        return (
            f"(CASE WHEN ({x}) <= 0 THEN 0.0 ELSE exp(({a})*ln({x}) + ({b})*ln(1-({x})) - ln({a}) + lgamma(({a})+({b})) - lgamma({a}) - lgamma({b})"
            f") * list_sum(list_transform(range(0, {terms}), lambda j_: exp(lgamma(({a})+({b})+j_) - lgamma(({a})+({b}))"
            f" + lgamma(({a})+1) - lgamma(({a})+1+j_) + j_*ln({x})))) END)"
        )

    return (
        f"(CASE WHEN ({x}) <= 0 THEN 0.0 WHEN ({x}) >= 1 THEN 1.0 WHEN ({x}) <= 0.5 THEN {series(a, b, x)} "
        f"ELSE 1 - {series(b, a, f'(1-({x}))')} END)"
    )


def t_two_sided(t: str, df: str) -> str:
    return beta_inc(f"(({df})/2.0)", "0.5", f"(({df})/(({df})+({t})*({t})))")


def f_sf(f: str, d1: str, d2: str) -> str:
    return beta_inc(f"(({d2})/2.0)", f"(({d1})/2.0)", f"(({d2})/(({d2})+({d1})*({f})))")


def norm_sf(z: str) -> str:
    """Upper normal tail: odd-factorial series near 0, continued expansion beyond 6 is below 1e-9."""
    s = (
        f"(exp(-({z})*({z})/2)/sqrt(2*pi()) * list_sum(list_transform(range(0, 400), lambda j_: "
        f"exp((2*j_+1)*ln(greatest(abs({z}), 1e-300)) - ((j_+1)*ln(2) + lgamma(j_+1.5) - 0.5*ln(pi()))))))"
    )
    return f"(CASE WHEN ({z}) >= 0 THEN 0.5 - {s} ELSE 0.5 + {s} END)"


def chi2_sf(x: str, k: str, terms: int = 2000) -> str:
    a = f"(({k})/2.0)"
    h = f"(({x})/2.0)"
    return (
        f"(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, {terms}), lambda j_: "
        f"exp(({a}+j_)*ln({h}) - {h} - lgamma({a}+j_+1)))) END)"
    )
