"""The pair table derived from ``orders``: one SQL text that Spark and DuckDB both run."""

PAIRS_SQL = """
SELECT k AS row_id,
  CASE WHEN k % 97 = 0 THEN NULL
       ELSE 'Which order of priority ' || o_orderpriority || ' belongs to customer ' || c || '?'
  END AS paraphrased_question,
  CASE WHEN k % 89 = 0 THEN NULL
       WHEN k % 6 = 0 THEN 'DESCRIBE ex:K' || c
       WHEN k % 6 = 1 THEN 'SELECT DISTINCT ?f WHERE { VALUES ?g { ex:K' || c || ' ex:K' || q || ' ex:K' || p
         || ' } OPTIONAL { ?f (ex:R' || p || '/ex:R3)* ?g } MINUS { ?f a ex:T9 } } ORDER BY ?f LIMIT 20'
       WHEN k % 6 = 2 THEN 'CONSTRUCT { ?d ex:R' || p || ' ?e } WHERE { { ?d ^ex:R' || p || ' ?e } UNION { ?d ex:R'
         || q || ' ?e FILTER (?e IN (ex:K' || c || ', ex:K' || q || ')) } }'
       WHEN k % 6 = 3 THEN 'zz9ex:K' || c || ' ex:K' || c || 'tail m:ex:K' || c
       WHEN k % 6 = 4 THEN 'SELECT ?h (MIN(?i) AS ?least) WHERE { ?h ex:R1 ?i ; ex:R' || q || ' [] FILTER (?h != ex:K' || c
         || ') } GROUP BY ?h HAVING (MIN(?i) > ' || p || ')'
       ELSE 'ASK { ?l !ex ?m }'
  END AS sparql_wikidata,
  CASE WHEN k % 7 = 6 THEN 'test' ELSE 'train' END AS part
FROM (
  SELECT o_orderkey AS k, o_orderpriority,
    cast(o_custkey AS varchar(20)) AS c,
    cast(o_custkey % 40 AS varchar(20)) AS p,
    cast(o_orderkey % 700 AS varchar(20)) AS q
  FROM orders
) AS numbered
"""
