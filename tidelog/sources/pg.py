"""Questions to PostgreSQL's catalog for what the driver's metadata does not tell. Names are schema.object; system schemas are left out."""

_USER = "n.nspname NOT IN ('pg_catalog', 'information_schema', 'pg_toast')"

#: Sequences with their limits; where each stands is asked of the sequence itself.
SEQUENCES = """
SELECT sequence_schema || '.' || sequence_name AS name, data_type AS type, CAST(start_value AS numeric) AS start, CAST(minimum_value AS numeric) AS min,
  CAST(maximum_value AS numeric) AS max, CAST(increment AS numeric) AS increment, cycle_option = 'YES' AS cycle FROM information_schema.sequences"""

#: Unique and check constraints, key columns in their order.
CONSTRAINTS = f"""
SELECT n.nspname || '.' || t.relname AS table_name, c.conname AS name, CASE c.contype WHEN 'u' THEN 'UNIQUE' ELSE 'CHECK' END AS type, k.ordinal, a.attname AS column_name,
  CASE c.contype WHEN 'c' THEN pg_get_constraintdef(c.oid) END AS definition
FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace
LEFT JOIN LATERAL unnest(CASE c.contype WHEN 'u' THEN c.conkey END) WITH ORDINALITY AS k(number, ordinal) ON TRUE
LEFT JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.number
WHERE c.contype IN ('u', 'c') AND {_USER}"""

#: Functions and procedures with their whole definition.
ROUTINES = f"""
SELECT CAST(p.oid AS bigint) AS id, n.nspname || '.' || p.proname AS name, CAST(p.prokind AS text) AS kind, l.lanname AS language,
  CASE p.provolatile WHEN 'i' THEN 'IMMUTABLE' WHEN 's' THEN 'STABLE' END AS volatility, pg_get_function_arguments(p.oid) AS parameters,
  CASE p.prokind WHEN 'f' THEN pg_get_function_result(p.oid) END AS return_type, pg_get_functiondef(p.oid) AS full_definition
FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace JOIN pg_language l ON l.oid = p.prolang WHERE p.prokind IN ('f', 'p') AND {_USER}"""

#: Which routine needs which.
DEPENDS = """
SELECT CAST(objid AS bigint) AS id, CAST(refobjid AS bigint) AS needs_id, CAST(deptype AS text) AS kind FROM pg_depend
WHERE classid = CAST('pg_proc' AS regclass) AND refclassid = CAST('pg_proc' AS regclass)"""

TRIGGERS = f"""
SELECT g.tgname AS name, pg_get_triggerdef(g.oid, true) AS definition FROM pg_trigger g JOIN pg_class t ON t.oid = g.tgrelid
JOIN pg_namespace n ON n.oid = t.relnamespace WHERE NOT g.tgisinternal AND {_USER}"""
