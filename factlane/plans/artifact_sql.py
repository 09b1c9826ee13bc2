"""SQL for the artifact queries: the archives are made from a rule, so what is in them can be said over range(64)."""

from __future__ import annotations

#: Entries of an archive in physical order: a manifest, a service, classes 0-19, a version of class 0, and an archive of classes 20-39.
BASE = """WITH ent AS (SELECT k, i AS unit_seq, format('sample-{:04d}.jar', k) AS path, CAST(CASE WHEN i < 24 THEN 0 ELSE 1 END AS INTEGER) AS depth, CASE WHEN i < 24 THEN i ELSE i - 24 END AS ordinal,
  CASE WHEN i BETWEEN 2 AND 21 THEN i - 2 WHEN i = 22 THEN 0 WHEN i >= 24 THEN i - 4 END AS c, CAST(CASE WHEN i = 22 THEN 11 ELSE -1 END AS INTEGER) AS variant_version
  FROM range(64) AS a(k), range(44) AS b(i)),
units AS (SELECT *, CASE unit_seq WHEN 0 THEN 'META-INF/MANIFEST.MF' WHEN 1 THEN 'META-INF/services/p' || k || '.C0' WHEN 23 THEN 'lib/inner.jar'
  ELSE CASE unit_seq WHEN 22 THEN 'META-INF/versions/11/' ELSE '' END || 'p' || k || '/C' || c || '.class' END AS name FROM ent),
cls AS (SELECT *, 'p' || k || '/C' || c AS this_class FROM units WHERE c IS NOT NULL),
body(member_index, method, descriptor, code_length) AS (VALUES (1, '<init>', '()V', 5), (2, 'add', '(II)I', 4), (3, 'call', '()V', 22), (4, 'run', '()V', 5)),
text AS (SELECT path, unit_seq, this_class, member_index, method, descriptor, CASE member_index WHEN 1 THEN 'super();' || chr(10) WHEN 2 THEN 'return (p0 + p1);' || chr(10)
  WHEN 3 THEN 'var v1 = new p' || k || '.C' || (c + 1) || '();' || chr(10) || 'if (!(this.count != 0)) {' || chr(10) || '}' || chr(10) ELSE 'this.call();' || chr(10) END AS text FROM cls, body)
"""
_NONE = "CAST(NULL AS VARCHAR)"
#: member, place, opcode and width of the instructions of a class.
CODE = [(1, 0, 0x2A, 1), (1, 1, 0xB7, 3), (1, 4, 0xB1, 1), (2, 0, 0x1B, 1), (2, 1, 0x1C, 1), (2, 2, 0x60, 1), (2, 3, 0xAC, 1), (3, 0, 0xBB, 3), (3, 3, 0x59, 1), (3, 4, 0xB7, 3), (3, 7, 0x4C, 1),
        (3, 8, 0x2A, 1), (3, 9, 0xB4, 3), (3, 12, 0x9A, 3), (3, 15, 0x12, 2), (3, 17, 0x57, 1), (3, 18, 0xA7, 3), (3, 21, 0xB1, 1), (4, 0, 0x2A, 1), (4, 1, 0xB6, 3), (4, 4, 0xB1, 1)]
_CALL = "this_class AS owner, 'call' AS name, '()V' AS descriptor, 4 AS member_index, 1 AS bci"

SQL: dict[str, str] = {name: BASE + body for name, body in {
    "artifact_entries": f"""SELECT path, depth, ordinal, name, CASE depth WHEN 0 THEN 'deflated' ELSE 'stored' END AS method, false AS is_dir, c IS NOT NULL AS is_class_candidate,
  'read' AS read_status, {_NONE} AS stop_code, variant_version FROM units""",
    "artifact_classes": """SELECT path, unit_seq, ordinal, name, variant_version, 52 AS major, 0 AS minor, 33 AS flags, this_class,
  CASE WHEN c % 5 = 0 THEN 'p' || k || '/C' || (c + 1) ELSE 'java/lang/Object' END AS super_class, 'complete' AS class_state, 'path_name_agrees' AS name_binding FROM cls""",
    "artifact_members": """SELECT path, unit_seq, this_class, 'field' AS kind, 0 AS "index", 1 AS flags, 'count' AS name, 'I' AS descriptor, false AS has_code, CAST(-1 AS BIGINT) AS code_length FROM cls
  UNION ALL SELECT path, unit_seq, this_class, 'method', member_index, 1, method, descriptor, true, code_length FROM cls, body""",
    "artifact_instructions": f"""SELECT path, unit_seq, this_class, member_index, bci, opcode, width FROM cls, (VALUES {", ".join(map(str, CODE))}) AS code(member_index, bci, opcode, width)""",
    "artifact_xref": f"""SELECT path, unit_seq, this_class, consumer, target_kind, 'p7/C3' AS owner, site.name, descriptor, member_index, bci, via FROM cls JOIN (VALUES
  (2, 'type', 'class', {_NONE}, {_NONE}, 3, 0, 'instruction'), (2, 'invocation', 'method', '<init>', '()V', 3, 4, 'call'),
  (3, 'field', 'field', 'count', 'I', 3, 9, 'read'), (3, 'invocation', 'method', 'call', '()V', 4, 1, 'call')) AS site(place, consumer, target_kind, name, descriptor, member_index, bci, via) ON c = place
  WHERE k = 7""",
    "artifact_mentions": "SELECT path, unit_seq, this_class, 'p7/C3' AS owner, '<init>' AS name, '()V' AS descriptor, 3 AS member_index, 4 AS bci FROM cls WHERE k = 7 AND c = 2",
    "artifact_pool": "SELECT path, unit_seq, this_class, 'never/Used' AS owner, 'atAll' AS name, '()V' AS descriptor FROM cls",
    "artifact_literal": "SELECT path, unit_seq, this_class, 3 AS member_index, 15 AS bci, 'text 3' AS lit_utf FROM cls WHERE c = 3",
    "artifact_page": f"SELECT path, unit_seq, this_class, {_CALL} FROM cls ORDER BY path, unit_seq LIMIT 50",
    "artifact_resources": """SELECT path, unit_seq, CASE unit_seq WHEN 0 THEN 'manifest' ELSE 'service' END AS rule, key, value FROM units JOIN (SELECT k AS a, * FROM (SELECT k, unnest([
  {'place': 0, 'key': 'Main-Class', 'value': 'p' || k || '.C0'}, {'place': 0, 'key': 'Multi-Release', 'value': 'true'}, {'place': 1, 'key': 'p' || k || '.C0', 'value': 'p' || k || '.C1'}], recursive := true)
  FROM range(64) AS t(k))) AS r ON units.k = r.a AND unit_seq = place""",
    "artifact_multi_release": """SELECT path, depth, ordinal, CASE WHEN unit_seq = 22 THEN 'p' || k || '/C0.class' ELSE name END AS plain_name, variant_version, CAST(level AS INTEGER) AS release,
  CASE WHEN unit_seq = 22 THEN level >= 11 WHEN unit_seq = 2 THEN level < 11 ELSE true END AS selected FROM units, (VALUES (8), (11)) AS v(level)""",
    "artifact_coverage": f"SELECT path, depth, ordinal, name, c IS NOT NULL AS is_class_candidate, 'complete' AS state, {_NONE} AS code FROM units",
    "artifact_usage": """SELECT path, count(*) AS archive_entries, count(c) AS class_headers, CAST(count(c) * 4 AS BIGINT) AS method_bodies,
  CAST(count(c) * (SELECT sum(code_length) FROM body) AS BIGINT) AS code_bytes, max(depth) AS nested_depth FROM units GROUP BY path""",
    "artifact_supertypes": """SELECT path, unit_seq AS root_seq, unit_seq AS node_seq, 0 AS depth FROM cls
  UNION ALL SELECT path, unit_seq, c + 3, 1 FROM cls WHERE depth = 0 AND c % 5 = 0""",
    "artifact_declaration_refs": f"""SELECT path, unit_seq, this_class, {_CALL}, CASE WHEN c < 20 THEN 'resolved' ELSE 'missing' END AS state, CASE WHEN c < 20 THEN c + 2 ELSE -1 END AS declared_seq FROM cls""",
    "artifact_dispatch": "SELECT path, unit_seq, this_class, 'add' AS name, '(II)I' AS descriptor, 1 AS depth, true AS open_world FROM cls WHERE k = 0 AND c = 0",
    "artifact_reflection": """SELECT format('reflect-{:04d}.jar', k) AS path, 'r' || k || '/R' AS this_class, CAST(m AS INTEGER) AS member_index, CAST(2 - m AS INTEGER) AS bci, 'java/lang/Class' AS owner,
  'forName' AS name, 'class' AS names, CASE m WHEN 0 THEN 'r' || k || '.Target' END AS target, CASE m WHEN 0 THEN 'pattern_inferred_target' ELSE 'unknown' END AS state,
  CASE m WHEN 0 THEN 'constant_operand' ELSE 'operand_not_constant' END AS reason FROM range(64) AS a(k), range(2) AS b(m)""",
    "artifact_analysis": f"SELECT path, unit_seq, this_class, member_index, method AS name, descriptor, 'complete' AS state, {_NONE} AS code FROM cls, body",
    "artifact_recover": f"SELECT path, unit_seq, this_class, member_index, method AS name, descriptor, 'java' AS representation, 'recovered' AS quality, {_NONE} AS reason, text FROM text",
    "artifact_export": f"""SELECT path, unit_seq, 1 AS step, -1 AS member_index, 'class_prepared' AS event, name, {_NONE} AS text, {_NONE} AS completion FROM cls
  UNION ALL SELECT path, unit_seq, 2, member_index, 'method', method, text, NULL FROM text
  UNION ALL SELECT path, unit_seq, 3, -1, 'class_end', NULL, NULL, 'completed' FROM cls""",
    "artifact_plugins": """SELECT path, subject, detail, rule, 1 AS rule_version FROM (SELECT format('sample-{:04d}.jar', k) AS path, unnest([
  {'subject': 'service:p' || k || '.C0', 'detail': 'p' || k || '.C1', 'rule': 'services'}, {'subject': 'entry:Main-Class', 'detail': 'p' || k || '.C0', 'rule': 'entry-points'},
  {'subject': 'signature', 'detail': 'absent', 'rule': 'signatures'}], recursive := true) FROM range(64) AS t(k))""",
}.items()}
