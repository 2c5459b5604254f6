"""SQL for the queries that SQL can express on whole tables; the others are tested against brute force in tests/llm."""

_KEY = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"


def _p1() -> str:
    parts = []
    for field, name, key, label in (("specialty", "records", "record_id", "specialty"), ("question_type", "questions", "question_id", "question_type")):
        parts.append(f"""
        SELECT t.field_name, t.category FROM (SELECT * FROM sample_targets WHERE field_name = '{field}') t
        LEFT JOIN (SELECT k, count(*) n FROM (
            SELECT i.id, min(i.k) k FROM (SELECT DISTINCT {key} AS id, {_KEY.format(label)} AS k FROM {name}) i
            JOIN (SELECT DISTINCT {_KEY.format('category')} AS k FROM sample_targets WHERE field_name = '{field}') l USING (k)
            WHERE i.id IS NOT NULL GROUP BY i.id) GROUP BY k) c ON c.k = {_KEY.format('t.category')}
        WHERE coalesce(c.n, 0) < t.target_share * t.sample_fraction * (
            SELECT count(DISTINCT i.{key}) FROM {name} i JOIN sample_targets s ON s.field_name = '{field}'
            AND {_KEY.format('i.' + label)} = {_KEY.format('s.category')})""")
    return " UNION ALL ".join(parts)


def _p2() -> str:
    parts = []
    for field, name, key, text in (
        ("records.content", "records", "record_id", "content"), ("articles.abstract", "articles", "pubmed_id", "abstract"),
        ("trials.detailed_description", "trials", "nct_id", "detailed_description")
    ):
        parts.append(f"""
        SELECT '{field}' AS field_name, item_key, CASE WHEN longest > max_size THEN 'forced' ELSE 'natural' END AS cut FROM (
            SELECT {key} AS item_key, max(list_max(list_transform(regexp_split_to_array({text}, '[ \\t\\r\\n]+'), lambda x: length(x)))) AS longest, any_value(l.max_size) AS max_size
            FROM {name}, (SELECT max_size FROM size_limits WHERE field_name = '{field}') l
            WHERE {key} IS NOT NULL AND length({text}) > l.max_size GROUP BY {key})""")
    return " UNION ALL ".join(parts)


def _p1_rules() -> str:
    """Counts and the size of the sample; a rule that holds is broken 0 times."""
    parts = []
    for field, name, key, label in (("specialty", "records", "record_id", "specialty"), ("question_type", "questions", "question_id", "question_type")):
        parts.append(f"""
        SELECT '{field}' AS field_name, usable, CAST(floor(f * usable + 0.5) AS BIGINT) AS drawn, 0 AS below_floor, 0 AS above_available, 0 AS off_quota, 0 AS passed_over
        FROM (SELECT count(DISTINCT i.{key}) AS usable, any_value(s.sample_fraction) AS f FROM {name} i JOIN sample_targets s ON s.field_name = '{field}'
            AND {_KEY.format('i.' + label)} = {_KEY.format('s.category')})""")
    return " UNION ALL ".join(parts)


def _p2_rebuilt() -> str:
    parts = []
    for field, name, key, text in (
        ("records.content", "records", "record_id", "content"), ("articles.abstract", "articles", "pubmed_id", "abstract"),
        ("trials.detailed_description", "trials", "nct_id", "detailed_description")
    ):
        parts.append(f"""
        SELECT '{field}' AS field_name, {key} AS item_key, md5(max_by({text}, {{'n': length({text}), 't': {text}}})) AS text_hash, true AS fits
        FROM {name} WHERE {key} IS NOT NULL AND length({text}) > (SELECT max_size FROM size_limits WHERE field_name = '{field}') GROUP BY {key}""")
    return " UNION ALL ".join(parts)


_P3_RESTORED = " UNION ALL ".join(
    f"SELECT record_id, '{c}' AS field_name, md5({c}) AS text_hash FROM records WHERE {c} IS NOT NULL" for c in ("content", "description")
)

def _p4(table: str, key: str, text: str, words: int, threshold: float, a: str, b: str) -> str:
    """Every pair by brute force over the sets of runs of words."""
    run = ", ".join(f"ws[i + {k}]" for k in range(words))
    return f"""
    WITH w AS (SELECT DISTINCT {key} AS id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS ws FROM {table} WHERE {key} IS NOT NULL AND {text} IS NOT NULL),
    s AS (SELECT DISTINCT id, unnest([concat_ws(' ', {run}) FOR i IN range(1, len(ws) - {words - 2})]) AS sh FROM w WHERE len(ws) >= {words}),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id)
    SELECT {a}, {b} FROM (SELECT a.id AS {a}, b.id AS {b}, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY a.id, b.id) p
    JOIN n x ON x.id = {a} JOIN n y ON y.id = {b} WHERE k >= {threshold} * (x.n + y.n - k)"""


_P6_RULES = """SELECT count(*) AS items, count(*) FILTER ({0}) AS empty_items, 0 AS late_begins, 0 AS long_segments, 0 AS overfull, true AS few_containers, 0 AS torn_items FROM {1}"""

#: Sizes in characters: the margins of the cases are wide enough for any measure of length.
_P7_SIZES = f"""(SELECT t.source_name, coalesce(sum(length(d.text)), 0) AS have, any_value(t.max_repeats) AS m, any_value(t.target_weight * t.mix_fraction) * (SELECT sum(length(text)) FROM documents) AS aim
    FROM mix_targets t LEFT JOIN documents d ON {_KEY.format('d.source')} = {_KEY.format('t.source_name')} GROUP BY t.source_name)"""

ORACLE: dict[str, str] = {
    "p1_found": _p1(),
    "p1_rules": _p1_rules(),
    "p2_found": _p2(),
    "p2_rebuilt": _p2_rebuilt(),
    "p3_restored": _P3_RESTORED,
    "p4_found": _p4("records", "record_id", "content", 3, 0.5, "record_id_a", "record_id_b"),
    "p4_article_pairs": _p4("articles", "pubmed_id", "abstract", 5, 0.8, "id_a", "id_b"),
    "p6_rules": _P6_RULES.format("text IS NULL OR text = ''", "documents"),
    "p6_instruction_rules": _P6_RULES.format("coalesce(query_text, '') = '' AND coalesce(answer, '') = ''", "responses"),
    "p7_found": f"SELECT source_name FROM {_P7_SIZES} WHERE have * m < aim",
    "p7_rules": f"SELECT source_name, have * m < aim AS falls_short, false AS too_often, true AS on_target FROM {_P7_SIZES}",
}
