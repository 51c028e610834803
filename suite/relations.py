"""Relations that queries derive from the given tables, in SQL both engines run."""

from __future__ import annotations



def word_at(column: str, word: str, length: int | None = None) -> tuple[str, str]:
    """Start and end of a word's first place."""
    size = len(word) if length is None else length
    return f"CAST(instr({column}, '{word}') - 1 AS int)", f"CAST(instr({column}, '{word}') + {size - 1} AS int)"


# What a model might have found in the comments: names whole or in two parts,
# a role word, a place and labels outside the entity types.
ENTITY_ROWS = (
    ("'notes'", *word_at("notes", "Sarah"), "'PERSON'", "notes LIKE '%Sarah Jones%' AND category <> '1-URGENT'"),
    ("'notes'", *word_at("notes", "Jones"), "'PERSON'", "notes LIKE '%Sarah Jones%' AND category <> '1-URGENT'"),
    ("'notes'", *word_at("notes", "Sarah", 11), "'PRODUCT'", "notes LIKE '%Sarah Jones%' AND category = '1-URGENT'"),
    ("'notes'", "0", "6", "'PERSON'", "notes LIKE 'Tenant %'"),
    ("'notes'", *word_at("notes", "SW1A"), "'GPE'", "notes LIKE '%SW1A%'"),
    ("'notes'", "0", "4", "'ORG'", "notes LIKE 'Caf%'"),
    ("'description'", "9", "17", "'PER'", "description LIKE 'Spoke to Mr Brown%'"),
)

# Tagged tokens for the same comments.
TOKEN_ROWS = (
    ("'notes'", *word_at("notes", "Sarah"), "'Sarah'", "'PROPN'", "notes LIKE '%Sarah Jones%'"),
    ("'notes'", *word_at("notes", "Jones"), "'Jones'", "'PROPN'", "notes LIKE '%Sarah Jones%'"),
    ("'notes'", "0", "6", "'Tenant'", "'PROPN'", "notes LIKE 'Tenant %'"),
    ("'notes'", "0", "4", "'Miss'", "'PROPN'", "notes LIKE 'Miss %'"),
    ("'notes'", "0", "4", "'Good'", "'ADJ'", "notes LIKE 'Good %'"),
    ("'notes'", "0", "5", "'Email'", "'PROPN'", "notes LIKE 'Email %'"),
)

ENTITY_FIELDS = ("source_column", "start", "end", "label")
TOKEN_FIELDS = ("source_column", "start", "end", "text", "pos")


def as_union(rows, fields) -> str:
    """One branch for each kind of row."""
    return " UNION ALL ".join(
        "SELECT row_id, " + ", ".join(f'{v} AS "{f}"' for f, v in zip(fields, values, strict=True)) + f" FROM comments WHERE {condition}"
        for *values, condition in rows
    )


def in_one_pass(rows, fields) -> str:
    """The same rows from one scan of the comments."""
    structs = ", ".join(
        f"if({condition}, named_struct(" + ", ".join(f"'{f}', {v}" for f, v in zip(fields, values, strict=True)) + "), null)"
        for *values, condition in rows
    )
    return f"SELECT row_id, inline(filter(array({structs}), r -> r is not null)) FROM {{comments}}"


ENTITIES_SQL, ENTITIES_SPARK = as_union(ENTITY_ROWS, ENTITY_FIELDS), in_one_pass(ENTITY_ROWS, ENTITY_FIELDS)
TOKEN_POS_SQL, TOKEN_POS_SPARK = as_union(TOKEN_ROWS, TOKEN_FIELDS), in_one_pass(TOKEN_ROWS, TOKEN_FIELDS)

CUSTOMER_NOTES_SQL = """
SELECT c_custkey, 'Call with customer ' || cast(c_custkey AS string) || ' from ' || n_name || ' (' || lower(r_name) || '): ' || n_name || ', branch ' || c_mktsegment AS note
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

DICTIONARY_SQL = """
SELECT n_name AS term, 'GPE' AS label FROM nation UNION ALL SELECT r_name, 'LOC' FROM region
UNION ALL SELECT 'From ' || n_name || ' / ' || r_name || ' / ' || n_name, 'ORIGIN' FROM nation JOIN region ON n_regionkey = r_regionkey
"""

# A CSV-like export with remarks that spell out missing values, quotes and line breaks.
NA_SQL = """
SELECT o_orderkey AS row_id, o_custkey % 50 AS n_items,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'N/A' WHEN '2-HIGH' THEN 'None'
    WHEN '3-MEDIUM' THEN 'said "call back", then' || chr(10) || 'left ' || o_orderstatus
    ELSE 'order ' || cast(o_orderkey AS string) || ', NA later' END AS remark
FROM orders
"""

MEASURES_SQL = """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN {nan} ELSE o_totalprice END AS ratio FROM orders
"""

# A message per event, as one expression.
EVENT_MESSAGE_SQL = """
CASE event_type WHEN 'error' THEN 'ring 07' || lpad(cast(event_id * 7919 % 1000000000 AS string), 9, '0')
  WHEN 'click' THEN 'user' || cast(user_id AS string) || '@example.com clicked'
  WHEN 'view' THEN 'Mr Brown at SW1A ' || cast(user_id % 10 AS string) || 'AA' ELSE 'nothing here' END"""

# Allowed texts: every second mobile number of the comments that hold one, and others.
ALLOWED_SQL = """CASE WHEN id % 24 = 0 THEN '07' || lpad(cast(id * 7919 % 1000000000 AS string), 9, '0')
  WHEN id = 1 THEN 'Mr Brown' ELSE 'allowed ' || cast(id AS string) END AS term"""

# The digits after the label are the beginning of a phone number as well.
OVERLAP_SQL = """
SELECT c_custkey, 'Job 07' || lpad(cast(c_custkey % 1000 AS string), 3, '0') || ' ' || lpad(cast(c_custkey * 7919 % 1000000 AS string), 6, '0') ||
  CASE WHEN c_custkey % 2 = 0 THEN ' and ref 0191 403 2203' ELSE ', call back' END AS note
FROM customer
"""

# A dictionary of 200,000 terms with as many first words, and one word that every note holds.
LARGE_DICTIONARY_SQL = """
SELECT cast(id AS string) || CASE WHEN id % 3 = 0 THEN ' from' ELSE ' from nowhere' END AS term, 'ACCOUNT' AS label FROM ids
UNION ALL SELECT 'CUSTOMER', 'ROLE' FROM ids WHERE id = 0 UNION ALL SELECT 'call with', 'TALK' FROM ids WHERE id = 0
"""

# Notes whose context stands in other forms of the telling words, or only looks like one.
FORMS_NOTES_SQL = """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'They Rang back, (191) ' WHEN 1 THEN 'Orange one (191) ' WHEN 2 THEN 'Had rung twice from (191) '
  WHEN 3 THEN 'Two properties under REF 1' || cast(1000 + c_custkey % 9000 AS string) || ' or tenancies REF 2' || cast(1000 + c_custkey % 9000 AS string) || ' (191) '
  ELSE 'Neighbour has keys 4' || cast(100 + c_custkey % 900 AS string) || ', (191) ' END
  || cast(100 + c_custkey % 900 AS string) || '-' || cast(1000 + c_custkey % 9000 AS string) AS note
FROM customer
"""

# Word forms and their lemmas; the last two are lemmas of no context word.
FORMS = {"rang": "ring", "rung": "ring", "properties": "property", "tenancies": "tenancy", "Orange": "orange", "went": "go"}

# Lines of a CSV file, some of them faulty, keyed by order; -1 is the header, ~ a quote.
FAULTY_LINES_SQL = """
SELECT k, replace(line, '~', chr(34)) AS line FROM (
SELECT -1 AS k, 'row_id,amount,remark' AS line FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
UNION ALL SELECT o_orderkey, cast(o_orderkey AS string) || CASE o_orderkey % 8
  WHEN 1 THEN ',12,~a, b~,extra,' WHEN 2 THEN ',n.d.,~x, y~' WHEN 3 THEN ',7' WHEN 4 THEN ',8,~two' || chr(10) || 'lines, ~~quoted~~~'
  WHEN 5 THEN ',9,N/A' WHEN 6 THEN ',10,,,z' ELSE ',' || cast(o_custkey AS string) || ',plain' END
FROM orders)
"""
