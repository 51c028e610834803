"""SQL functions, faulty CSV rows, word forms in context and large dictionaries."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmask import DEFAULT_CATALOGUE, STYLE_ENTITY_TAGS, anonymise
from quillmask.operators.annotations import _filter_bits, _probes, dictionary_entities
from quillmask.operators import lemmas
from quillmask.operators.sql_functions import register_functions
from quillmask.sources.quarantine import TOO_MANY, UNCLOSED, read_csv_quarantined
from quillmask.sources.readers import read_csv

TEXTS = ["", None, "ring 07700 900123 or a@b.com", "Name: Mr T Quill\nAB123456C", "seen by Sarah Jones, 12345678", "x" * 5000 + " call 4455"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_functions_of_sql_equal_the_run(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").coalesce(1)
    names = register_functions(spark, "own_", style=STYLE_ENTITY_TAGS, threshold=0.45)
    assert names == ["own_detect", "own_redact", "own_leftovers"]
    got = df.selectExpr("id", "own_redact(text) AS r", "own_detect(text) AS d", "own_leftovers(text) AS l")
    result = anonymise(df, style=STYLE_ENTITY_TAGS, threshold=0.45, key="id")
    plan = plan_of(got)
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan
    rows = {r.id: r for r in got.collect()}
    assert {i: r.r for i, r in rows.items()} == {r.id: r.text_Anonymised for r in result.data.collect()}
    want = {}
    for r in result.detections().collect():
        want.setdefault(r.id, []).append((r.entity_type, r.start, r.end, r.original_text))
    assert {i: [(s.entity_type, s.start, s.end, s.text) for s in r.d] for i, r in rows.items() if r.d} == want
    flags = sorted((r.id, r.label, r.text) for r in result.residuals().collect())
    assert sorted((i, f.label, f.text) for i, r in rows.items() for f in r.l) == flags


def test_functions_work_in_filters_and_refuse_bad_settings(spark):
    register_functions(spark, "mail_", entity_types=["EMAIL_ADDRESS"])
    df = spark.createDataFrame([("a@b.com",), ("none",)], "t string")
    assert [r.t for r in df.filter("size(mail_detect(t)) > 0").collect()] == ["a@b.com"]
    with pytest.raises(ValueError):
        register_functions(spark, entity_types=["NO_SUCH_TYPE"])
    with pytest.raises(ValueError):
        register_functions(spark, "a b")


def test_calls_on_one_value_share_their_search(spark):
    """All searches stand in one projection, as equal columns, which Spark computes once."""
    register_functions(spark, "shared_", style=STYLE_ENTITY_TAGS, threshold=0.45)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = df.selectExpr("id", "shared_redact(text) AS r", "size(shared_detect(text)) AS n", "shared_leftovers(text) AS l")
    columns = got._jdf.queryExecution().optimizedPlan().children().apply(0).expressions()
    columns = [columns.apply(i) for i in range(columns.size())]
    searches = [c.children().apply(0).canonicalized() for c in columns if "in_found" in c.toString()[-20:]]
    assert len(searches) == 3 and all(s.equals(searches[0]) for s in searches)
    assert sum("GIR" in c.toString() for c in columns) == 3
    assert spark.conf.get("spark.sql.subexpressionElimination.enabled") == "true"


def csv_of(folder, text, name="a.csv"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)
    return str(folder)


def test_faulty_rows_and_good_rows_are_all_rows(spark, tmp_path):
    path = csv_of(tmp_path / "c", 'k,n,t\n1,5,a\n2,6,b,c\n3,x,"q, r"\n4\n5,7,"say ""hi"", all"\n6,,,,,z\n7,8,NA\n')
    csv_of(tmp_path / "c", "k,n,t\n8,9,5\" pipe\n9,10,ok,\n", "b.csv")
    good, bad = read_csv_quarantined(spark, path, "k int, n bigint, t string")
    assert sorted(map(tuple, good.collect())) == [
        (1, 5, "a", 0), (4, None, None, 3), (5, 7, 'say "hi", all', 4), (7, 8, None, 6), (8, 9, '5" pipe', 7)
    ]
    assert sorted((r.row_index, r.reason, r.record, os.path.basename(r.file)) for r in bad.collect()) == [
        (1, TOO_MANY, "2,6,b,c", "a.csv"), (2, "no n", '3,x,"q, r"', "a.csv"), (5, TOO_MANY, "6,,,,,z", "a.csv"),
        (8, TOO_MANY, "9,10,ok,", "b.csv"),
    ]


def test_an_open_quote_costs_one_line_without_line_breaks(spark, tmp_path):
    path = csv_of(tmp_path / "c", 'k,t\n1,"open\n2,b\n"3,c\n')
    good, bad = read_csv_quarantined(spark, path, multi_line=False)
    found = {(r.k, r.t) for r in good.collect()}
    assert (2, "b") in found or ("2", "b") in found
    assert UNCLOSED in {r.reason for r in bad.collect()}
    assert good.count() + bad.count() == 3


def test_clean_files_read_as_ever_and_empty_ones_are_empty(spark, tmp_path):
    path = csv_of(tmp_path / "c", 'k,t\n1,"a\nb"\n2,None\n')
    good, bad = read_csv_quarantined(spark, path)
    assert good.drop("row_index").schema == read_csv(spark, path).schema
    assert sorted(map(tuple, good.drop("row_index").collect())) == sorted(map(tuple, read_csv(spark, path).collect()))
    assert bad.count() == 0
    good, bad = read_csv_quarantined(spark, csv_of(tmp_path / "e", "k,t\n"))
    assert good.count() == bad.count() == 0


def test_word_forms_lift_only_as_whole_words(spans):
    own = DEFAULT_CATALOGUE.with_lemmas([("rang", "ring"), ("went", "go"), ("ring", "ring")])
    assert own.lemmas == (("ring", ("rang",)),)
    texts = ["Rang (191) 403-2203", "orange (191) 403-2203"]
    lifted, not_lifted = spans(texts, catalogue=own, threshold=0.1, entity_types=["PHONE_NUMBER"])
    scores = [max(s[1] for s in found if s[4].startswith("(191)")) for found in (lifted, not_lifted)]
    assert scores == [0.75, 0.4]
    plain = spans(texts[:1], threshold=0.1, entity_types=["PHONE_NUMBER"])[0]
    assert max(s[1] for s in plain if s[4].startswith("(191)")) == 0.4


def test_form_tables_are_cut_to_context_words_and_counted(spark, monkeypatch):
    forms = spark.range(50_000).selectExpr("concat('form', id) AS form", "concat('lemma', id) AS lemma")
    forms = forms.union(spark.createDataFrame([("RANG", "Ring"), ("rang", "ring"), (None, "ring")], "form string, lemma string"))
    assert lemmas.with_lemma_table(DEFAULT_CATALOGUE, forms).lemmas == (("ring", ("rang",)),)
    monkeypatch.setattr(lemmas, "MOST_FORMS", 0)
    with pytest.raises(ValueError):
        lemmas.with_lemma_table(DEFAULT_CATALOGUE, forms)


def test_filter_of_first_words_has_no_false_negatives(spark):
    firsts = spark.range(20_000).selectExpr("concat('w', id) AS first")
    row, bits = _filter_bits(firsts)
    assert row.count() == 1 and row.first()["bits"].__len__() == bits // 64
    words = spark.range(40_000).selectExpr("id", "concat('w', id) AS first")
    tested = spark.sql("SELECT id, first, (SELECT bits FROM {row}) AS bits FROM {words}", row=row, words=words)
    test = f"forall({_probes('first', bits)}, p -> (shiftright(get(bits, cast(p div 64 as int)), cast(p % 64 as int)) & 1L) = 1L)"
    passed = {r.id for r in tested.filter(test).select("id").collect()}
    assert set(range(20_000)) <= passed and len(passed) < 21_000


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_large_dictionaries_equal_brute_force(spark, limit):
    rng = random.Random(3)
    rows = [(i, " ".join(["hot"] * 30 + rng.choices("ab cd ef gh ij kl".split(), k=10))) for i in range(200)]
    rows += [(200, ""), (201, None)]
    terms = [("Hot", "H"), ("ab cd", "P"), ("AB  CD", "Q"), ("kl", "K"), ("hot ab", "X"), ("never seen", "N"), ("--", "E")]
    df = spark.createDataFrame(rows, "id int, t string")
    found = dictionary_entities(df, "t", "id", spark.createDataFrame(terms, "term string, label string"), broadcast_bytes=limit)
    want = set()
    for i, text in rows:
        words, at = [], 0
        for w in (text or "").split():
            words.append((w, at, at + len(w)))
            at += len(w) + 1
        for n in (1, 2):
            for j in range(len(words) - n + 1):
                gram = " ".join(w for w, _, _ in words[j : j + n])
                want |= {(i, words[j][1], words[j + n - 1][2], label) for term, label in terms if gram == " ".join(term.lower().split())}
    got = [(r.id, r.start, r.end, r.label) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_term_is_joined_apart(spark):
    df = spark.range(4000).selectExpr("id", "concat('hot w', id) AS t")
    terms = spark.range(4000).selectExpr("concat('w', id) AS term", "'W' AS label").union(spark.createDataFrame([("hot", "H")], "term string, label string"))
    found = dictionary_entities(df, "t", "id", terms, broadcast_bytes=0)
    assert "BroadcastHashJoin" in plan_of(found) and "SortMergeJoin" in plan_of(found)
    # Small partitions would be joined into one, whatever their keys.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per_task) == 8000
    median = sorted(per_task)[len(per_task) // 2]
    assert max(per_task) <= 4 * median


def test_quarantine_over_several_files(spark, sf, monkeypatch):
    """Lines beyond FILE_ROWS go to further files, so no task sorts or reads all; rows and places are those of one file."""
    from suite import queries

    whole = sorted(map(str, queries.csv_quarantine(spark, sf).collect()))
    paths = []
    real = queries.read_csv_quarantined
    monkeypatch.setattr(queries, "read_csv_quarantined", lambda spark, path, schema: (paths.append(path), real(spark, path, schema))[1])
    monkeypatch.setattr(queries, "FILE_ROWS", 100)
    assert sorted(map(str, queries.csv_quarantine(spark, sf).collect())) == whole
    assert len(spark.read.text(paths[0]).select("_metadata.file_path").distinct().collect()) == 15
