"""Cells of few spans take short ways, patterns have word guards: both change no result."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from quillmask import DEFAULT_CATALOGUE
from quillmask.catalogue import RESIDUAL_PATTERNS
from quillmask.functions import algebra, spans
from quillmask.functions.spans import folded
from quillmask.operators import names
from quillmask.operators.detection import pattern_hits
from tests.test_spans_property import random_spans, texts

PATTERNS = [p for p in [*DEFAULT_CATALOGUE.detectors, *RESIDUAL_PATTERNS] if p.needs_words]


def test_matches_hold_a_word_of_their_guard():
    assert {p.name for p in PATTERNS if hasattr(p, "name")} >= {"ref_bh", "ref_job", "code_labelled", "title_name", "date_month_year"}
    for p in PATTERNS:
        body = p.pattern.removeprefix("(?i)")
        found = [m.group() for t in texts(4, 2000) for m in regex.finditer(body, "Name: " + t, regex.IGNORECASE if p.ignore_case else 0)]
        # a look-behind is a part of the text, not of the match
        assert found and all(any(w in ("name: " + m).lower() for w in p.needs_words) for m in found)


def test_letters_that_fold_to_ascii_pass_the_word_guards(spark):
    odd = {"mıſſ": "miss", "KK": "kk", "İS É": "is é", "MIX": "mix", "": ""}
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert {r.t: r.low for r in df.select("t", F.expr(folded("t")).alias("low")).collect()} == odd
    on = [d for d in DEFAULT_CATALOGUE.detectors if d.name in ("title_name", "ref_customer")]
    hits = spark.createDataFrame([("mıſſ Harlow, cuſ 12345",)], "t string").select(F.expr(f"size({pattern_hits('t', on)})").alias("n"))
    assert hits.collect()[0].n == 2


@pytest.mark.parametrize("step", ["contained", "conflicts", "adjacent", "runs"])
def test_short_ways_equal_the_walks(spark, monkeypatch, step):
    rng = random.Random(5)
    rows = [("ab   cd ef  gh" * 3, random_spans(rng, 40)[: rng.randint(0, 8)]) for _ in range(300)]
    rows += [(t, [*s, *s[:1]]) for t, s in rows[:50]]
    kind = "t string, s array<struct<entity_type:string,start:int,end:int,score:double>>"
    df = spark.createDataFrame(rows, kind).withColumn("s", F.expr("transform(s, k -> named_struct('entity_type', k.entity_type, 'start', k.start, 'end', k.end, 'score', k.score, 'text', substring(t, k.start + 1, k.end - k.start)))")).coalesce(2)

    def results() -> list:
        merged = df.withColumn("m", F.expr(algebra.merge_overlaps("s"))).withColumn("c", F.expr(algebra.resolve_conflicts("m")))
        wanted = {
            "contained": f"sort_array({algebra.drop_contained('s')})",
            "conflicts": "c",
            "adjacent": algebra.merge_adjacent("t", "c"),
            "runs": names.uncovered_runs("slice(s, 1, 3)", "slice(s, 4, 8)"),
        }
        return [r.x for r in merged.select("t", "s", F.expr(wanted[step]).alias("x")).collect()]

    short = results()
    for module in (spans, algebra, names):
        monkeypatch.setattr(module, "FEW", -1 if module is not names else 0)
    assert short == results()
