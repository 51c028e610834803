"""Span search and span algebra against plain-Python models on random input."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from quillmask import DEFAULT_CATALOGUE
from quillmask.catalogue import RESIDUAL_PATTERNS
from quillmask.functions import algebra
from quillmask.functions.redaction import splice
from quillmask.functions.spans import find_matches
from quillmask.operators.detection import raw_matches
from quillmask.operators.names import model_labels, uncovered_runs

PIECES = [
    "SW1A 1AA", "gir0aa", "AB123456C", "AB 12 34 56 D", "GB123456A", "07700900123", "+44 7700 900123", "0191 403 2203",
    "BH-123", "REP 2023 1234", "tenancy 12345", "CUS1234", "ref-1234", "key safe: 1234", "pincode#12345", "98765432",
    "Name: Jo Bloggs", "Mr & Mrs O'Neil", "Miss Harlow", "ms. x", "a.b@c.example.com", "2024-03-12", "12/03/24", "3rd March 2024",
    "March 12, 2024", "dec. 3rd 2021", "2024-03-12T10:30", "2024-03-12 10:30:00.5Z", "June 2025", "''a.-b+c@x-y.example.org", "é.ü@exámple.es",
    "+1 (499) 555-6503", "555-123-4567", "word", "Ünï", "😀", "\n", "\r\n", "\t", ".", ",", "code", "x", "Café", "1", "the",
]


def texts(seed, n=250):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


PATTERNS = list(DEFAULT_CATALOGUE.detectors) + list(RESIDUAL_PATTERNS)


def test_matches_equal_python(spark):
    df = spark.createDataFrame([(t,) for t in texts(1)], "t string").coalesce(1)
    wanted = [F.expr(raw_matches("t", p)).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    for row in df.select("t", *wanted).collect():
        for i, p in enumerate(PATTERNS):
            flags = regex.IGNORECASE if p.ignore_case else 0
            body = p.pattern[4:] if p.pattern.startswith("(?i)") else p.pattern
            model = [(m.start(), m.end(), m.group()) for m in regex.finditer(body, row["t"], flags)]
            got = [(m["start"], m["end"], m["text"]) for m in row[f"p{i}"]]
            assert got == model, (getattr(p, "name", p.pattern), row["t"])


@pytest.mark.parametrize("p", PATTERNS, ids=lambda p: getattr(p, "name", None) or p.label)
def test_guards_never_hide_a_match(p):
    """Whatever matches a pattern also holds its cheap guard."""
    flags = regex.IGNORECASE if p.ignore_case else 0
    body = p.pattern[4:] if p.pattern.startswith("(?i)") else p.pattern
    seen = 0
    for t in texts(2, 3000):
        for m in regex.finditer(body, t, flags):
            seen += 1
            if p.needs is not None:
                assert regex.search(p.needs, m.group())
            if p.needs_text is not None:
                assert p.needs_text in t
    assert seen


def random_spans(rng, length):
    out = []
    for _ in range(rng.randint(0, 12)):
        start = rng.randint(0, length - 1)
        end = min(length, start + rng.randint(1, 12))
        out.append((rng.choice("ABC"), start, end, rng.choice([0.25, 0.5, 0.75, 1.0])))
    return out


def contained_model(spans):
    """Keep spans in order of score, start and length unless inside a kept one of their type."""
    kept = []
    for s in sorted(set(spans), key=lambda s: (-s[3], s[1], s[1] - s[2], s[0])):
        if not any(k[0] == s[0] and k[1] <= s[1] and k[2] >= s[2] for k in kept):
            kept.append(s)
    return kept


def merged_model(spans):
    out = [list(s) for s in spans]
    changed = True
    while changed:
        changed = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                a, b = out[i], out[j]
                if a[0] == b[0] and a[1] < b[2] and b[1] < a[2]:
                    out[i] = [a[0], min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    del out[j]
                    changed = True
                    break
            if changed:
                break
    return [tuple(s) for s in out]


def resolved_model(spans):
    def beaten(s):
        for o in spans:
            if o is s or not (o[1] <= s[1] and o[2] >= s[2]):
                continue
            if (o[1], o[2]) != (s[1], s[2]) or o[3] > s[3] or (o[3] == s[3] and o[0] < s[0]):
                return True
        return False

    return sorted((s for s in spans if not beaten(s)), key=lambda s: s[1])


def adjacent_model(text, spans):
    out = []
    for s in spans:
        if out and out[-1][0] == s[0] and s[1] > out[-1][2] and set(text[out[-1][2] : s[1]]) == {" "}:
            out[-1] = (s[0], out[-1][1], s[2], max(s[3], out[-1][3]))
        else:
            out.append(s)
    return out


def spliced_model(text, spans):
    end_of_rest = len(text)
    for kind, start, end, _ in reversed(spans):
        text = text[:start] + f"<{kind}>" + text[min(end, end_of_rest) :]
        end_of_rest = start
    return text


def test_algebra_equals_models(spark):
    rng = random.Random(7)
    cases = []
    for i in range(600):
        text = "".join(rng.choice("ab   é😀") for _ in range(30))
        cases.append((i, text, [(*s, text[s[1] : s[2]]) for s in random_spans(rng, 30)]))
    df = spark.createDataFrame(cases, f"id int, t string, cand {algebra.SPANS}").coalesce(1)
    tags = {k: f"<{k}>" for k in "ABC"}
    rows = (
        df.withColumn("kept", F.expr(algebra.drop_contained("cand")))
        .withColumn("ordered", F.expr(algebra.report_order("kept")))
        .withColumn("merged", F.expr(algebra.merge_overlaps("kept")))
        .withColumn("spans", F.expr(algebra.resolve_conflicts("merged")))
        .withColumn("joined", F.expr(algebra.merge_adjacent("t", "spans")))
        .withColumn("out", F.expr(splice("t", "joined", "tags", tags)))
        .collect()
    )
    for r in rows:
        def plain(a):
            return [(s["entity_type"], s["start"], s["end"], s["score"]) for s in a]

        kept = contained_model(plain(r["cand"]))
        assert sorted(plain(r["kept"])) == sorted(kept)
        assert plain(r["ordered"]) == kept
        assert sorted(plain(r["merged"])) == sorted(merged_model(kept))
        spans = resolved_model(merged_model(kept))
        assert plain(r["spans"]) == spans
        joined = adjacent_model(r["t"], spans)
        assert plain(r["joined"]) == joined
        assert r["out"] == spliced_model(r["t"], joined)


def test_name_runs_equal_model(spark):
    rng = random.Random(11)
    cases = []
    for i in range(400):
        points = sorted(rng.sample(range(60), 2 * rng.randint(0, 8)))
        names = list(zip(points[::2], points[1::2]))
        targets = [(s, s + rng.randint(1, 15)) for s in rng.choices(range(50), k=rng.randint(0, 5))]
        ents = [(s, e, rng.choice(["X", "Y"]), 0.5) for s, e in rng.sample(names, min(2, len(names)))]
        cases.append((i, names, targets, ents))
    pair = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(
        cases, f"id int, names {pair}, targets {pair}, ents array<struct<start:int,end:int,label:string,score:double>>"
    ).coalesce(1)
    rows = df.withColumn("runs", F.expr(uncovered_runs("names", "targets"))).withColumn(
        "labels", F.expr(model_labels("runs", "ents"))
    )
    for r in rows.collect():
        runs = []
        for n in r["names"]:
            if any(t["start"] <= n["start"] and n["end"] <= t["end"] for t in r["targets"]):
                continue
            if runs and n["start"] - runs[-1][1] <= 1:
                runs[-1] = (runs[-1][0], n["end"])
            else:
                runs.append((n["start"], n["end"]))
        assert [tuple(x) for x in r["runs"]] == runs
        labels = {}
        for e in sorted(r["ents"]):
            labels[(e["start"], e["end"])] = e["label"]
        assert r["labels"] == [labels.get(x) for x in runs]


def test_many_matches_in_one_text(spark):
    text = " ".join(str(1000 + i) for i in range(2500))
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.expr(find_matches("t", r"(?U)\b\d{4}\b")).alias("m")).first()["m"]
    assert [(m["start"], m["end"]) for m in got] == [(5 * i, 5 * i + 4) for i in range(2500)]
