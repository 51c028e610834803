"""Literal texts with the spans, redactions and findings they must give."""

from pyspark.sql import functions as F

from quillmask import DEFAULT_CATALOGUE, STYLE_ENTITY_TAGS
from quillmask.catalogue import ENTITY_OPTIONS

ALL = list(ENTITY_OPTIONS.values())
TAGS = dict(style=STYLE_ENTITY_TAGS, threshold=0.45)

COMMENTS = {
    "Miss Harlow sent the form back, REP-2023-01200, call 07009502800": "<PERSON> form back, <HOUSING_REF>, call <PHONE_NUMBER>",
    "Tenant rang, key safe: 2201 flat at SW1A 1AA": "Tenant rang, <ACCESS_CODE> flat at <POSTCODE>",
    "Name: Mr T B Quill\nNI no AB001202C": "Name: <PERSON>\nNI no <NINO>",
    "REF 11203 for mr & mrs tanner, 0191 403 2203": "<HOUSING_REF> for <PERSON>, <PHONE_NUMBER>",
    "Email user1204@example.com, customer-2204": "Email <EMAIL>, <HOUSING_REF>",
    "GB123456A is not valid, AB 12 34 56 D is, ask +44 7700 001205": "GB123456A is not valid, <NINO> is, ask +44 <PHONE_NUMBER>",
    "Tenancy 101207 in BH-407 and BH 123 456 seen": "<HOUSING_REF> in <HOUSING_REF> and <HOUSING_REF> 456 seen",
    "Café visit on 12/03/2024, code 2208 left by Sarah Jones": "Café visit on 12/03/2024, <ACCESS_CODE> left by Sarah Jones",
    "ab123456c <PERSON> Name: <PERSON>": "<NINO> <PERSON> Name: <PERSON>",
    "Good morning, account 10001210 ref 2210": "Good morning, account 10001210 <HOUSING_REF>",
    "no personal data here 211": "no personal data here 211",
    "GIR 0AA and gir0aa": "<POSTCODE> and <POSTCODE>",
    "postcode 1234": "post<ACCESS_CODE>",
    "": "",
}


def test_redaction_of_comments(redacted):
    assert redacted(list(COMMENTS), **TAGS) == list(COMMENTS.values())


def test_null_becomes_empty_text(redacted):
    assert redacted([None, "x"], **TAGS) == ["", "x"]


def test_generic_style_uses_one_tag(redacted):
    assert redacted(["Mr Brown, 07700 900123"], threshold=0.45) == ["<REDACTED>, <REDACTED>"]


def test_country_code_without_blank_is_no_uk_phone(spans):
    only_uk = DEFAULT_CATALOGUE.without_detector("phone_international")
    assert spans(["+447700900123"], catalogue=only_uk) == [set()]
    assert spans(["+44 7700 900123"], catalogue=only_uk) == [{("PHONE_NUMBER", 0.94, 4, 15, "7700 900123")}]


def test_context_lifts_scores(spans):
    texts = [
        "flat AB1 2DD",  # context word before
        "zebra AB1 2DD",  # none
        "pin is 1234",  # stopword between
        "nothing 1234",
        "pin one two three four five 1234",  # five words back is the limit
        "pin the two three four five 1234",  # a stopword does not count
        "morning AB123456C",  # "ni" lies inside the word
    ]
    got = spans(texts, threshold=0.4)
    assert got[0] == {("UK_POSTCODE", 1.0, 5, 12, "AB1 2DD")}
    assert got[1] == {("UK_POSTCODE", 0.92, 6, 13, "AB1 2DD")}
    assert got[2] == {("ACCESS_CODE", 0.6, 7, 11, "1234")}
    assert got[3] == set()
    assert got[4] == set()
    assert {s[:2] for s in got[5]} == {("ACCESS_CODE", 0.6)}
    assert {s[:2] for s in got[6]} == {("UK_NINO", 1.0)}


def test_context_far_behind_stopwords_is_found_in_whole_text(spans):
    """The window before the match holds stopwords only, so the prefix is read."""
    near = "pin " + "the " * 60 + "1234"
    far = "pin " + "the " * 3000 + "1234"
    blocked = "pin a1 b2 c3 d4 e5 " + "the " * 3000 + "1234"
    got = spans([near, far, blocked], threshold=0.4)
    assert [{s[:2] for s in g} for g in got] == [{("ACCESS_CODE", 0.6)}, {("ACCESS_CODE", 0.6)}, set()]


def test_score_on_the_threshold_counts(spans):
    assert {s[:2] for s in spans(["mr x"], threshold=0.75)[0]} == {("PERSON", 0.75)}
    assert spans(["mr x"], threshold=0.76)[0] == set()


def test_title_takes_following_words(spans):
    assert {s[4] for s in spans(["Miss Harlow sent the form back"])[0]} == {"Miss Harlow sent the"}


def test_name_label_takes_the_line_in_any_case(spans):
    got = spans(["USERNAME: joe b\nnext"])[0]
    assert got == {("PERSON", 0.9, 10, 15, "joe b")}


def test_offsets_are_code_points(spans):
    assert spans(["😀😀 é Mr Ünal Smith, AB1 2DD"])[0] == {("UK_POSTCODE", 0.92, 20, 27, "AB1 2DD")}
    assert spans(["😀 Mr Smith"])[0] == {("PERSON", 0.75, 2, 10, "Mr Smith")}


def test_text_with_nul_characters(spans, redacted):
    """NUL marks cut points internally; texts that hold it must come out whole."""
    text = "\0a\0 Mr Smith\0, 07700900123\0\0 x"
    assert {s[2:] for s in spans([text])[0]} == {(4, 12, "Mr Smith"), (15, 26, "07700900123")}
    assert redacted([text]) == ["\0a\0 <REDACTED>\0, <REDACTED>\0\0 x"]


def test_several_windows_of_context_and_dense_matches(spans):
    """Matches close together look back over each other to the word before them."""
    got = spans(["pin 1111, 2222, 3333, 4444, 5555, 6666, 7777"], threshold=0.4)[0]
    assert sorted(s[4] for s in got) == ["1111", "2222", "3333", "4444", "5555"]


def test_no_blank_and_unicode_digits(spans):
    assert spans(["٠٧٧٠٠٩٠٠١٢٣"], entity_types=ALL)[0] == set()


def findings(result):
    return sorted((r["label"], r["text"]) for r in result.residuals().collect())


def test_residuals_report_every_pattern(run):
    got = findings(run(["ring 07700900123 now"], entity_types=["EMAIL_ADDRESS"]))
    assert got == [
        ("LONG_DIGIT_SEQUENCE", "07700900123"),
        ("POSSIBLE_UK_MOBILE", "07700900123"),
        ("POSSIBLE_UK_PHONE", "07700900123"),
    ]


def test_residual_title_is_case_sensitive(run):
    texts = ["seen mr brown", "seen Mr Brown went"]
    result = run(texts, entity_types=["EMAIL_ADDRESS"])
    assert findings(result) == [("POSSIBLE_PERSON_TITLE", "Mr Brown")]


def test_tag_alone_is_no_leftover(run):
    result = run(["Name: <PERSON>", "Name:  <PERSON> ", "Name: <PERSON> Bob"], entity_types=["EMAIL_ADDRESS"])
    assert findings(result) == [("POSSIBLE_NAME_LABEL", "<PERSON> Bob")]


def test_allowed_name_stays_and_is_flagged(run, redacted):
    texts = ["Name: Tenant"]
    assert redacted(texts) == texts
    assert findings(run(texts)) == [("POSSIBLE_NAME_LABEL", "Tenant")]


def test_redaction_can_uncover_a_leftover(run):
    """Removing the code gives the digits before it a word boundary."""
    result = run(["07700900123code 1234"], entity_types=["ACCESS_CODE", "PHONE_NUMBER"])
    assert result.data.first()["text_Anonymised"] == "07700900123<REDACTED>"
    assert findings(result) == [
        ("LONG_DIGIT_SEQUENCE", "07700900123"),
        ("POSSIBLE_UK_MOBILE", "07700900123"),
        ("POSSIBLE_UK_PHONE", "07700900123"),
    ]


def test_high_threshold_leaves_are_flagged(run):
    """A detector that misses the threshold cannot spare the residual scan."""
    assert ("POSSIBLE_UK_PHONE", "0191 403 2203") in findings(run(["x 0191 403 2203"], threshold=0.9))


def test_missed_names(run):
    texts = ["We met Sarah Jones-Smith and I saw NHS staff. Then Bob left. see T B Quill"]
    got = findings(run(texts))
    assert got == [
        ("POSSIBLE_MISSED_NAME", "Bob"),
        ("POSSIBLE_MISSED_NAME", "Sarah Jones-Smith"),
        ("POSSIBLE_MISSED_NAME", "T B Quill"),
    ]
    assert findings(run(texts, entity_types=["EMAIL_ADDRESS"])) == []


def test_flags_are_nested_per_cell(run):
    rows = run(["x", "see Bob or 12345678"]).residual_flags().collect()
    assert [(r["id"], len(r["findings"])) for r in rows] == [(1, 2)]
    assert {f["scope"] for f in rows[0]["findings"]} == {"input", "output"}


def test_own_detector_and_tag(redacted):
    own = DEFAULT_CATALOGUE.with_detector("badge", "BADGE", r"\bBDG\d{3}\b", 0.5, ("badge",), tag="<BADGE>")
    got = redacted(["badge BDG123"], catalogue=own, entity_types=["BADGE"], style=STYLE_ENTITY_TAGS)
    assert got == ["badge <BADGE>"]


def test_own_tag_with_digits_keeps_residual_scan_exact(run):
    own = DEFAULT_CATALOGUE.with_detector("badge", "BADGE", r"\bBDGX\b", 0.5, tag="12345678")
    result = run(["a BDGX b"], catalogue=own, entity_types=["BADGE"], style=STYLE_ENTITY_TAGS)
    assert findings(result) == [("LONG_DIGIT_SEQUENCE", "12345678")]


def test_large_cell_is_processed_whole(run):
    """Thousands of spans in one cell: every one is found and replaced."""
    n = 3000
    text = " ".join(f"Mr Smith; ref {10000 + i}; 07700 {900000 + i}." for i in range(n))
    result = run([text])
    counts = result.detections().groupBy("entity_type").count().collect()
    assert {r["entity_type"]: r["count"] for r in counts} == {"PERSON": n, "HOUSING_REF": n, "PHONE_NUMBER": n}
    out = result.data.select(F.col("text_Anonymised")).first()[0]
    assert out == " ".join(["<REDACTED>; <REDACTED>; <REDACTED>."] * n)
