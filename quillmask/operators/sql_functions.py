"""The run on a single value as functions of SQL, for sessions that are driven by SQL text.

The functions are temporary SQL functions whose bodies are the expressions the
DataFrame run is planned from, so both give the same results, and no plan with
them runs Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillmask.catalogue import (
    DEFAULT_CATALOGUE,
    DEFAULT_ENTITY_TYPES,
    LIBRARY_THRESHOLD,
    STYLE_GENERIC,
    Catalogue,
)
from quillmask.functions import algebra
from quillmask.functions.redaction import splice
from quillmask.functions.sql import empty, let
from quillmask.operators.anonymise import detections_of, redaction_spans
from quillmask.operators.columns import check_options
from quillmask.operators.detection import candidates
from quillmask.operators.names import missed_names
from quillmask.operators.residual import FINDINGS, residual_findings

# Name, parameters and body of a function; a body names another function by its kind in braces.
Function = tuple[str, str, str]


def _bound(body: str, *names_: str) -> str:
    """A body over qm_<name> with each parameter read once, as arguments are put in the place of parameters."""
    for n in reversed(names_):
        body = let(f"qm_{n}", f"in_{n}", body)
    return body


def function_bodies(
    entity_types=DEFAULT_ENTITY_TYPES,
    style: str = STYLE_GENERIC,
    threshold: float = LIBRARY_THRESHOLD,
    catalogue: Catalogue = DEFAULT_CATALOGUE,
) -> list[Function]:
    """The functions in the order of their creation.

    Each step is one, as the analyser resolves them apart. Those for users are steps over the candidates
    of their value. The first step reads the candidates several times, so the optimiser leaves the search in
    a projection below, where it is the same column for all calls on one value and done once.
    """
    entity_types = tuple(dict.fromkeys(entity_types))
    check_options(entity_types, {d.entity_type for d in catalogue.detectors} | set(catalogue.tag_map), threshold)
    on = catalogue.active(entity_types, threshold)
    found = candidates("qm_text", on, catalogue, entity_types, threshold)
    ordered = _bound(algebra.report_order(detections_of("qm_found", catalogue)), "found")
    apart = let("qm_merged", algebra.merge_overlaps("qm_spans"), redaction_spans("qm_merged"))
    joined = let("qm_apart", apart, algebra.merge_adjacent("qm_text", "qm_apart"))
    left = residual_findings("qm_text", catalogue, "qm_changed", entity_types, threshold, style)
    missed = missed_names("qm_text", "qm_spans", catalogue.allow_list) if "PERSON" in entity_types else empty(FINDINGS)
    read = f"in_text STRING, in_found {algebra.SPANS}"
    return [
        ("found", "in_value STRING", let("qm_text", "coalesce(in_value, '')", found)),
        ("spans", f"in_found {algebra.SPANS}", f"if(size(in_found) = 0, in_found, {ordered})"),
        ("joined", f"in_text STRING, in_spans {algebra.SPANS}", _bound(joined, "text", "spans")),
        ("spliced", f"in_text STRING, in_spans {algebra.HULLS}", _bound(splice("qm_text", "qm_spans", style, catalogue.tag_map), "text", "spans")),
        ("redacted", read, "{spliced}(in_text, {joined}(in_text, {spans}(in_found)))"),
        ("residual", "in_text STRING, in_changed BOOLEAN", _bound(left, "text", "changed")),
        ("missed", f"in_text STRING, in_spans {algebra.SPANS}", _bound(missed, "text", "spans")),
        ("left", read, "concat({residual}({redacted}(in_text, in_found), size(in_found) > 0), {missed}(in_text, {spans}(in_found)))"),
        ("detect", "in_value STRING", "{spans}({found}(in_value))"),
        ("redact", "in_value STRING", "{redacted}(coalesce(in_value, ''), {found}(in_value))"),
        ("leftovers", "in_value STRING", "{left}(coalesce(in_value, ''), {found}(in_value))"),
    ]


def register_functions(spark: SparkSession, prefix: str = "quillmask_", **settings) -> list[str]:
    """Create the functions of SQL in the session; returns the names of those made for users.

    These are ``<prefix>detect`` (array of spans), ``<prefix>redact`` (text) and
    ``<prefix>leftovers`` (array of findings), each of one string; other names
    with the prefix are steps of these. ``settings`` are those of
    :func:`function_bodies`. A null value counts as the empty text, as in the
    data output. Calls on one value in one SELECT share their search, as do the steps of a
    call; all else is done anew by each, so for all outputs of a table at once use
    ``anonymise``. Registering again replaces the functions; another prefix keeps
    several settings side by side.
    """
    if not prefix.isidentifier():
        raise ValueError(f"no prefix of a function name: {prefix!r}")
    functions = function_bodies(**settings)
    called = {kind: prefix + kind for kind, _, _ in functions}
    for kind, parameters, body in functions:
        for other, full in called.items():
            body = body.replace("{" + other + "}", full)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{kind}({parameters}) RETURN {body}")
    return [called[kind] for kind in ("detect", "redact", "leftovers")]
