"""The whole transform: a DataFrame in, four lazy DataFrames out.

Each selected column goes through a chain of projections: text and guards,
candidate spans, detections, conflict-free spans, redacted text, findings. No
step shuffles and none runs Python, so the chain also serves streams. Every
step is a column used more than once by the next, which keeps the optimiser
from merging projections and computing a step twice.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.catalogue import (
    DEFAULT_CATALOGUE,
    DEFAULT_ENTITY_TYPES,
    LIBRARY_THRESHOLD,
    STYLE_GENERIC,
    Catalogue,
)
from quillmask.functions import algebra
from quillmask.functions.redaction import splice
from quillmask.functions.spans import folded, is_plain
from quillmask.functions.sql import name
from quillmask.operators import reports
from quillmask.operators.columns import as_text, check_selection, output_names, text_columns
from quillmask.operators.detection import candidates, guard, guard_patterns, has_digit
from quillmask.operators.names import missed_names
from quillmask.operators.residual import residual_findings


def detections_of(candidate_spans: str, catalogue: Catalogue, allowed: str | None = None) -> str:
    """Spans without those inside a better one of their type, and without allowed words.

    ``allowed`` names a column with the allowed texts of the cell.
    """
    kept = algebra.drop_allowed(algebra.drop_contained(candidate_spans), catalogue.allow_list)
    return kept if allowed is None else f"filter({kept}, a -> not coalesce(array_contains({allowed}, a.text), false))"


def redaction_spans(merged: str) -> str:
    """Merged spans without those inside another."""
    return algebra.resolve_conflicts(merged)


STEPS = ("text", "plain", "low", "digit", "candidates", "kept", "detections", "merged", "spans", "joined", "redacted", "findings")


@dataclass(frozen=True)
class CellColumns:
    """Names of the working columns of one source column."""

    source: str
    output: str
    prefix: str

    def __getattr__(self, step: str) -> str:
        if step not in STEPS:
            raise AttributeError(step)
        return f"{self.prefix}{step}"


@dataclass(frozen=True)
class Anonymised:
    """Result of :func:`anonymise`. Nothing runs until one of its frames is used."""

    wide: DataFrame
    original_columns: tuple[str, ...]
    cells: tuple[CellColumns, ...]
    key: tuple[str, ...]
    row_index: str | None

    @property
    def data(self) -> DataFrame:
        """All original columns plus one redacted column per selected column.

        The redacted columns pass through a generator, which the optimiser does
        not push predicates through; a filter on one of them would otherwise be
        rewritten in terms of the source text, once for every use of every step.
        """
        redacted = F.struct(*[F.col(c.redacted).alias(c.redacted) for c in self.cells])
        originals = [F.col(name(c)) for c in self.original_columns]
        barred = self.wide.select(*originals, F.explode(F.array(redacted)).alias("__qm_out"))
        return barred.select(*originals, *[F.col(f"__qm_out.{c.redacted}").alias(c.output) for c in self.cells])

    @property
    def output_columns(self) -> tuple[str, ...]:
        return tuple(c.output for c in self.cells)

    def detections(self) -> DataFrame:
        """One row per reported span."""
        return reports.detection_report(self)

    def residuals(self) -> DataFrame:
        """One row per finding."""
        return reports.residual_report(self)

    def residual_flags(self) -> DataFrame:
        """One row per cell with findings, the findings nested."""
        return reports.flagged_cells(self)

    def stats(self) -> DataFrame:
        """One row with the six run counters."""
        return reports.run_stats(self)

    def on(self, wide: DataFrame) -> "Anonymised":
        """The same result over a stored copy of its wide frame."""
        return replace(self, wide=wide)


def anonymise(
    df: DataFrame,
    columns: list[str] | None = None,
    entity_types=DEFAULT_ENTITY_TYPES,
    style: str = STYLE_GENERIC,
    threshold: float = LIBRARY_THRESHOLD,
    key: list[str] | str = (),
    row_index: str | None = None,
    catalogue: Catalogue = DEFAULT_CATALOGUE,
    entities: dict[str, str] | None = None,
    tokens: dict[str, str] | None = None,
    allowed: dict[str, str] | None = None,
) -> Anonymised:
    """Plan the anonymisation of the free-text columns of ``df``.

    ``columns`` defaults to the columns whose names suggest free text. ``key``
    columns are carried into the reports; ``row_index`` names a column with the
    row position (see ``sources.row_index``). ``entities`` and ``tokens`` map a
    selected column to an annotation column (see ``operators.annotations``),
    ``allowed`` to a column of texts that are no detections (``operators.allowed``).
    """
    columns = text_columns(df.columns) if columns is None else list(columns)
    entity_types = tuple(dict.fromkeys(entity_types))
    known = {d.entity_type for d in catalogue.detectors} | set(catalogue.tag_map)
    check_selection(df, columns, entity_types, known, threshold)
    key = (key,) if isinstance(key, str) else tuple(key)
    # Working columns of annotations are inputs, not part of the result.
    hidden = {column for given in (entities, tokens, allowed) for column in (given or {}).values()}
    original = tuple(c for c in df.columns if c not in hidden)
    names = output_names(list(original), columns)
    cells = tuple(CellColumns(c, names[c], f"__qm{i}_") for i, c in enumerate(columns))

    on = catalogue.active(entity_types, threshold)
    guards = guard_patterns([*on, *catalogue.residual_patterns])

    def has(cell: CellColumns) -> dict:
        return {g: f"{cell.prefix}has{i}" for i, g in enumerate(guards)}

    # Annotations get names of their own, which no variable of an expression has.
    aliased = {}

    def annotation(given: dict[str, str] | None, cell: CellColumns) -> str | None:
        if not given or cell.source not in given:
            return None
        kind = "tokens" if given is tokens else "allowed" if given is allowed else "entities"
        aliased[f"{cell.prefix}given_{kind}"] = F.col(name(given[cell.source]))
        return f"{cell.prefix}given_{kind}"

    for c in cells:
        for given in (entities, tokens, allowed):
            annotation(given, c)

    def add(frame: DataFrame, step: str, expression) -> DataFrame:
        return frame.withColumns({getattr(c, step): F.expr(expression(c)) for c in cells})

    wide = df.withColumns({c.text: as_text(F.col(name(c.source))) for c in cells} | aliased)
    wide = add(add(wide, "plain", lambda c: is_plain(c.text)), "low", lambda c: folded(c.text))
    wide = add(wide, "digit", lambda c: has_digit(c.text, c.plain))
    wide = wide.withColumns(
        {column: F.expr(guard(c.text, *g, c.digit, c.plain, c.low)) for c in cells for g, column in has(c).items()}
    )
    wide = add(
        wide,
        "candidates",
        lambda c: candidates(c.text, on, catalogue, entity_types, threshold, has(c), annotation(entities, c), c.plain),
    )
    wide = add(wide, "kept", lambda c: detections_of(c.candidates, catalogue, annotation(allowed, c)))
    wide = add(wide, "detections", lambda c: algebra.report_order(c.kept))
    wide = add(wide, "merged", lambda c: algebra.merge_overlaps(c.detections))
    wide = add(wide, "spans", lambda c: redaction_spans(c.merged))
    wide = add(wide, "joined", lambda c: algebra.merge_adjacent(c.text, c.spans))
    wide = add(wide, "redacted", lambda c: splice(c.text, c.joined, style, catalogue.tag_map))

    def findings(c: CellColumns) -> str:
        left = residual_findings(
            c.redacted, catalogue, f"size({c.candidates}) > 0", entity_types, threshold, style, has(c), c.plain
        )
        if "PERSON" not in entity_types:
            return left
        missed = missed_names(
            c.text, c.detections, catalogue.allow_list, annotation(tokens, c), annotation(entities, c), c.plain
        )
        return f"concat({left}, {missed})"

    wide = add(wide, "findings", findings)
    return Anonymised(wide, original, cells, key, row_index)
