"""Settings of a report and their checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from descry import wording
from descry.errors import AnalysisError

#: Sections a user may choose, and those always present.
CHOOSABLE_SECTIONS = ("overview", "quality", "descriptive", "figures", "interpretation")
REQUIRED_SECTIONS = ("executive", "primary", "limitations", "technical")

_SELECTORS = {
    "group": ("outcome", "group"),
    "relationships": ("relationship_first", "relationship_second"),
    "change": ("pre", "post"),
    "time": ("date_variable", "time_outcome"),
}


@dataclass(frozen=True)
class ReportSettings:
    """What to compute and how to word it. Column names refer to the table before relabelling."""

    language: str = "en"
    report_type: str = "automatic"
    audience: str = "researcher"
    depth: str = "standard"
    study_context: str = ""
    sections: Sequence[str] = CHOOSABLE_SECTIONS
    columns: Sequence[str] | None = None
    order_by: Sequence[str] = ()
    role_overrides: Mapping[str, str] = field(default_factory=dict)
    label_overrides: Mapping[str, str] = field(default_factory=dict)
    units: Mapping[str, str] = field(default_factory=dict)
    valid_ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    outcome: str | None = None
    group: str | None = None
    independent_groups: bool = False
    relationship_first: str | None = None
    relationship_second: str | None = None
    pre: str | None = None
    post: str | None = None
    paired_confirmed: bool = False
    date_variable: str | None = None
    time_outcome: str | None = None
    preferred_chart: str | None = None
    approximate_distinct: bool = False
    #: Means, standard deviations and what follows from them by exact sums: the same bits for any partitioning, two more passes.
    reproducible: bool = False
    #: Most groups that a group report accepts, characters of study context, frequency tables shown; None: no limit.
    max_groups: int = 20
    max_context: int | None = None
    max_categorical_tables: int | None = None

    def __post_init__(self) -> None:
        choices = {
            "language": wording.LANGUAGES, "report_type": wording.REPORT_TYPES,
            "audience": ("researcher", "educator", "business", "general"), "depth": tuple(wording.CHART_BUDGETS),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise AnalysisError(f"'{getattr(self, name)}' is not a valid {name.replace('_', ' ')}.")
        unknown = set(self.sections) - set(CHOOSABLE_SECTIONS)
        if unknown:
            raise AnalysisError(f"Unknown sections: {', '.join(sorted(unknown))}.")
        if self.max_context is not None and len(self.study_context) > self.max_context:
            raise AnalysisError(f"The study context has more than {self.max_context} characters.")

    def check_selectors(self) -> None:
        """Reject a report type whose variables or confirmations are missing."""
        absent = [name for name in _SELECTORS.get(self.report_type, ()) if not getattr(self, name)]
        if absent:
            raise AnalysisError("These selectors are required for this report: " + ", ".join(absent) + ".")
        if self.report_type == "change" and not self.paired_confirmed:
            raise AnalysisError("Confirm that each row represents the same unit at both occasions.")

    def as_dict(self) -> dict[str, object]:
        return asdict(self)
