"""The one exception type raised at the API boundary."""


class AnalysisError(ValueError):
    """The table or the settings do not allow the requested analysis."""
