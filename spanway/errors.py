"""What can be wrong with events, their schema or their geometry."""


class SpanwayError(Exception):
    pass


class SchemaError(SpanwayError):
    """A schema names columns that the operation needs and the table lacks, or contradicts itself."""


class CompatibilityError(SpanwayError):
    """Two tables can't be related: their keys differ in names or types."""


class TopologyError(SpanwayError):
    """Events or lines don't connect as the operation needs."""


class GeometrySyncError(SpanwayError):
    """Measures would change while geometry stays."""


class MeasureError(SpanwayError):
    """Measures of a line are missing or not in order."""
