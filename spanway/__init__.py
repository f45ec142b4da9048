"""Linear-event analytics on Spark: rows located on keyed one-dimensional axes."""

from spanway.frame import EventFrame
from spanway.functions.direction import bearing, direction
from spanway.lrs import LRS, options, set_default_lrs
from spanway.operators.integrate import constrain_to, integrate
from spanway.operators.spatial import intersection_nodes, intersection_pairs

__all__ = ["LRS", "EventFrame", "bearing", "constrain_to", "direction", "integrate", "intersection_nodes", "intersection_pairs", "options", "set_default_lrs"]
