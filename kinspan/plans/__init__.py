"""The registered queries over the driver tables."""

from . import estimates, families, registry, selections

__all__ = ["estimates", "families", "registry", "selections"]
