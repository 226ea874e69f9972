"""Imports every module that registers queries."""

from . import grain_queries  # noqa: F401
from . import panel_queries  # noqa: F401
from . import describe_queries  # noqa: F401
from . import spatial_queries  # noqa: F401
from . import store_queries  # noqa: F401
from . import strata_queries  # noqa: F401
from . import profile_queries  # noqa: F401
