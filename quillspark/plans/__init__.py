"""The registered queries: the registry comes first, since its modules add to it in order."""

from . import registry  # noqa: F401
