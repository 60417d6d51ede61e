"""DataFrame -> DataFrame operators."""

from . import clean, features, geo, merge, profile, reshape  # noqa: F401
