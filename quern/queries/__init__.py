"""The registered queries; importing the modules registers them."""

from quern.queries import facets, lifecycle, quality, searching, textual  # noqa: F401
