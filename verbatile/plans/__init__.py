"""Registered queries; importing the package registers those of all its modules."""

from verbatile.plans import assembled, catalog, cueing, dubs, language, repairing, reports, stories, usage  # noqa: F401
