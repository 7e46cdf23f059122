"""Named queries over the given tables. Importing this package registers them all."""

from . import audits, cleaning, enriching, featurework, learning, roundtrips  # noqa: F401
