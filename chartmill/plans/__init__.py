"""Named plans over the tables."""

from . import queries as queries
