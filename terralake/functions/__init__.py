"""Column functions; every one stays inside Catalyst, none is a Python UDF."""

from terralake.functions.scalar import *  # noqa: F401,F403
from terralake.functions.stats import *  # noqa: F401,F403
