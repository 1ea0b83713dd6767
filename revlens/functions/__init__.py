from revlens.functions.expr import *  # noqa: F401,F403
from revlens.functions.keys import coerce_numeric_key  # noqa: F401
