"""Column functions.

Every rule has two renderings: a Spark ``Column`` function used by the
engine, and a ``sql_*`` text builder used to write the DuckDB oracle for
the same rule.  Both are plain built-in expressions: no Python UDF.
"""

from kiln.functions.naming import *  # noqa: F401,F403
from kiln.functions.types import *  # noqa: F401,F403
from kiln.functions.rules import *  # noqa: F401,F403
from kiln.functions.hashing import *  # noqa: F401,F403
