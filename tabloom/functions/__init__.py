"""Column-expression helpers shared by the operators (all JVM-side)."""

from tabloom.functions.exprs import *  # noqa: F401,F403
