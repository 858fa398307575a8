"""Complexity classes, their sums and products, and the costs of calls."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes from least to greatest; O(nm) and UNKNOWN stand apart.
LADDER = ("O(1)", "O(log n)", "O(n)", "O(n log n)", "O(n²)", "O(n³)", "O(2^n)")
ONE, LOG, N, N_LOG_N, N2, N3, EXP = LADDER
NM, UNKNOWN = "O(nm)", "UNKNOWN"
CLASSES = (*LADDER, NM, UNKNOWN)

#: Costs that differ from O(1) time and O(1) auxiliary space: built-in functions (fixed values).
BUILTIN_TIME = {"min": N, "max": N, "sum": N, "any": N, "all": N, "sorted": N_LOG_N}
BUILTIN_SPACE = {"sorted": N}
BUILTINS = frozenset(
    "len range enumerate zip iter reversed abs ord chr isinstance id type int float bool min max sum sorted list set dict tuple str "
    "print input repr round pow divmod next hash bin oct hex callable any all".split()
)
#: Methods of standard containers, likewise.
METHODS = frozenset("append pop sort reverse insert remove index count extend copy update get keys values items add discard".split())
METHOD_TIME = {"sort": N_LOG_N, "reverse": N, "insert": N, "remove": N, "index": N, "count": N, "extend": N, "copy": N, "update": N}
METHOD_SPACE = {"sort": N, "copy": N}
AMORTIZED = frozenset({"append", "extend"})
EXPECTED = frozenset({"update", "get", "add", "discard"})
#: Modules whose calls are outside the cost model.
EXTERNAL = frozenset({"math", "os", "sys", "json", "re", "requests", "np", "numpy"})


def add(a: str, b: str) -> str:
    """Dominant class of a sum. O(nm) swallows what is at most O(n) and yields to what is at least O(n²); against O(n log n) neither wins."""
    if UNKNOWN in (a, b):
        return UNKNOWN
    if a == b:
        return a
    if NM in (a, b):
        rank = LADDER.index(b if a == NM else a)
        return NM if rank <= LADDER.index(N) else LADDER[rank] if rank >= LADDER.index(N2) else UNKNOWN
    return max(a, b, key=LADDER.index)


def multiply(a: str, b: str, distinct: bool = False) -> str:
    """Class of a product; what the vocabulary lacks is UNKNOWN. ``distinct``: two O(n) factors range over different sizes."""
    if UNKNOWN in (a, b):
        return UNKNOWN
    if ONE in (a, b):
        return b if a == ONE else a
    known = {frozenset({N, LOG}): N_LOG_N, frozenset({N}): NM if distinct else N2, frozenset({N, N2}): N3}
    return known.get(frozenset({a, b}), UNKNOWN)


def _table(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def sum_column(classes: Column) -> Column:
    """Sum of an array of classes, in its order, since the sum is not associative; O(1) of an empty array."""
    table = _table((f"{a}+{b}", add(a, b)) for a, b in product(CLASSES, repeat=2))
    return F.aggregate(classes, F.lit(ONE), lambda a, x: table[F.concat(a, F.lit("+"), x)])


def sum_aggregate(order: Column, name: Column) -> Column:
    """The same sum as an aggregate over rows in an order (equal places by class), for groups of any size: what it keeps of any part of a group is six values.

    Before the first class of O(n²) or more, O(n log n) and O(nm) together, in whichever order, lose the sum; from there on the greatest class wins. Null classes add nothing.
    """
    place = F.struct(order.alias("order"), name.alias("name"))
    first = lambda flag: F.min(F.when(flag, place))
    large = name.isin(*LADDER[LADDER.index(N2) :])
    begin, middle, flat = first(large), first(name == N_LOG_N), first(name == NM)
    counts = lambda at: at.isNotNull() & (begin.isNull() | (at < begin))
    rank = F.array_position(F.array(*map(F.lit, LADDER)), name)
    most = F.get(F.array(*map(F.lit, LADDER)), (F.max(F.when(rank > 0, rank)) - 1).cast("int"))
    lost = F.coalesce(F.bool_or(name == UNKNOWN), F.lit(False)) | (counts(middle) & counts(flat))
    return F.when(lost, UNKNOWN).when(begin.isNull() & flat.isNotNull(), NM).otherwise(F.coalesce(most, F.lit(ONE)))


def product_column(a: Column, b: Column, distinct: Column) -> Column:
    table = _table((f"{x}*{y}*{str(d).lower()}", multiply(x, y, d)) for x, y in product(CLASSES, repeat=2) for d in (False, True))
    return table[F.concat(a, F.lit("*"), b, F.lit("*"), distinct.cast("string"))]


def cost_rows() -> list[tuple]:
    """Rows (kind, name, time, aux_space, amortized, expected) of the cost dimension."""
    built = [("builtin", n, BUILTIN_TIME.get(n, ONE), BUILTIN_SPACE.get(n, ONE), False, False) for n in sorted(BUILTINS)]
    return built + [("method", n, METHOD_TIME.get(n, ONE), METHOD_SPACE.get(n, ONE), n in AMORTIZED, n in EXPECTED) for n in sorted(METHODS)]


COST_SCHEMA = "kind string, name string, time string, aux_space string, amortized boolean, expected boolean"
