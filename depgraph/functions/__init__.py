"""Column functions over identifiers and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depgraph.model import BUILTIN_NAMES, EDGE_KINDS, INVERSE, REVERSE_KINDS

_LETTER = r"([a-zA-Z_]|[^\x00-\x7F])"
_MORE = r"([a-zA-Z0-9_]|[^\x00-\x7F])*"
IDENTIFIER = f"^{_LETTER}{_MORE}$"
NAMESPACE = rf"^{_LETTER}([a-zA-Z0-9_\\]|[^\x00-\x7F])*$"


def owner(id: Column) -> Column:
    """What stands before the first ``::``; null if there is none."""
    return F.when(F.instr(id, "::") > 0, F.split_part(id, F.lit("::"), F.lit(1)))


def member(id: Column) -> Column:
    """What stands after the first ``::``; null if there is none."""
    at = F.instr(id, "::")
    return F.when(at > 0, F.substring(id, at + 2, F.length(id)))


def _symbol(id: Column) -> Column:
    return F.coalesce(owner(id), id)


def namespace(id: Column) -> Column:
    """What stands before the last backslash of the symbol; empty if there is none."""
    symbol = _symbol(id)
    short = F.substring_index(symbol, "\\", -1)
    return F.when(F.instr(symbol, "\\") > 0, F.left(symbol, F.length(symbol) - F.length(short) - 1)).otherwise("")


def short_name(id: Column) -> Column:
    """What stands after the last backslash of the symbol."""
    return F.substring_index(_symbol(id), "\\", -1)


def qualified(ns: Column, name: Column) -> Column:
    return F.when(ns == "", name).otherwise(F.concat_ws("\\", ns, name))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER)


def is_namespace(name: Column) -> Column:
    return name.rlike(NAMESPACE)


def is_builtin(name: Column) -> Column:
    return F.lower(name).isin(*BUILTIN_NAMES)


def is_reverse(kind: Column) -> Column:
    return kind.isin(*REVERSE_KINDS)


def inverse_kind(kind: Column) -> Column:
    """The reverse kind of a forward kind; null for reverse kinds."""
    usage = [k for k, (c, _, _) in EDGE_KINDS.items() if c == "usage"]
    declared = [k for k, (c, _, _) in EDGE_KINDS.items() if c == "declaration"]
    return F.when(kind.isin(*usage), INVERSE["usage"]).when(kind.isin(*declared), INVERSE["declaration"])


def forward_kind(kind: Column, src_kind: Column, dst_kind: Column) -> Column:
    """The forward kind that a reverse edge object gives by its endpoints (lossy); null where there is none.

    src_kind and dst_kind are those of the reverse edge.
    """
    used = F.create_map(*(F.lit(x) for x in ("function", "function-call", "constant", "const-fetch", "class", "instantiation", "property", "property-access", "method", "method-call")))
    member_kinds = F.create_map(*(F.lit(x) for x in ("method", "declaration-method", "property", "declaration-property", "constant", "declaration-constant", "enum_case", "declaration-enum-case")))
    above = F.create_map(*(F.lit(x) for x in ("class", "declaration-extends", "interface", "declaration-implements", "trait", "declaration-trait-use")))
    declared = F.coalesce(
        F.try_element_at(member_kinds, src_kind),
        F.when(dst_kind == "class", F.try_element_at(above, src_kind)),
        F.when(dst_kind == "property", "declaration-type-property"),
        F.when(dst_kind.isin("method", "function"), "declaration-type-return"),
    )
    return F.when(kind == "used-by", F.try_element_at(used, src_kind)).when(kind == "declared-in", declared)
