"""Listing and search parameters as they stand in an address, read, checked and written again."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode

from stallwright.operators.pipeline import SORTS

#: The largest price that can be asked for, in minor units.
MOST_PRICE = 1_000_000_000
LISTS = ("brand", "category", "color", "size", "material")


def price(text: str) -> int | None:
    """A price of at most eight digits and two decimals in minor units, None for anything else."""
    plain = re.sub(r"[₹,\s]", "", text)
    if not re.fullmatch(r"[0-9]{1,8}(\.[0-9]{1,2})?", plain):
        return None
    whole, _, part = plain.partition(".")
    minor = int(whole) * 100 + int(part.ljust(2, "0") or 0)
    return minor if minor <= MOST_PRICE else None


def read(text: str) -> dict:
    """``filters`` (as ``pipeline.signature`` takes them), ``sort``, ``page``, ``limit`` and the ``unknown`` names of a query string.

    What can't be read is left out, never an error; a price range the wrong way round is turned.
    """
    filters: dict = {}
    out = {"filters": filters, "sort": "relevance", "page": 1, "limit": 24, "unknown": []}
    bounds: dict[str, int] = {}
    for name, value in parse_qsl(text.lstrip("?")):
        value = value.strip()
        if name in LISTS or name.startswith("attr."):
            axis = name.removeprefix("attr.")
            values = {v.strip().lower() for v in value.split(",") if v.strip()}
            if values and re.fullmatch("[a-z_]+", axis):
                filters[axis] = sorted(values | set(filters.get(axis, [])))
        elif name in ("min", "max"):
            if (amount := price(value)) is not None:
                bounds[name] = amount
        elif name == "rating":
            if re.fullmatch(r"[0-5](\.[0-9])?", value):
                filters["rating"] = value
        elif name == "availability":
            if value in ("in_stock", "out_of_stock", "on_sale"):
                filters["availability"] = value
        elif name == "sort":
            out["sort"] = value if value in SORTS else "relevance"
        elif name in ("page", "limit"):
            if value.isdigit():
                out[name] = min(max(1, int(value)), 500 if name == "page" else 100)
        elif name not in out["unknown"]:
            out["unknown"].append(name)
    low, high = bounds.get("min"), bounds.get("max")
    if low is not None and high is not None and low > high:
        low, high = high, low
    filters |= {k: v for k, v in (("least", low), ("most", high)) if v is not None}
    return out


def write(state: dict) -> str:
    """The query string of what ``read`` gave, without what is the default; reading it gives the same again."""
    pairs = []
    money = lambda minor: f"{minor // 100}.{minor % 100:02d}".removesuffix(".00")
    for axis, value in sorted(state["filters"].items()):
        if axis in ("least", "most"):
            pairs.append(("min" if axis == "least" else "max", money(value)))
        elif isinstance(value, list):
            pairs.append((axis if axis in LISTS else f"attr.{axis}", ",".join(value)))
        else:
            pairs.append((axis, value))
    for name, default in (("sort", "relevance"), ("page", 1), ("limit", 24)):
        if state.get(name, default) != default:
            pairs.append((name, state[name]))
    return urlencode(pairs)


def chips(state: dict) -> list[dict]:
    """Each single filter with the query string without it."""
    out = []
    for axis, value in state["filters"].items():
        for one in value if isinstance(value, list) else [value]:
            rest = {k: ([x for x in v if x != one] if k == axis and isinstance(v, list) else v) for k, v in state["filters"].items() if k != axis or isinstance(v, list)}
            out.append({"axis": axis, "value": one, "without": write(state | {"filters": {k: v for k, v in rest.items() if v not in ([], None)}, "page": 1})})
    return out


def active(state: dict) -> int:
    """How many filters are set."""
    return len(chips(state))


def merged(explicit: dict, inferred: dict) -> dict:
    """Filters with those inferred from a query where nothing explicit is said of their axis; a price counts as one."""
    priced = {"least", "most"} & set(explicit)
    return {**{k: v for k, v in inferred.items() if not (priced and k in ("least", "most"))}, **explicit}
