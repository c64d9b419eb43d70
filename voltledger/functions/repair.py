"""Repairs of numbers that optical recognition has broken: lost decimal commas and wrong digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltledger.functions.text import let


def unit(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("v")), "kVArh").when(F.endswith(low, F.lit("h")), "kWh").otherwise("kW")


def tariff(token: Column, value: Column) -> Column:
    """A token like 042212 lost the comma after its first digit."""
    lost = token.rlike(r"^0\d+$")
    return F.when(value.isNotNull() & lost, value / F.pow(F.lit(10.0), F.length(token) - 1)).otherwise(value)


def item_value(quantity: Column, price: Column, value: Column, token: Column, rate: Column) -> Column:
    """Value = quantity x price where the printed one is suspect and the price is credible; else a lost comma is put back."""
    given = F.struct(quantity.alias("q"), price.alias("p"), value.alias("v"), token.alias("t"), rate.alias("r"), F.round(quantity * price, 2).alias("e"))

    def ruled(x: Column) -> Column:
        bare = ~F.contains(x["t"], F.lit(","))
        suspect = bare | (F.abs(x["v"] - x["e"]) > 1.0)
        credible = x["r"].isNull() | ((x["r"] > 0) & (x["p"] / x["r"]).between(0.98, 1.30))
        use = F.coalesce((x["q"] > 0) & (x["p"] > 0) & suspect & credible, F.lit(False))
        return F.when(x["v"].isNotNull() & use, x["e"]).when(bare & (x["v"] >= 100), F.round(x["v"] / 100, 2)).otherwise(x["v"])

    return let(given, ruled)


def item_tax(token: Column, value: Column, item: Column) -> Column:
    """A tax above its item's value, printed without a separator, is divided by 100 if it fits then."""
    fits = ~token.rlike("[.,]") & (F.abs(value) > F.abs(item)) & (F.abs(F.round(value / 100, 2)) <= F.abs(item))
    return F.when(F.coalesce(fits, F.lit(False)), F.round(value / 100, 2)).otherwise(value)


def hundredfold(value: Column, reference: Column) -> Column:
    """value / 100 if it is about 100 times the reference."""
    near = (reference > 0) & (value / reference > 90) & (value / reference < 110)
    return F.when(F.coalesce(near, F.lit(False)), value / 100).otherwise(value)


def tax_base(base: Column, rate: Column, value: Column) -> Column:
    """The base that value and rate imply, where the printed one is off by more than a factor of two."""
    ratio = value / (base * rate / 100)
    off = (base > 0) & (rate > 0) & (value > 0) & ((ratio < 0.5) | (ratio > 2.0))
    return F.when(F.coalesce(off, F.lit(False)), F.round(value * 100 / rate, 2)).otherwise(base)


def near_hundred(ratio: Column, width: float) -> Column:
    return F.coalesce(F.abs(ratio - 100) < width, F.lit(False))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _steps():
    """The repair of both taxes, step by step: (field, new value of it from the row so far)."""
    down = lambda x, k, when: (k, F.when(_sure(when), x[k] / 100).otherwise(x[k]))
    due = lambda x, t: x[f"{t}b"] * x[f"{t}r"] / 100
    full = lambda x, t: (x[f"{t}b"] != 0) & (x[f"{t}v"] != 0) & (x[f"{t}r"] > 0)
    yield lambda x: down(x, "pr", x["pr"] > 2)
    yield lambda x: down(x, "pb", full(x, "p") & near_hundred(due(x, "p") / x["pv"], 10))
    yield lambda x: down(x, "pv", full(x, "p") & (due(x, "p") > 0) & near_hundred(x["pv"] / due(x, "p"), 10))
    yield lambda x: ("pb", tax_base(x["pb"], x["pr"], x["pv"]))
    yield lambda x: down(x, "cr", x["cr"] > 10)
    yield lambda x: ("cb", hundredfold(x["cb"], x["pb"]))
    yield lambda x: down(x, "cv", full(x, "c") & (due(x, "c") > 0) & near_hundred(x["cv"] / due(x, "c"), 10))
    yield lambda x: down(x, "cv", (x["pr"] > 0) & (x["cv"] != 0) & (x["pv"] * x["cr"] > 0) & near_hundred(x["cv"] / (x["pv"] * x["cr"] / x["pr"]), 15))
    yield lambda x: ("cb", tax_base(x["cb"], x["cr"], x["cv"]))


def tax_pair(pis: tuple[Column, Column, Column], cofins: tuple[Column, Column, Column]) -> Column:
    """struct<pb, pr, pv, cb, cr, cv>: base, rate, value of both taxes after repair; each step sees the ones before, and the second tax is anchored on the first."""
    row = F.struct(*(c.cast("double").alias(n) for n, c in zip(("pb", "pr", "pv", "cb", "cr", "cv"), (*pis, *cofins), strict=True)))
    for step in _steps():
        row = _applied(row, step)
    return row


def _applied(row: Column, step) -> Column:
    return let(row, lambda x: x.withField(*step(x)))
