"""Material use per order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.operators.cleaning import MATERIAL_RATES, rate_of, strip_item_suffix

INVENTORY_KEY = ["order_no", "material", "category", "color"]


def inventory_rollup(valid: DataFrame) -> DataFrame:
    """Quantity by order (item suffix removed), material, category and color."""
    keyed = strip_item_suffix(valid).withColumns({c: F.trim(c) for c in INVENTORY_KEY[1:]})
    return keyed.groupBy(*INVENTORY_KEY).agg(F.sum("quantity_e4").alias("quantity_e4"))


def material_units(rates: Mapping[str, int] = MATERIAL_RATES) -> Column:
    """Quantity times rate, exact, in ten-thousandths of a cent."""
    return F.col("quantity_e4") * F.coalesce(rate_of(F.col("material"), rates), F.lit(rates["OTHER"]))


def units_to_cents(units: Column) -> Column:
    """A sum of units rounded half up to cents."""
    return F.floor((units + 5000) / 10000)


def order_material_cost(inventory: DataFrame, rates: Mapping[str, int] = MATERIAL_RATES) -> DataFrame:
    """Material cost per order, rounded once."""
    units = inventory.select("order_no", material_units(rates).alias("units")).groupBy("order_no").agg(F.sum("units").alias("units"))
    return units.select("order_no", units_to_cents(F.col("units")).alias("material_cost"))
