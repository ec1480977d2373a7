"""Units: a table of symbols by dimension, SI prefixes, and a resolver for plain, prefixed and compound units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import let

#: SI prefixes.
PREFIXES = ("Y", "Z", "E", "P", "T", "G", "M", "k", "h", "da", "d", "c", "m", "u", "μ", "µ", "n", "p", "f", "a", "z", "y")
#: Dimension: symbols that take a prefix; symbols that don't. Symbols of several words have no spaces.
DIMENSIONS = {
    "Length": ("m meter metre meters metres", "in inch inches ft feet foot yd mi mile miles angstrom å"),
    "Area": ("m2 m²", "ha hectare hectares acre acres"),
    "Volume": ("m3 m³ l liter litre liters litres", "gal gallon bbl"),
    "Mass": ("g gram grams t ton tons tonne tonnes dalton da", "lb lbs pound pounds oz ounce kda"),
    "Time": ("s sec second seconds", "min minute minutes h hr hour hours day days week weeks month months year years yr"),
    "Frequency": ("hz hertz", ""),
    "RotationalSpeed": ("", "rpm"),
    "Energy": ("j joule joules wh watthour watt-hour cal calorie calories ev electronvolt", "btu"),
    "Power": ("w watt watts", "hp horsepower"),
    "ApparentPower": ("va", ""),
    "ReactivePower": ("var", ""),
    "Force": ("n newton dyn", ""),
    "Pressure": ("pa pascal bar", "mbar atm torr mmhg psi"),
    "ElectricPotential": ("v volt volts", ""),
    "ElectricCurrent": ("a amp amps ampere amperes", ""),
    "ElectricalResistance": ("ohm ohms ω", ""),
    "Capacitance": ("f farad", ""),
    "Inductance": ("henry", ""),
    "ElectricCharge": ("c coulomb", ""),
    "ElectricalConductance": ("siemens", ""),
    "MagneticFluxDensity": ("tesla", ""),
    "MagneticFlux": ("wb", ""),
    "MagneticField": ("gauss", ""),
    "LogarithmicRatio": ("", "db"),
    "LogarithmicPower": ("", "dbm"),
    "AntennaGain": ("", "dbi"),
    "DataRate": ("bps", ""),
    "SymbolRate": ("baud", ""),
    "DataAmount": ("bit bits byte bytes b", ""),
    "Temperature": ("", "k kelvin °c degc celsius °f degf fahrenheit"),
    "AmountOfSubstance": ("mol mole moles", ""),
    "Molarity": ("molar", ""),
    "ConcentrationRatio": ("", "ppm ppb ppt"),
    "BioActivity": ("iu unit units", ""),
    "EnzymeActivity": ("u", ""),
    "CatalyticActivity": ("kat", ""),
    "Acidity": ("", "ph"),
    "MicrobialCount": ("", "cfu"),
    "ViralCount": ("", "pfu"),
    "Equivalent": ("eq", "meq"),
    "OpticalDensity": ("", "od"),
    "LuminousIntensity": ("cd candela", ""),
    "LuminousFlux": ("lm lumen", ""),
    "Illuminance": ("lx lux", ""),
    "Luminance": ("nit nits", ""),
    "Radioactivity": ("bq becquerel ci", ""),
    "AbsorbedDose": ("gy gray", ""),
    "EquivalentDose": ("sv sievert", ""),
    "RadiationDose": ("", "rad"),
    "RadiationEquivalent": ("", "rem"),
    "DimensionlessRatio": ("", "% percent percentage ‰"),
    "Currency": ("", "usd eur idr gbp jpy cny $ € £ ¥ rp"),
    "Emission": ("", "tco2 tco2eq co2eq"),
    "Count": ("", "points specimens articles samples participants respondents patients subjects cases epochs iterations nodes parameters"),
}
#: Symbols that mean two things: the other reading (dimension, prefix allowed), which `compat=True` takes.
DOUBLE = {"g": ("MagneticField", True), "t": ("MagneticFluxDensity", True), "s": ("ElectricalConductance", True), "h": ("Inductance", True), "bps": ("FinancialRatio", False)}


def symbols(compat: bool = False) -> dict[str, tuple[str, bool]]:
    out = {s: (d, k == 0) for d, groups in DIMENSIONS.items() for k, g in enumerate(groups) for s in g.split()}
    return out | DOUBLE if compat else out


def unit_table(spark: SparkSession, compat: bool = False) -> DataFrame:
    """unit, dimension, rank for plain units (rank 0, unit in lower case) and prefixed ones (prefix as it is, base in lower case)."""
    rows = [(s, d, True) for s, (d, _) in symbols(compat).items()]
    rows += [(p + s, d, False) for s, (d, ok) in symbols(compat).items() if ok for p in PREFIXES]
    return spark.createDataFrame(rows, "unit string, dimension string, plain boolean")


def cleaned(unit: Column) -> Column:
    return F.replace(F.replace(F.coalesce(unit, F.lit("")), F.lit("·"), F.lit("*")), F.lit(" "), F.lit(""))


def _simple(unit: Column, table: dict[str, tuple[str, bool]]) -> Column:
    """The dimension of a unit without `/` and `*`, null if there is none: plain in any case, else prefix (case counts) and base."""
    known = F.create_map(*[F.lit(x) for s, (d, _) in table.items() for x in (s, d)])
    able = F.create_map(*[F.lit(x) for s, (d, ok) in table.items() if ok for x in (s, d)])
    low = F.lower(unit)
    found = [F.element_at(known, low)]
    for n in (1, 2):
        head, rest = F.left(unit, F.lit(n)), F.lower(F.substring(unit, n + 1, 1 << 20))
        found.append(F.when(head.isin(*[p for p in PREFIXES if len(p) == n]), F.element_at(able, rest)))
    return F.coalesce(*found)


def dimension(unit: Column, compat: bool = False) -> Column:
    """The physical dimension of a unit, `CompoundDimension` for products and quotients of valid units, null for what is none.

    Parts of a compound keep their case (compat: they are lower-cased first, so that upper-case prefixes fail).
    """
    table = symbols(compat)
    known = F.create_map(*[F.lit(x) for s, (d, _) in table.items() for x in (s, d)])

    def of(u: Column) -> Column:
        parts = F.transform(F.split(u, r"[/*]"), lambda p: F.regexp_replace(F.lower(p) if compat else p, r"^[()]+|[()]+$", ""))
        compound = F.when(F.forall(parts, lambda p: (p == "") | _simple(p, table).isNotNull()), "CompoundDimension")
        whole = F.element_at(known, F.lower(u))
        return F.when(u != "", F.coalesce(whole, F.when(u.rlike(r"[/*]"), compound).otherwise(_simple(u, table))))

    return let(cleaned(unit), of)
