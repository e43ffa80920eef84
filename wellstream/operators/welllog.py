"""Bulk import of depth-indexed well logs.

A *document* is one row of header values; its *lines* are rows of fields. The import keeps a document
whole: the first error rejects all of it, in this order: structure of the document, number of fields per
line, required curves and units, then the values line by line.

Everything that depends only on the header, such as which field holds which curve, is resolved once per
document; a line only indexes into its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.functions import welltext as W
from wellstream.functions.once import evaluated_once
from wellstream.functions.predicates import is_blank, is_finite
from wellstream.operators.slices import SLICE, slice_start
from wellstream.schemas import LOG_NAMESPACE

# The supported log format.
VERSION = "1.4.1.1"
INDEX_TYPE = "measured depth"
TIME_CURVE, GAMMA_CURVE, PRESSURE_CURVE, TEMPERATURE_CURVE = "DTIM", "GR", "SPP", "TEMP"
REQUIRED_CURVES = [TIME_CURVE, GAMMA_CURVE, PRESSURE_CURVE, TEMPERATURE_CURVE]
DEPTH_UNITS = ["m", "ft"]
CURVE_UNITS = {
    "GR": "gAPI",
    "SPP": "psi",
    "TEMP": "degC",
}

# Order in which the stages of an import can fail.
STRUCTURE, FIELD_COUNT, CURVES, VALUES = 1, 2, 3, 4

LINES_PER_SLICE = 1 << 20


def _first(*rules: tuple[Column, Column | str]) -> Column:
    return F.coalesce(*[F.when(broken, reason) for broken, reason in rules])


def _missing(column: str, name: str, kind: str = "element") -> tuple[Column, str]:
    broken = is_blank(F.col(column)) if kind == "attribute" else F.col(column).isNull()
    return broken, f"required {kind} '{name}' is missing"


def structure_reason() -> Column:
    """First structural error of a document, or null."""
    columns, units = F.size("mnemonics").cast("string"), F.size("units").cast("string")
    return _first(
        (F.col("malformed"), "invalid XML"),
        (~F.col("xmlns").eqNullSafe(F.lit(LOG_NAMESPACE)), "root element is not in the log namespace"),
        (~F.col("version").eqNullSafe(F.lit(VERSION)),
         F.concat(F.lit(f"unsupported version, expected {VERSION}, found "), F.coalesce("version", F.lit("none")))),
        (F.col("log_count") == 0, "no log element"),
        (F.col("log_count") > 1, F.concat(F.lit("only one log per document, found "), F.col("log_count").cast("string"))),
        _missing("uid_well", "uidWell", "attribute"),
        _missing("name_well", "nameWell"),
        _missing("uid_wellbore", "uidWellbore", "attribute"),
        _missing("name_wellbore", "nameWellbore"),
        _missing("uid", "uid", "attribute"),
        _missing("index_type", "indexType"),
        (F.col("index_type") != INDEX_TYPE,
         F.concat(F.lit("unsupported index type '"), F.col("index_type"), F.lit("'"))),
        _missing("index_curve", "indexCurve"),
        (F.exists("curves", lambda c: c["mnemonic"].isNull()), "required element 'mnemonic' is missing"),
        (~F.col("has_log_data"), "required element 'logData' is missing"),
        _missing("mnemonic_list", "mnemonicList"),
        _missing("unit_list", "unitList"),
        (F.size("mnemonics") != F.size("units"),
         F.concat(columns, F.lit(" columns in the mnemonic list but "), units, F.lit(" in the unit list"))),
    )


def _unit_reason(curve: Column | str, unit: Column) -> Column:
    name = F.lit(curve) if isinstance(curve, str) else curve
    return F.concat(F.lit("curve "), name, F.lit(" has unsupported unit '"), unit, F.lit("'"))


def curve_reason() -> Column:
    """First missing curve, missing curve description or unsupported unit, or null."""
    described = F.transform("curves", lambda c: c["mnemonic"])
    index_curve = F.col("index_curve")
    rules = [
        (is_blank(index_curve), "index curve is empty"),
        (F.col("depth_at").isNull(), F.concat(F.lit("index curve "), index_curve, F.lit(" is not in the mnemonic list"))),
    ]
    rules += [
        (F.col(f"{c.lower()}_at").isNull(), f"required mnemonic {c} is not in the mnemonic list") for c in REQUIRED_CURVES
    ]
    rules.append((~F.array_contains(described, index_curve),
                  F.concat(F.lit("index curve "), index_curve, F.lit(" has no curve info"))))
    rules += [
        (~F.array_contains(described, F.lit(c)), f"required mnemonic {c} has no curve info") for c in REQUIRED_CURVES
    ]
    rules.append((~F.col("depth_unit").isin(DEPTH_UNITS), _unit_reason(index_curve, F.col("depth_unit"))))
    for curve, unit in CURVE_UNITS.items():
        found = F.get("units", F.col(f"{curve.lower()}_at") - 1)
        rules.append((found != unit, _unit_reason(curve, found)))
    return _first(*rules)


def resolve(documents: DataFrame) -> DataFrame:
    """Adds field positions, depth unit, null values and the header's first errors."""
    listed = evaluated_once(documents, mnemonics=W.split_list("mnemonic_list"), units=W.split_list("unit_list"))

    def null_value(name: Column) -> Column:
        """That of the last curve of the name."""
        return F.try_element_at(F.filter("curves", lambda c: c["mnemonic"] == name), F.lit(-1))["null_value"]

    curves = {"depth": F.col("index_curve"), **{c.lower(): F.lit(c) for c in REQUIRED_CURVES}}
    placed = evaluated_once(
        listed,
        **{f"{n}_at": W.last_position(F.col("mnemonics"), c) for n, c in curves.items()},
        **{f"{n}_null": F.nullif(null_value(c), F.lit("")) for n, c in curves.items()},
    )
    with_unit = placed.select("*", F.get("units", F.col("depth_at") - 1).alias("depth_unit"))
    checked = evaluated_once(with_unit, structure_reason=structure_reason())
    return evaluated_once(checked, curve_reason=F.when(F.col("structure_reason").isNull(), curve_reason()))


LINE_NEEDS = [
    "path", "device_id", "uid_well", "name_well", "uid_wellbore", "name_wellbore", "index_curve", "depth_unit",
    *[f"{n}_{part}" for n in ("depth", "dtim", "gr", "spp", "temp") for part in ("at", "null")],
]


def join_lines(resolved: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (path, line_no, line) of documents whose header is sound, with what they need of it."""
    sound = resolved.where(F.col("structure_reason").isNull())
    headers = sound.select(*LINE_NEEDS, F.size("mnemonics").alias("columns"), "curve_reason")
    return lines.join(headers, "path")


def _field(name: str) -> Column:
    return W.strip(F.get("fields", F.col(f"{name}_at") - 1))


def _value_rules(name: str, label: Column) -> list[tuple[Column, Column]]:
    """L10 to L12, L14 for one field."""
    text, null_value = F.col(f"{name}_text"), F.col(f"{name}_null")
    rules = [
        (text == "", F.concat(label, F.lit(" has an empty value"))),
        (text == null_value, F.concat(label, F.lit(" uses the null value '"), null_value, F.lit("'"))),
    ]
    if name == "dtim":
        rules.append((F.col("dtim").isNull(), F.concat(label, F.lit(" is not an ISO 8601 time with offset"))))
        return rules
    number = F.col(name)
    rules.append((number.isNull(), F.concat(label, F.lit(" is not a valid number"))))
    rules.append((~is_finite(number), F.concat(label, F.lit(" is not finite"))))
    if name in ("depth", "gr"):
        rules.append((number < 0, F.concat(label, F.lit(" is negative"))))
    return rules


def map_lines(lines: DataFrame, lines_per_slice: int = LINES_PER_SLICE) -> DataFrame:
    """Values, time order and rate of every line, with ``stage`` and ``reason`` of its first error.

    The previous line comes from a window over a slice of the document. The last line of each slice is
    shown to the next slice too, so a very long document is not one task.
    """
    names = ("depth", "dtim", "gr", "spp", "temp")
    fields = lines.select("*", F.split("line", ",", -1).alias("fields"))
    texts = fields.select("*", *[_field(n).alias(f"{n}_text") for n in names])
    values = texts.select(
        "*",
        *[W.parse_number(F.col(f"{n}_text")).alias(n) for n in ("depth", "gr", "spp", "temp")],
        W.parse_time(F.col("dtim_text")).alias("dtim"),
    )
    # What a line says by itself is judged here, so that texts and header don't go through the shuffle below.
    labels = {
        "depth": F.col("index_curve"), "dtim": F.lit(TIME_CURVE), "gr": F.lit(GAMMA_CURVE),
        "spp": F.lit(PRESSURE_CURVE), "temp": F.lit(TEMPERATURE_CURVE),
    }
    columns_found = F.size("fields") != F.col("columns")
    count_reason = F.concat(
        F.size("fields").cast("string"), F.lit(" fields but "), F.col("columns").cast("string"), F.lit(" columns")
    )
    own_reason = F.coalesce(F.col("curve_reason"), *[_first(*_value_rules(name, label)) for name, label in labels.items()])
    judged = values.select(
        "path", "device_id", "line_no", "uid_well", "name_well", "uid_wellbore", "name_wellbore",
        W.to_metres(F.col("depth"), F.col("depth_unit")).alias("depth_metres"), "dtim", "gr", "spp", "temp",
        F.when(columns_found, FIELD_COUNT).when(F.col("curve_reason").isNotNull(), CURVES).otherwise(VALUES).alias("_stage"),
        F.when(columns_found, count_reason).otherwise(own_reason).alias("_reason"),
        F.size("fields").alias("fields"), "columns",
    )

    start = slice_start(F.col("line_no"), lines_per_slice)
    is_last = F.pmod("line_no", F.lit(lines_per_slice)) == lines_per_slice - 1
    shown = F.array_compact(F.array(
        F.struct(start.alias("at"), F.lit(False).alias("again")),
        F.when(is_last, F.struct((start + lines_per_slice).alias("at"), F.lit(True).alias("again"))),
    ))
    placed = judged.select("*", F.inline(shown)).withColumnRenamed("at", SLICE)
    by_line = Window.partitionBy("path", SLICE).orderBy("line_no")
    previous = F.lag(F.struct("depth_metres", "dtim")).over(by_line)
    chained = placed.select("*", previous.alias("_previous")).where(~F.col("again"))

    reason = F.coalesce("_reason", _first(
        (F.col("dtim") <= F.col("_previous.dtim"), F.lit("time is not later than that of the previous line"))))
    hours = (F.unix_micros("dtim") - F.unix_micros("_previous.dtim")) / 3.6e9
    rate = F.coalesce(F.try_divide(F.col("depth_metres") - F.col("_previous.depth_metres"), hours), F.lit(0.0))
    return chained.select(
        "path", "device_id", "line_no", "uid_well", "name_well", "uid_wellbore", "name_wellbore",
        "depth_metres", "dtim", "gr", "spp", "temp", rate.alias("rate"),
        F.when(reason.isNotNull(), F.col("_stage")).alias("stage"), reason.alias("reason"), "fields", "columns",
    )


def line_rejects(mapped: DataFrame) -> DataFrame:
    """First error per document among its lines."""
    return (
        mapped.where(F.col("reason").isNotNull())
        .groupBy("path")
        .agg(F.min(F.struct("stage", "line_no", "reason")).alias("_e"))
        .select(
            "path",
            F.when(F.col("_e.stage") != CURVES, F.col("_e.line_no")).alias("line_no"),
            F.when(F.col("_e.stage") == CURVES, F.col("_e.reason"))
            .otherwise(F.concat(F.lit("Data line "), F.col("_e.line_no").cast("string"), F.lit(": "), F.col("_e.reason")))
            .alias("reason"),
        )
    )


def header_rejects(resolved: DataFrame) -> DataFrame:
    """L1, and L7 to L9 for documents; a field-count error of a line still goes first."""
    return resolved.where(F.col("structure_reason").isNotNull() | F.col("curve_reason").isNotNull()).select(
        "path",
        F.lit(None).cast("bigint").alias("line_no"),
        F.coalesce("structure_reason", "curve_reason").alias("reason"),
    )


def import_rejects(resolved: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row per rejected document: (path, line_no, reason). Documents without lines count too."""
    by_line = line_rejects(mapped).withColumn("_rank", F.lit(0))
    by_header = header_rejects(resolved).withColumn("_rank", F.lit(1))
    both = by_line.unionByName(by_header).groupBy("path").agg(F.min(F.struct("_rank", "line_no", "reason")).alias("_e"))
    return both.select("path", "_e.line_no", "_e.reason")


def import_session(path: Column, device: Column, import_id: str) -> Column:
    """UUID-shaped session id of one document in one import run; the same again when the run is repeated."""
    digest = F.sha2(F.concat_ws("|", path, device, F.lit(import_id)), 256)
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def import_readings(mapped: DataFrame, rejected: DataFrame, import_id: str) -> DataFrame:
    """Readings of the documents that have no error, numbered in line order from 1."""
    operation = (
        F.when(F.col("rate") > 0, "DrillingAhead").when(F.col("rate") < 0, "TrippingOut").otherwise("Stationary")
    )
    return mapped.join(rejected, "path", "left_anti").select(
        "device_id",
        import_session(F.col("path"), F.col("device_id"), import_id).alias("acquisition_session_id"),
        F.col("line_no").alias("sequence_number"),
        F.col("uid_well").alias("well_id"),
        F.col("name_well").alias("well_name"),
        F.col("uid_wellbore").alias("wellbore_id"),
        F.col("name_wellbore").alias("wellbore_name"),
        F.col("depth_metres").alias("measured_depth_metres"),
        operation.alias("drilling_operation"),
        F.col("rate").alias("depth_change_rate_metres_per_hour"),
        F.col("spp").alias("pressure_psi"),
        F.col("temp").alias("temperature_celsius"),
        F.col("gr").alias("gamma_ray_api"),
        F.col("dtim").alias("timestamp_utc"),
        F.lit("HistoricalImport").alias("acquisition_mode"),
    )


def import_summary(resolved: DataFrame, mapped: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per document with its lists, rows and accepted readings."""
    rows = mapped.groupBy("path").agg(F.count(F.lit(1)).alias("_rows"))
    bad = rejected.select("path", "reason")
    return (
        resolved.join(rows, "path", "left")
        .join(bad, "path", "left")
        .select(
            "path", "device_id", "name_well", "name_wellbore", "mnemonic_list", "unit_list",
            F.coalesce("_rows", F.lit(0)).alias("data_rows"),
            F.when(F.col("reason").isNull(), F.coalesce("_rows", F.lit(0))).otherwise(0).alias("readings"),
            "reason",
        )
    )
