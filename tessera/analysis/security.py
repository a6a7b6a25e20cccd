"""Security zones, crossings between them, and what they may not do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_contains

# Words of tags, parts of paths, layers, and the zones they speak for.
TAGS = [
    ("public", 0.9, ["public", "api", "external", "endpoint", "http", "rest", "graphql"]),
    ("admin", 0.95, ["admin", "privileged", "superuser"]),
    ("data", 0.9, ["database", "storage", "persistence", "sql", "db", "store"]),
    ("internal", 0.85, ["internal", "private", "impl", "implementation"]),
    ("trusted", 0.8, ["service", "business", "logic", "auth"]),
]
PATHS = [
    ("public", 0.75, ["/api/", "/public/", "/handlers/", "/endpoints/"]),
    ("admin", 0.8, ["/admin/", "/privileged/"]),
    ("data", 0.75, ["/database/", "/storage/", "/persistence/", "/store/"]),
    ("internal", 0.7, ["/internal/", "/impl/"]),
    ("trusted", 0.65, ["/service/", "/business/"]),
]
# What a path speaks for that nothing above fits: its start, groups of parts of which each has
# to give one, zone and confidence; the first line that fits counts.
DEFAULTS = [
    ("internal/", [], "internal", 0.6),
    ("cmd/", [], "internal", 0.55),
    ("pkg/", [["/server/"], ["/rest/", "/graphql/", "handler"]], "public", 0.65),
    ("pkg/", [["/server/"]], "trusted", 0.55),
    ("pkg/", [["/schema/"], ["/graphql/"]], "public", 0.6),
    ("pkg/", [["/store", "/storage"]], "data", 0.55),
    ("pkg/", [], "internal", 0.5),
    ("examples/", [["/models/", "/utils/"]], "internal", 0.45),
    ("examples/", [["/services/"]], "trusted", 0.45),
    ("examples/", [], "public", 0.4),
]
TEST_FILE = ("_test.go", "internal", 0.4)
LAYERS = {"api": "public", "public": "public", "handlers": "public", "admin": "admin", "data": "data", "database": "data", "storage": "data", "internal": "internal", "services": "trusted", "business": "trusted", "application": "trusted"}
LAYER_CONFIDENCE = 0.6
ZONE_RISK = {"public": 5, "admin": 4, "data": 4, "trusted": 3, "unknown": 3, "internal": 2}
ALLOWED = {"public": ["trusted", "internal"], "trusted": ["internal", "data"], "internal": ["trusted", "public", "data"], "admin": ["trusted", "internal", "data"], "data": [], "unknown": []}
CROSSING_RISK = {("public", "admin"): "CRITICAL", ("public", "data"): "CRITICAL", ("public", "internal"): "HIGH", ("trusted", "admin"): "HIGH", ("internal", "public"): "MEDIUM", ("data", "public"): "MEDIUM"}
RISK_WEIGHT = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 2}


def _pick(text: Column, ladder: list) -> Column:
    out = F.lit(None).cast("struct<zone:string,confidence:double>")
    for zone, sure, words in reversed(ladder):
        out = F.when(any_contains(text, words), F.struct(F.lit(zone).alias("zone"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def classify(modules: DataFrame) -> DataFrame:
    """``modules`` with zone and confidence: by the first telling tag, else the path, the layer, a default."""
    tag = F.get(F.filter(F.transform("tags", lambda t: _pick(t, TAGS)), lambda z: z.isNotNull()), 0)
    layers = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    layer = F.try_element_at(layers, F.lower("layer"))
    by_layer = F.when(layer.isNotNull(), F.struct(layer.alias("zone"), F.lit(LAYER_CONFIDENCE).alias("confidence")))
    low = F.lower("path")
    made = lambda z, c: F.struct(F.lit(z).alias("zone"), F.lit(c).alias("confidence"))
    default = F.when(low.endswith(TEST_FILE[0]), made(*TEST_FILE[1:])).otherwise(made("unknown", 0.0))
    for start, groups, zone, sure in reversed(DEFAULTS):
        fits = low.startswith(start)
        for words in groups:
            fits = fits & any_contains(low, words)
        default = F.when(fits, made(zone, sure)).otherwise(default)
    z = F.coalesce(tag, _pick(F.col("path"), PATHS), by_layer, default)
    return modules.withColumn("__z", z).withColumn("zone", F.col("__z.zone")).withColumn("confidence", F.col("__z.confidence")).drop("__z")


def _map(values: dict, key: Column, otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), otherwise)


def crossings(edges: DataFrame, zoned: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """(src, dst, src_zone, dst_zone, risk, allowed) of links between zones; ``allowed`` replaces the list of a zone."""
    z = zoned.select("path", "zone")
    c = edges.select("src", "dst").distinct()
    c = c.join(z.toDF("src", "src_zone"), "src").join(z.toDF("dst", "dst_zone"), "dst").where("src_zone <> dst_zone")
    pair = F.concat_ws(">", "src_zone", "dst_zone")
    may = [f"{a}>{b}" for a, to in (ALLOWED | (allowed or {})).items() for b in to]
    return c.select("src", "dst", "src_zone", "dst_zone", _map({f"{a}>{b}": r for (a, b), r in CROSSING_RISK.items()}, pair, F.lit("LOW")).alias("risk"), pair.isin(may).alias("allowed"))


def boundaries(crossed: DataFrame) -> DataFrame:
    return crossed.groupBy("src_zone", "dst_zone").agg(F.count(F.lit(1)).alias("n"))


def violations(crossed: DataFrame, strict: bool = False) -> DataFrame:
    """Crossings that are not allowed; ``strict`` adds allowed ones of high risk."""
    bad = ~F.col("allowed")
    if strict:
        bad = bad | F.col("risk").isin("CRITICAL", "HIGH")
    return crossed.where(bad).withColumn("kind", F.when(F.col("allowed"), "risky").otherwise("unauthorized")).drop("allowed")


def risk_score(violated: DataFrame) -> DataFrame:
    """One row: violations, critical, high and their mean weight, 10 at most, 0 without any."""
    w = _map(RISK_WEIGHT, F.col("risk"), F.lit(2)).cast("double")
    return violated.agg(
        F.count(F.lit(1)).alias("violations"), F.count_if(F.col("risk") == "CRITICAL").alias("critical"), F.count_if(F.col("risk") == "HIGH").alias("high"), F.round(F.least(F.coalesce(F.avg(w), F.lit(0.0)), F.lit(10.0)), 6).alias("score")
    )


def zone_info(spark) -> DataFrame:
    return spark.createDataFrame([(z, r) for z, r in ZONE_RISK.items()], "zone string, risk long")


def recommendations(violated: DataFrame) -> DataFrame:
    """(nth, advice): what the violations ask for; one line where there are none."""
    n = violated.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk") == "CRITICAL").alias("critical"), F.count_if(F.col("risk") == "HIGH").alias("high"))
    counted = lambda c, rest: F.when(F.col(c) > 0, F.concat(F.lit("Mend "), F.col(c).cast("string"), F.lit(rest)))
    lines = F.array(counted("critical", " critical crossings first"), counted("high", " crossings of high risk"), *map(F.lit, ("Check who calls at every boundary", "Check what comes in at every boundary", "Log what crosses a boundary")))
    lines = F.when(F.col("n") > 0, F.filter(lines, lambda x: x.isNotNull())).otherwise(F.array(F.lit("No crossing is out of order")))
    return n.select(F.posexplode(lines).alias("nth", "advice"))
