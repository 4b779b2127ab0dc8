"""Registered queries of the anonymisation engine and their SQL oracles, on stand-ins for its two datasets.

``events`` stands in for vehicle observations: a user is a plate, the value a speed, a user's
parity a cell. ``orders`` and ``lineitem`` stand in for test results and days, ``part`` for ages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import aggregates, kanon, privacy, transforms
from veilframe.sources import json_arrays, shared, sinks

FIRST_HOUR, LAST_HOUR, THRESHOLD, LEAST, MOST, EPSILON, STEP = 9, 20, 60.0, 0.0, 65.0, 2.0, 0.1
#: Plates a day that a tile needs, for each event of the table: the tables differ in users, and a fixed bound would keep all tiles of one and none of another.
PER_DAY_AND_EVENT = 0.00065
DAYS_MOST, K, AGE_LEAST, AGE_MOST = 8.0, 200, 0, 51


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns or "*")


def _observations(spark, d):
    return _table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("trip_id"), F.col("user_id").cast("string").alias("license_plate"), F.col("ts").alias("observationDateTime"),
        F.col("value").alias("speed"), F.expr("cast(user_id % 2 as string)").alias("h3index"))


def _tiles(spark, d):
    return transforms.add_tile(transforms.filter_hours(transforms.generalize_time(_observations(spark, d), "observationDateTime"), FIRST_HOUR, LAST_HOUR))


def _grain(spark, d):
    return aggregates.accumulate(_tiles(spark, d), "speed")


def _supported(spark, d):
    return aggregates.supported(_grain(spark, d), PER_DAY_AND_EVENT * _table(spark, d, "events").count())  # the count is in the files' footers


def _means(spark, d):
    return privacy.with_sensitivity(aggregates.mean_query(_supported(spark, d)), LEAST, MOST)


def _grid(spark):
    return privacy.epsilon_grid(spark, 1.0, 30.0, STEP)


def _medical_grid(spark):
    return privacy.epsilon_grid(spark, 0.01, 10.0, STEP)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def suppress(spark, d):
    return transforms.suppress(_table(spark, d, "customer"), ["c_acctbal", "c_mktsegment"])


def pseudonymize(spark, d):
    return transforms.pseudonymize(_table(spark, d, "customer", "c_name", "c_custkey", "c_nationkey"), ["c_name", "c_custkey"], name="hashed_value")


def suppress_pseudonymize(spark, d):
    return transforms.pseudonymize(suppress(spark, d), ["c_name", "c_custkey"], name="hashed_value")


#: For tests and comparisons: keys of a real release are secrets.
KEY = b"not a secret"


def pseudonymize_keyed(spark, d):
    return transforms.pseudonymize(_table(spark, d, "customer", "c_name", "c_custkey", "c_nationkey", "c_mktsegment"), ["c_name", "c_custkey", "c_nationkey"], name="hashed_value", key=KEY)


def document_round_trip(spark, d):
    """The orders as one JSON document, written by the tasks, and read again in byte ranges."""
    shared.use_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/documents/orders.json"
    sinks.write_records(_table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return json_arrays.read(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").drop("file")


def schema_drift(spark, d):
    """Events whose value is now a number and now a text, from a document of such objects: their kinds are found in one pass and no row is lost."""
    shared.use_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/documents/events.json"
    value = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(F.col("value").cast("string")))).otherwise(F.to_json(F.array("value")))
    text = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"value":'), F.substring(value, F.lit(2), F.length(value) - 2), F.lit("}"))
    sinks.write_document(_table(spark, d, "events", "event_id", "value").select(text.alias("value")), path, "[", "]")
    found = json_arrays.read(spark, path)
    return found.select("event_id", F.round(F.col("value").cast("double"), 6).alias("value"), F.lit(dict(found.dtypes)["value"]).alias("kind"))


def dedup_keep_first(spark, d):
    return transforms.deduplicate(_table(spark, d, "documents", "doc_id", "text", "lang", "source"), ["doc_id"]).select("doc_id", "lang", "source")


def dedup_arrays_aside(spark, d):
    return transforms.deduplicate(_table(spark, d, "embeddings"), ["vec_id"]).select("vec_id", "label")


def temporal_generalize(spark, d):
    return transforms.generalize_time(_observations(spark, d), "observationDateTime", keep_time=True).select("trip_id", "Date", "Time", "Timeslot")


def temporal_filter(spark, d):
    return transforms.filter_hours(transforms.generalize_time(_observations(spark, d), "observationDateTime"), FIRST_HOUR, LAST_HOUR).select("trip_id", "Timeslot")


def hat_create(spark, d):
    return _tiles(spark, d).select("trip_id", "HAT")


def coords_parse(spark, d):
    text = F.format_string("[%.4f, %.4f]", F.expr("77.0 + (user_id % 7) * 0.013d"), F.expr("12.0 + (event_id % 5) * 0.017d"))
    rows = _table(spark, d, "events").select("event_id", text.alias("location.coordinates"))
    return transforms.generalize_place(rows, "location.coordinates", name="cell")


def coords_hex(spark, d):
    """Hexagons of points all over the globe, their parents and how many neighbours they have."""
    lon, lat = F.expr("(user_id * 37 % 3600) / 10.0d - 180.0d + 0.0123d"), F.expr("(event_id * 53 % 1790) / 10.0d - 89.5d + 0.0071d")
    cells = _table(spark, d, "events").select("event_id", transforms.hex_cell(lon, lat, 5).alias("cell"))
    return cells.withColumn("parent", transforms.hex_parent(F.col("cell"), 5)).withColumn("n_neighbours", F.size(transforms.hex_neighbours(F.col("cell"), 5)))


def st_accumulate(spark, d):
    return _rounded(_grain(spark, d), "output_attribute_sum")


def st_event_filter(spark, d):
    return _supported(spark, d).select("HAT", "Date", "license_plate", "output_attribute_count")


def st_mean_query(spark, d):
    return _rounded(aggregates.mean_query(_supported(spark, d)), "sum_of_sums", "query_output")


def st_count_query(spark, d):
    return _rounded(aggregates.count_query(_supported(spark, d), THRESHOLD), "query_output")


def st_time_range(spark, d):
    return aggregates.time_range(_grain(spark, d))


def st_sensitivity(spark, d):
    return _rounded(_means(spark, d).select("HAT", "sensitivity"), "sensitivity")


def st_eps_table(spark, d):
    return _rounded(privacy.scale_table(_means(spark, d), _grid(spark), "HAT"), "b")


def st_eps_table_avg(spark, d):
    return _rounded(privacy.mean_scale(privacy.scale_table(_means(spark, d), _grid(spark), "HAT")), "b")


def st_count_eps_table(spark, d):
    """Scales of the tiles' counts, what they are of the counts on average, and of how many tiles."""
    counts = aggregates.count_query(_supported(spark, d), THRESHOLD).agg(F.count(F.lit(1)).alias("tiles"), F.avg("query_output").alias("mean"))
    scales = privacy.count_scale(_grid(spark)).crossJoin(F.broadcast(counts))  # one row
    return _rounded(scales.select("epsilon", "b", "tiles", (F.col("b") / F.col("mean")).alias("share")), "b", "share")


def st_dp_mean(spark, d):
    noisy = privacy.noised_tile_mean(_means(spark, d), EPSILON, privacy.keyed("seed", "HAT"))
    return privacy.post_process(noisy, "mean").select("HAT", F.round("query_output", 6).alias("query_output"), "noisy_output")


def st_dp_count(spark, d):
    counts = aggregates.count_query(_supported(spark, d), THRESHOLD)
    return privacy.post_process(privacy.noised_count(counts, EPSILON, privacy.keyed("seed", "HAT")), "count").select("HAT", F.round("query_output", 6).alias("query_output"), "noisy_output")


def st_dp_mean_keyed(spark, d):
    noisy = privacy.noised_tile_mean(_means(spark, d), EPSILON, privacy.secret(KEY, "mean of speed", "HAT"))
    return privacy.post_process(noisy, "mean").select("HAT", F.round("query_output", 6).alias("query_output"), "noisy_output")


def st_dp_mean_snapped(spark, d):
    noisy = privacy.noised_snapped(_means(spark, d), F.col("sensitivity") / EPSILON, MOST, KEY, "mean of speed", "HAT")
    return noisy.select("HAT", F.round("query_output", 6).alias("query_output"), "noisy_output")


#: Observations that a plate gives to a tile, and tiles of a plate, at most.
PER_TILE, TILES = 2, 4


def _bounded(spark, d):
    rows = aggregates.bounded(_tiles(spark, d), "trip_id", PER_TILE, TILES, "salt")
    return aggregates.mean_query(aggregates.accumulate(rows, "speed"))


def st_mean_bounded(spark, d):
    """Means of bounded contributions, the sensitivity that the bounds give, and the one that the data give without them."""
    free = privacy.with_sensitivity(aggregates.mean_query(_grain(spark, d)), LEAST, MOST).select("HAT", F.round("sensitivity", 6).alias("sensitivity"))
    held = _bounded(spark, d).select("HAT", "sum_of_counts", F.round("query_output", 6).alias("query_output"), F.lit(PER_TILE * MOST).alias("bound_of_sum"), F.lit(PER_TILE).cast("long").alias("bound_of_count"))
    return held.join(free, "HAT")


def st_dp_mean_bounded(spark, d):
    noisy = privacy.noised_bounded_mean(_bounded(spark, d), EPSILON, PER_TILE, TILES, LEAST, MOST, privacy.keyed("seed", "HAT"))
    return privacy.post_process(noisy, "mean").select("HAT", "noisy_output")


def _tests(spark, d):
    return _table(spark, d, "orders", "o_custkey", "o_orderstatus").join(_table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))


def _days(spark, d):
    return _table(spark, d, "lineitem").select("l_returnflag", F.round(F.col("l_discount") * 100).alias("days"))


def med_count_query(spark, d):
    return aggregates.category_count(_tests(spark, d), "c_nationkey", "o_orderstatus", "F")


def med_mean_query(spark, d):
    return _rounded(aggregates.category_mean(_days(spark, d), "l_returnflag", "days", DAYS_MOST), "sum", "query_output")


def med_dp_count(spark, d):
    return privacy.post_process(privacy.noised_count(med_count_query(spark, d), EPSILON, privacy.keyed("seed", "c_nationkey")), "count")


def med_dp_count_geometric(spark, d):
    return privacy.noised_count_geometric(med_count_query(spark, d), 0.2, privacy.keyed("seed", "c_nationkey"))


def med_dp_mean(spark, d):
    means = aggregates.category_mean(_days(spark, d), "l_returnflag", "days", DAYS_MOST)
    return _rounded(privacy.post_process(privacy.noised_category_mean(means, EPSILON, DAYS_MOST, privacy.keyed("seed", "l_returnflag")), "mean"), "query_output")


def med_count_eps_table(spark, d):
    """Scales of the categories' counts, what they are of the counts on average, and of how many categories."""
    counts = med_count_query(spark, d).agg(F.count(F.lit(1)).alias("categories"), F.avg("query_output").alias("mean"))
    scales = privacy.count_scale(_medical_grid(spark)).crossJoin(F.broadcast(counts))  # one row
    return _rounded(scales.select("epsilon", "b", "categories", (F.col("b") / F.col("mean")).alias("share")), "b", "share")


def med_mean_mae_analytic(spark, d):
    means = aggregates.category_mean(_days(spark, d), "l_returnflag", "days", DAYS_MOST)
    return _rounded(privacy.mean_error_analytic(means, _medical_grid(spark), DAYS_MOST), "mae")


def med_mean_mae_mc(spark, d):
    means = aggregates.category_mean(_days(spark, d), "l_returnflag", "days", DAYS_MOST)
    return _rounded(privacy.mean_error_simulated(means, _medical_grid(spark), DAYS_MOST, seed=7), "mae")


def med_mean_mae_mc_few(spark, d):
    """The same at 2,000 draws."""
    means = aggregates.category_mean(_days(spark, d), "l_returnflag", "days", DAYS_MOST)
    return _rounded(privacy.mean_error_simulated(means, _medical_grid(spark), DAYS_MOST, draws=2_000, seed=7), "mae")


def normalized_mae(spark, d):
    means = _means(spark, d)
    return _rounded(privacy.normalized_error(means, privacy.scale_table(means, _grid(spark), "HAT"), "HAT"), "normalized_mae")


def _ages(spark, d):
    return aggregates.histogram(_table(spark, d, "part", "p_size"), "p_size", AGE_LEAST, AGE_MOST)


def age_histogram(spark, d):
    return _ages(spark, d)


def k_width(spark, d):
    return kanon.width_table(_ages(spark, d), K, "p_size").select(F.lit(K).alias("k"), "width")


def k_unattainable(spark, d):
    """A k beyond the whole table: no width, and nothing to publish."""
    total = _table(spark, d, "part").count()
    return kanon.width_table(_ages(spark, d), total + 1, "p_size").select("width").join(_assigned(spark, d, total + 1, True).agg(F.count(F.lit(1)).alias("published")))  # one row each


def _assigned(spark, d, k=K, strict=False):
    """Nothing is published where no width makes groups of k."""
    bins, rows = kanon.width_table(_ages(spark, d), k, "p_size").first()["width"], _table(spark, d, "part", "p_partkey", "p_size")
    return kanon.assign(rows if bins > 0 else rows.limit(0), "p_size", max(bins, 1), AGE_LEAST, AGE_MOST, strict).withColumnRenamed("p_size Bin", "bin")


def k_assign_full(spark, d):
    return _assigned(spark, d)


def k_assign_strict(spark, d):
    return _assigned(spark, d, strict=True)


def k_strict_sizes(spark, d):
    """Rows by strict bin at a tenth of k, where the last bin takes what its width leaves over: none is smaller than that."""
    return _assigned(spark, d, K // 10, True).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def k_assign_counts(spark, d):
    bins, ages = kanon.width_table(_ages(spark, d), K, "p_size").first()["width"], _ages(spark, d)
    return kanon.assign(ages if bins > 0 else ages.limit(0), "p_size", max(bins, 1), AGE_LEAST, AGE_MOST, keep=True).withColumnRenamed("p_size Bin", "bin")


QUERIES = {f.__name__: f for f in (
    suppress, pseudonymize, pseudonymize_keyed, document_round_trip, schema_drift, suppress_pseudonymize, dedup_keep_first, dedup_arrays_aside, temporal_generalize, temporal_filter, hat_create, coords_parse, coords_hex,
    st_accumulate, st_event_filter, st_mean_query, st_count_query, st_time_range, st_sensitivity, st_eps_table, st_eps_table_avg, st_count_eps_table,
    st_dp_mean, st_dp_count, st_dp_mean_keyed, st_dp_mean_snapped, st_mean_bounded, st_dp_mean_bounded, med_dp_count_geometric, med_mean_mae_mc_few, med_count_query, med_mean_query, med_dp_count, med_dp_mean, med_count_eps_table, med_mean_mae_analytic, med_mean_mae_mc,
    normalized_mae, age_histogram, k_width, k_assign_full, k_assign_counts, k_assign_strict, k_strict_sizes, k_unattainable)}

_G = """o AS (SELECT CAST(event_id AS VARCHAR) AS trip_id, CAST(user_id AS VARCHAR) AS license_plate, ts, value AS speed, CAST(hour(ts) AS INT) AS slot,
  CAST(hour(ts) AS VARCHAR) || ' ' || CAST(user_id % 2 AS VARCHAR) AS HAT, CAST(ts AS DATE) AS Date FROM events),
g AS (SELECT HAT, Date, license_plate, coalesce(sum(speed), 0) AS s, count(speed) AS c, max(speed) AS m FROM o WHERE slot BETWEEN 9 AND 20 GROUP BY ALL),
f AS (SELECT * FROM g WHERE HAT IN (SELECT HAT FROM g GROUP BY HAT HAVING count(*) >= (SELECT count(*) FROM events) * 0.00065::DOUBLE * (SELECT count(DISTINCT Date) FROM g)))"""
_MEANS = """(SELECT HAT, CAST(sum(c) AS BIGINT) AS sum_of_counts, sum(s) AS sum_of_sums, CAST(max(c) AS BIGINT) AS max_of_sum_of_counts_per_lp,
  sum(s) / sum(c) AS query_output, max(c) * 65.0 / sum(c) AS sensitivity FROM (SELECT HAT, license_plate, sum(c) AS c, sum(s) AS s FROM {0} GROUP BY ALL) GROUP BY HAT)"""
_COUNTS = "(SELECT HAT, avg(n) AS query_output FROM (SELECT HAT, Date, count(*) FILTER (m > 60) AS n FROM {0} GROUP BY ALL) GROUP BY HAT)"
_U = "((CAST('0x' || sha256('seed|{1}|' || {0})[1:13] AS BIGINT) + 0.5) / 4503599627370496.0 - 0.5)"
_E = "(SELECT round(1.0 + i * 0.1, 2)::DOUBLE AS epsilon FROM range(290) t(i))"
_EM = "(SELECT round(0.01 + i * 0.1, 2)::DOUBLE AS epsilon FROM range(100) t(i))"
_DAYS = """(SELECT l_returnflag, CAST(sum(least(v, 8)) AS DOUBLE) AS s, count(v) AS c FROM (SELECT l_returnflag, round(l_discount * 100) AS v FROM lineitem)
  WHERE v IS DISTINCT FROM 0 GROUP BY 1)"""
_POSITIVE = "(SELECT c_nationkey, count(*) AS q FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1)"
_HIST = "h AS (SELECT i AS a, count(p_size) AS n FROM range(50) t(i) LEFT JOIN part ON p_size = i GROUP BY 1)"

def _width(k: int) -> str:
    return _HIST + f""", whole AS (SELECT max(a) AS mx, sum(n) AS total FROM h), r AS (SELECT unnest(range(1, 51)) AS r),
b AS (SELECT r, least((a - 1) // r, 49 // r - 1) AS bin, sum(n) AS c FROM h, r WHERE a >= 1 AND r <= 49 GROUP BY ALL),
w AS (SELECT min(r) AS w FROM r WHERE r NOT IN (SELECT r FROM b WHERE c > 0 AND c < {k})),
k AS (SELECT CAST(CASE WHEN {k} > total THEN -1 WHEN {k} = total OR 49 // w = 1 THEN 49 ELSE w END AS BIGINT) AS width FROM whole, w)"""


_WIDTH = _width(200)


def _lap(key: str, scale: str, name: str = "noise") -> str:
    u = _U.format(key, name)
    return f"(-({scale}) * sign({u}) * ln(1 - 2 * abs({u})))"


def _hmac(message: str) -> str:
    """HMAC-SHA-256 of a text, written out."""
    inner, outer = ("".join(f"{b ^ pad:02x}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _simulated(draws: int) -> str:
    unit = lambda first: f"((CAST('0x' || d[{first}:{first + 12}] AS BIGINT) + 0.5) / 4503599627370496.0 - 0.5)"
    lap = lambda x: f"(-sign({x}) * ln(1 - 2 * abs({x})))"
    return f"""SELECT epsilon, round(avg(abs((s * epsilon + a) / (c * epsilon + b) - s / c)), 6) AS mae FROM (
        SELECT s, c::DOUBLE AS c, 8 * {lap(unit(1))} AS a, {lap(unit(14))} AS b FROM (SELECT *, sha256('7|' || l_returnflag || '|' || i) AS d FROM {_DAYS}, range({draws}) t(i))), {_EM} GROUP BY 1"""


_SNAP = f"""SELECT HAT, q, b, pow(2, ceil(log2(b))) AS l, CASE WHEN d[64] < '8' THEN -1 ELSE 1 END AS side,
  pow(2.0, -(4 * z + CASE WHEN n = '1' THEN 3 WHEN n IN ('2', '3') THEN 2 WHEN n IN ('4', '5', '6', '7') THEN 1 ELSE 0 END + 1)) * (1 + CAST('0x' || d[33:45] AS BIGINT) / 4503599627370496.0) AS u
  FROM (SELECT *, d[z+1] AS n FROM (SELECT *, length(d[1:32]) - length(ltrim(d[1:32], '0')) AS z FROM (
    SELECT HAT, query_output AS q, CAST(sensitivity AS DOUBLE) / 2 AS b, {_hmac("'mean of speed|snap|' || HAT")} AS d FROM {_MEANS.format('f')})))"""
_BOUND = """, k AS (SELECT HAT, license_plate FROM (SELECT DISTINCT HAT, license_plate FROM o WHERE slot BETWEEN 9 AND 20)
  QUALIFY row_number() OVER (PARTITION BY license_plate ORDER BY sha256('salt|' || license_plate || '|' || HAT)) <= 4),
e AS (SELECT * FROM o SEMI JOIN k USING (HAT, license_plate) QUALIFY row_number() OVER (PARTITION BY HAT, license_plate ORDER BY sha256('salt|' || trip_id)) <= 2),
h AS (SELECT HAT, count(speed) AS n, coalesce(sum(speed), 0) AS s FROM e WHERE Date IS NOT NULL GROUP BY 1)"""


def _post(value: str, scale: int) -> str:
    return f"round_even(greatest({value}, 0) * {scale}, 0) / {scale}"


def _bin(fold: bool) -> str:
    number = "greatest(CAST(ceil(p_size / width) AS BIGINT), 1)"
    low = f"(({number} - 1) * width)"
    if not fold:
        return f"CASE WHEN p_size BETWEEN 0 AND (CAST(ceil((51 + width) / width) AS BIGINT) - 1) * width THEN CASE WHEN {number} = 1 THEN printf('(-0.001, %.1f]', width::DOUBLE) ELSE printf('(%.1f, %.1f]', {low}::DOUBLE, ({number} * width)::DOUBLE) END END"
    number = f"least({number}, greatest(49 // width, 1))"
    high = f"(CASE WHEN {number} = greatest(49 // width, 1) THEN 49 ELSE {number} * width END)"
    return f"CASE WHEN p_size BETWEEN 0 AND 49 THEN CASE WHEN {number} = 1 THEN printf('(-0.001, %.1f]', {high}::DOUBLE) ELSE printf('(%.1f, %.1f]', (({number} - 1) * width)::DOUBLE, {high}::DOUBLE) END END"


_SIDE = round((510_072_000 / (2 + 120 * 7**7)) ** 0.5 / 111.32, 4)


def _hex(lon: str, lat: str, resolution: int, source: str, keep: str, name: str) -> str:
    """Cells written out in SQL: project, round all three coordinates, correct the one that moved most."""
    side, around = transforms._hexagons(resolution)
    return f"""SELECT {keep}, '{resolution}x' || (((fq % {around}) + {around}) % {around}) || 'x' || fr AS {name}, fq, fr FROM (
  SELECT *, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS fq, CAST(CASE WHEN dr >= dq AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS fr FROM (
  SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM (
  SELECT *, (x * sqrt(3) / 3 - y / 3) / {side!r} AS q, y * 2 / 3 / {side!r} AS r FROM (SELECT *, radians({lon}) * 6371.0072::DOUBLE AS x, sin(radians({lat})) * 6371.0072::DOUBLE AS y FROM {source})))))"""


def _hexes() -> str:
    side, around = transforms._hexagons(5)
    cells = _hex("(user_id * 37 % 3600) / 10.0::DOUBLE - 180.0::DOUBLE + 0.0123::DOUBLE", "(event_id * 53 % 1790) / 10.0::DOUBLE - 89.5::DOUBLE + 0.0071::DOUBLE", 5, "events", "event_id", "cell")
    centre = f"(SELECT event_id, cell, fr AS row, ((fq % {around}) + {around}) % {around} + fr / 2.0::DOUBLE AS across FROM ({cells}))"
    lon = f"degrees(across * (sqrt(3) * {side!r} / 6371.0072::DOUBLE))"
    up = _hex(f"{lon} - 360 * floor(({lon} + 180) / 360)", f"degrees(asin(greatest(least(row * (1.5 * {side!r} / 6371.0072::DOUBLE), 1.0), -1.0)))", 4, centre, "event_id, cell, row", "parent")
    near = " + ".join(f"{n} * CAST(abs(row + {j}) * (1.5 * {side!r}) < 6371.0072 + {side!r} AS INT)" for j, n in ((-1, 2), (0, 2), (1, 2)))
    return f"SELECT event_id, cell, parent, CAST({near} AS INT) AS n_neighbours FROM ({up})"


ORACLES = {
    "coords_hex": _hexes(),
    "document_round_trip": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "schema_drift": "SELECT event_id, round(value, 6) AS value, 'string' AS kind FROM events",
    "suppress": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "pseudonymize": "SELECT c_nationkey, sha256(c_name || CAST(c_custkey AS VARCHAR)) AS hashed_value FROM customer",
    "suppress_pseudonymize": "SELECT c_nationkey, sha256(c_name || CAST(c_custkey AS VARCHAR)) AS hashed_value FROM customer",
    "dedup_keep_first": "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) = 1",
    "dedup_arrays_aside": "SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1",
    "temporal_generalize": f"WITH {_G} SELECT trip_id, Date, strftime(ts, '%H:%M:%S.%f') AS Time, slot AS Timeslot FROM o",
    "temporal_filter": f"WITH {_G} SELECT trip_id, slot AS Timeslot FROM o WHERE slot BETWEEN 9 AND 20",
    "hat_create": f"WITH {_G} SELECT trip_id, HAT FROM o WHERE slot BETWEEN 9 AND 20",
    "coords_parse": f"""SELECT event_id, CAST(CAST(floor((CAST(printf('%.4f', 12.0::DOUBLE + (event_id % 5) * 0.017::DOUBLE) AS DOUBLE) + 90.0) / {_SIDE}::DOUBLE) AS BIGINT) AS VARCHAR) || '_' ||
        CAST(CAST(floor((CAST(printf('%.4f', 77.0::DOUBLE + (user_id % 7) * 0.013::DOUBLE) AS DOUBLE) + 180.0) / {_SIDE}::DOUBLE) AS BIGINT) AS VARCHAR) AS cell FROM events""",
    "st_accumulate": f"WITH {_G} SELECT HAT, Date, license_plate, round(s, 6) AS output_attribute_sum, c AS output_attribute_count, m AS output_attribute_max FROM g",
    "st_event_filter": f"WITH {_G} SELECT HAT, Date, license_plate, c AS output_attribute_count FROM f",
    "st_mean_query": f"WITH {_G} SELECT HAT, sum_of_counts, round(sum_of_sums, 6) AS sum_of_sums, max_of_sum_of_counts_per_lp, round(query_output, 6) AS query_output FROM {_MEANS.format('f')}",
    "st_count_query": f"WITH {_G} SELECT HAT, round(query_output, 6) AS query_output FROM {_COUNTS.format('f')}",
    "st_time_range": f"WITH {_G} SELECT CAST(date_diff('day', min(Date), max(Date)) + 1 AS BIGINT) AS time_range FROM g",
    "st_sensitivity": f"WITH {_G} SELECT HAT, round(CAST(sensitivity AS DOUBLE), 6) AS sensitivity FROM {_MEANS.format('f')}",
    "st_eps_table": f"WITH {_G} SELECT HAT, epsilon, round(CAST(sensitivity AS DOUBLE) / epsilon, 6) AS b FROM {_MEANS.format('f')}, {_E}",
    "st_eps_table_avg": f"WITH {_G} SELECT epsilon, round(avg(CAST(sensitivity AS DOUBLE) / epsilon), 6) AS b FROM {_MEANS.format('f')}, {_E} GROUP BY 1",
    "st_count_eps_table": f"WITH {_G} SELECT epsilon, round(1 / epsilon, 6) AS b, tiles, round(1 / epsilon / mean, 6) AS share FROM {_E}, (SELECT count(*) AS tiles, avg(query_output) AS mean FROM {_COUNTS.format('f')})",
    "st_dp_mean": f"WITH {_G} SELECT HAT, round(query_output, 6) AS query_output, {_post('query_output + ' + _lap('HAT', 'CAST(sensitivity AS DOUBLE) / 2'), 1000)} AS noisy_output FROM {_MEANS.format('f')}",
    "st_dp_count": f"WITH {_G} SELECT HAT, round(query_output, 6) AS query_output, {_post('query_output + ' + _lap('HAT', '0.5'), 1)} AS noisy_output FROM {_COUNTS.format('f')}",
    "med_count_query": f"SELECT c_nationkey, q AS query_output FROM {_POSITIVE}",
    "med_mean_query": f"SELECT l_returnflag, round(s, 6) AS sum, c AS count, round(s / c, 6) AS query_output FROM {_DAYS}",
    "med_dp_count": f"SELECT c_nationkey, q AS query_output, {_post('q + ' + _lap('CAST(c_nationkey AS VARCHAR)', '0.5'), 1)} AS noisy_output FROM {_POSITIVE}",
    "med_dp_mean": f"""SELECT l_returnflag, round(s / c, 6) AS query_output,
        {_post('(s + ' + _lap('l_returnflag', '8.0', 'sum') + ') / (c + ' + _lap('l_returnflag', '1.0', 'count') + ')', 1000)} AS noisy_output FROM {_DAYS}""",
    "med_count_eps_table": f"SELECT epsilon, round(1 / epsilon, 6) AS b, categories, round(1 / epsilon / mean, 6) AS share FROM {_EM}, (SELECT count(*) AS categories, avg(q) AS mean FROM {_POSITIVE})",
    "med_mean_mae_analytic": f"""SELECT epsilon, round(avg((a * a + a * k + k * k) / ((a + k) * c)), 6) AS mae
        FROM (SELECT epsilon, 8 / epsilon AS a, s / c / epsilon AS k, c FROM {_DAYS}, {_EM}) GROUP BY 1""",
    "med_mean_mae_mc": _simulated(1_000_000),
    "med_mean_mae_mc_few": _simulated(2_000),
    "med_dp_count_geometric": f"""SELECT c_nationkey, q AS query_output, CAST(q + CASE WHEN u < 0 THEN -1 ELSE 1 END * greatest(ceil(ln((1 - 2 * abs(u)) * (1 + exp(-0.2::DOUBLE)) / 2) / -0.2::DOUBLE) - 1, 0) AS BIGINT) AS noisy_output
        FROM (SELECT *, {_U.format('CAST(c_nationkey AS VARCHAR)', 'noise')} AS u FROM {_POSITIVE})""",
    "pseudonymize_keyed": "SELECT c_mktsegment, " + _hmac("length(c_name) || ':' || c_name || length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey || length(CAST(c_nationkey AS VARCHAR)) || ':' || c_nationkey") + " AS hashed_value FROM customer",
    "st_dp_mean_keyed": f"""WITH {_G} SELECT HAT, round(query_output, 6) AS query_output, {_post('query_output - CAST(sensitivity AS DOUBLE) / 2 * sign(u) * ln(1 - 2 * abs(u))', 1000)} AS noisy_output
        FROM (SELECT *, (CAST('0x' || {_hmac("'mean of speed|noise|' || HAT")}[1:13] AS BIGINT) + 0.5) / 4503599627370496.0 - 0.5 AS u FROM {_MEANS.format('f')})""",
    "st_dp_mean_snapped": f"WITH {_G} SELECT HAT, round(q, 6) AS query_output, greatest(least(round_even((greatest(least(q, 65), -65) + side * b * ln(u)) / l, 0) * l, 65), -65) AS noisy_output FROM ({_SNAP})",
    "st_mean_bounded": f"""WITH {_G}{_BOUND} SELECT HAT, CAST(n AS BIGINT) AS sum_of_counts, round(s / n, 6) AS query_output, 130.0::DOUBLE AS bound_of_sum, CAST(2 AS BIGINT) AS bound_of_count, round(CAST(sensitivity AS DOUBLE), 6) AS sensitivity
        FROM h JOIN {_MEANS.format('g')} USING (HAT)""",
    "st_dp_mean_bounded": f"""WITH {_G}{_BOUND} SELECT HAT, {_post('(s + ' + _lap('HAT', '2 * 65 / 0.25::DOUBLE', 'sum') + ') / (n + ' + _lap('HAT', '2 / 0.25::DOUBLE', 'count') + ')', 1000)} AS noisy_output FROM h""",
    "normalized_mae": f"WITH {_G} SELECT epsilon, round(avg(CAST(sensitivity AS DOUBLE) / epsilon / query_output), 6) AS normalized_mae FROM {_MEANS.format('f')}, {_E} GROUP BY 1",
    "age_histogram": f"WITH {_HIST} SELECT a AS p_size, n AS Count FROM h",
    "k_width": f"WITH {_WIDTH} SELECT 200 AS k, width FROM k",
    "k_assign_full": f"WITH {_WIDTH} SELECT p_partkey, {_bin(False)} AS bin FROM part, (SELECT width FROM k WHERE width > 0)",
    "k_assign_strict": f"WITH {_WIDTH} SELECT p_partkey, {_bin(True)} AS bin FROM part, (SELECT width FROM k WHERE width > 0)",
    "k_assign_counts": f"WITH {_WIDTH} SELECT p_size, n AS Count, {_bin(False)} AS bin FROM (SELECT a AS p_size, n FROM h), (SELECT width FROM k WHERE width > 0)",
    "k_strict_sizes": f"WITH {_width(20)} SELECT bin, count(*) AS n FROM (SELECT {_bin(True)} AS bin FROM part, (SELECT width FROM k WHERE width > 0)) GROUP BY 1",
    "k_unattainable": "SELECT CAST(-1 AS BIGINT) AS width, CAST(0 AS BIGINT) AS published",
}
